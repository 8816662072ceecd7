"""Substring dedup against brute force, with many small groups and buckets."""

import random
import re

import pytest

from textlattice.llm.exact_substring import WINDOW, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first, out = {}, []
    last = 1 << 62
    docs = [(last if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    for k, _, w in docs:
        for j in range(len(w) - WINDOW + 1):
            s = tuple(w[j : j + WINDOW])
            first[s] = min(first.get(s, k), k)
    for k, i, w in docs:
        gone = [False] * len(w)
        for j in range(len(w) - WINDOW + 1):
            if first[tuple(w[j : j + WINDOW])] < k:
                gone[j : j + WINDOW] = [True] * WINDOW
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(make, seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "é", "dog", "Dog", "x" * 30])
    passages = [[f"{word()}{k}{j}" for j in range(rnd.randint(8, 40))] for k in range(3)]
    rows = []
    for i in range(70):
        w = [f"{word()}{rnd.randint(0, 400)}" for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            w += rnd.choice(passages) + [f"{word()}{rnd.randint(0, 400)}" for _ in range(rnd.randint(0, 15))]
        rows.append((i, rnd.choice([" ", "\n", "\t  "]).join(w)))
    rows += [(70, None), (71, ""), (72, "one two"), (73, rows[2][1]), (74, rows[2][1]), (74, rows[2][1]), (None, rows[4][1]), (75, " ".join(["z"] * 60)), (76, " ".join(["z"] * 20)), (77, "w " * 40_000)]
    assert got(substring_dedup(make(rows), group_bytes=600, bucket_bytes=800)) == brute(rows)


def test_empty_table(make):
    assert got(substring_dedup(make([]))) == []


def test_layout_and_carried_columns(make):
    long = " ".join(f"w{k}" for k in range(20))
    out = {r.doc_id: r for r in substring_dedup(make([(1, long + "\n\nend"), (2, "new  " + long), (3, "as\tit  is")]), carry=["source", "g"], keep_layout=True).collect()}
    assert out[1].kept == long + "\n\nend" and out[2].kept == "new" and out[3].kept == "as\tit  is"
    assert out[2].removed[0].asDict() == {"start": 1, "end": 21} and (out[1].source, out[1].g) == ("s", 7)


@pytest.mark.parametrize("group_bytes", [1500, 1 << 20])
def test_copies_under_null_and_repeated_ids(make, group_bytes):
    rnd = random.Random(3)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(20))
    rows = [(i, text()) for i in range(10)]
    rows += [(None, text()) for _ in range(30)] + [(None, rows[2][1]), (None, rows[7][1])]
    for i in range(20, 30):  # one row of three is a copy
        rows += [(i, text()), (i, rows[i - 20][1]), (i, text())]
    want = brute(rows)
    assert sum(n == gone for _, n, gone, _ in want) == 12
    assert got(substring_dedup(make(rows), group_bytes=group_bytes, bucket_bytes=800)) == want


def test_two_hops_and_long_words(make, monkeypatch):
    monkeypatch.setattr("textlattice.llm.exchange.FAN", 2)
    rnd = random.Random(8)
    # two words of 2,048 letters each that polynomials modulo a power of two can't tell apart
    morse = ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(2048)) for flip in (0, 1)]
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for i in range(60):
        w = [f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(0, 60))] + (passage if i % 3 == 0 else []) + ["x"] * rnd.randint(0, 3)
        rows.append((i, " ".join(w)))
    rows += [(70, " ".join(passage[:12] + [morse[0]] + passage[:12])), (71, " ".join(passage[:12] + [morse[1]] + passage[:12])), ((1 << 63) - 1, "only here " * 9), (None, rows[3][1] + " tail")]
    assert got(substring_dedup(make(rows), group_bytes=500, bucket_bytes=300)) == brute(rows)


def test_carried_columns_with_names_of_new_ones(make):
    d = make([(1, " ".join(f"w{k}" for k in range(20)))])
    out = substring_dedup(d, carry=["kept", "n_chars", "doc_id"])
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept", "removed", "kept_in", "n_chars", "doc_id_in"]
    assert [(r.kept_in, r.doc_id_in, r.n_words) for r in out.collect()] == [("k", 1, 20)]
