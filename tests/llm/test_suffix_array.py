"""Suffix-array dedup: the order against plain sorting, the operator against brute force."""

import random

import numpy as np
import pytest

from textlattice.llm import suffix_array as S


def test_order_equals_sorting():
    rng = np.random.default_rng(1)
    for _ in range(150):
        t = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 60)).astype(np.uint8)
        wanted = rng.random(len(t)) < 0.6
        b = t.tobytes()
        assert S.suffix_order(t, wanted, S.words8(t)).tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: b[i:])


def test_common_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(40):
        t = np.concatenate([rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8)] * rng.integers(1, 12))
        b = t.tobytes()
        sa = np.array(sorted(range(len(b)), key=lambda i: b[i:]))
        common = lambda x, y: next((k for k in range(S.LENGTH) if b[x + k : x + k + 1] != b[y + k : y + k + 1] or x + k >= len(b)), S.LENGTH)
        got = S.common_prefixes(sa, S.words8(t)).tolist()
        # beyond the end both read as zeros, which the separators of the operator keep out of reach
        assert all(g >= common(x, y) and (g == common(x, y) or max(x, y) + common(x, y) >= len(b)) for g, x, y in zip(got, sa[:-1], sa[1:], strict=True))


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(2, 7)))
    passages = [" ".join(word() for _ in range(rnd.randint(10, 60))) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60)))]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice(passages), " ".join(word() for _ in range(rnd.randint(0, 30)))]
        rows.append((i, " ".join(parts)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, ""), (63, "x" * 500), (64, "ab" * 300), (65, "x" * 99), (66, rows[5][1] + rows[5][1])]
    return rows


def by_place(rows):
    """Brute force: a string goes if it has an earlier (id, start), null ids last."""
    first, out = {}, []
    docs = [(1 << 62 if i is None else i, i, (t or "").encode()) for i, t in rows]
    for key, _, b in docs:
        for k in range(len(b) - S.LENGTH + 1):
            s = b[k : k + S.LENGTH]
            first[s] = min(first.get(s, (key, k)), (key, k))
    for key, i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - S.LENGTH + 1):
            if first[b[k : k + S.LENGTH]] < (key, k):
                gone[k : k + S.LENGTH] = b"\1" * S.LENGTH
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g), runs))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept), len(r.removed)) for r in df.collect()), key=repr)


SMALL = {"group_bytes": 3000, "bucket_bytes": 2500}


# all hashes that occur elsewhere are hot; those of several segments in a group; none
@pytest.mark.parametrize("hot", [(64, 512, 1), (2, 7, 4096), S.HOT])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(make, seed, hot):
    rows = corpus(seed)
    rows += [(70, None), (None, None), (71, "long " * 9000 + rows[2][1]), ((1 << 63) - 1, "é" * 80 + rows[7][1])]
    assert got(S.suffix_dedup(make(rows), **SMALL, hot=hot)) == by_place(rows)


def test_two_hops(make, monkeypatch):
    monkeypatch.setattr("textlattice.llm.exchange.FAN", 2)
    rows = corpus(5)
    assert got(S.suffix_dedup(make(rows), group_bytes=1500, bucket_bytes=1000, hot=(2, 7, 3))) == by_place(rows)


def test_registered_query_equals_brute_force(spark, make, tmp_path):
    from hashlib import sha256

    from textlattice.llm.queries import op5_suffix_array

    rows = [*corpus(3), (80, None), (80, None)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256, r.n_spans) for r in op5_suffix_array(spark, str(tmp_path)).collect()), key=repr)
    assert out == sorted(((i, n, gone, sha256(kept).hexdigest(), runs) for i, n, gone, kept, runs in by_place(rows)), key=repr)


def test_empty_table(make):
    assert got(S.suffix_dedup(make([]))) == []


@pytest.mark.parametrize("group_bytes", [4000, 1 << 20])
def test_null_and_repeated_ids_with_different_texts(make, group_bytes):
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    passages = [text(40) for _ in range(4)]
    holds = lambda: " ".join([text(rnd.randint(0, 12)), rnd.choice(passages), text(40)])
    rows = [(i, holds()) for i in range(6)] + [(6, text(60))]
    rows += [(None, text(60)) for _ in range(12)] + [(None, holds()) for _ in range(12)] + [(None, rows[6][1])]
    for i in range(20, 28):
        rows += [(i, text(70)), (i, holds()), (i, holds()), (i, rows[i - 20][1] if i < 27 else "")]
    rows += [(30, passages[0] + text(9)), (30, passages[0] + text(20)), (None, passages[1] + text(5)), (None, passages[1] + text(7))]  # equal places
    alone = text(50)
    rows += [(40, alone + text(8)), (40, alone + text(9)), (41, text(5) + alone)]  # two first places
    assert got(S.suffix_dedup(make(rows), group_bytes=group_bytes, bucket_bytes=4000)) == by_place(rows)
