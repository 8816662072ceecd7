"""Benchmark decontamination against brute force, in one block and in many."""

import random
import re

import pytest

from textlattice.llm.decontaminate import clean_documents, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, names = words(t), set()
        hit = [False] * len(w)
        for name, x in items:
            b = words(x)
            k = min(13, len(b))
            wins = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if k else set()
            for j in range(len(w) - k + 1 if k else 0):
                if tuple(w[j : j + k]) in wins:
                    hit[j : j + k] = [True] * k
                    names.add(str(name))
        out.append((i, len(w), sum(hit), sorted(names), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture
def case():
    rnd = random.Random(2)
    vocab = [f"{c}{k}" for c in "aBé" for k in range(12)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, text(rnd.choice([1, 5, 12, 13, 14, 40]))) for k in range(8)] + [(20, None), (21, "--"), (22, "Only, once"), (23, "Only, once")]
    docs = [(i, text(rnd.randint(0, 300))) for i in range(30)]
    docs += [(30, "x " + items[5][1].upper() + " y"), (31, None), (32, ""), (33, "only ONCE " + text(200)), (33, "only once"), (None, items[4][1])]
    docs += [(40 + k, text(50) + " " + t + "; " + text(20)) for k, (_, t) in enumerate(items) if t]
    return docs, items


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_equals_brute_force(spark, make, case, block):
    docs, items = case
    docs = [*docs, *docs[28:36], (None, items[4][1]), ((1 << 63) - 1, items[3][1]), (91, "word " * 50_000 + items[5][1] + " end")]
    b = spark.createDataFrame(items, "item_id long, text string")
    out = contamination(make(docs), b, block_bytes=block)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in out.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark, make):
    items = spark.createDataFrame([(1, "a b c"), (2, "c d")], "item_id long, text string")
    assert contamination(make([]), items, block_bytes=1).collect() == []
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, r.contaminated) for r in contamination(make([(1, "a b")]), b).collect()] == [(0, False)]
    assert contamination(make([]), b).collect() == []


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_clean_documents_with_null_and_repeated_ids(spark, make, case, block):
    docs, items = case
    docs = [*docs, (None, "some other text"), (None, None), (33, "only once"), (40, items[2][1]), ((1 << 63) - 1, items[3][1]), (90, "word " * 50_000 + items[5][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = make(docs)
    out = clean_documents(d, b, block_bytes=block)
    assert out.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(((i, t) for i, t in docs if not brute([(i, t)], items)[0][4]), key=repr)
