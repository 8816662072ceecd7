"""Scalar text functions against plain Python on odd strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textlattice.functions import patterns as P, text as T

ABBR = set(P.ABBREVIATIONS)
BOUNDARY = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"‘“])")


def py_sentences(t):
    kept = re.sub(r"\b([A-Za-z]{2,6})\.", lambda m: m[1] + "<!P!>" if m[1].lower() in ABBR else m[0], t)
    return [x.replace("<!P!>", ".").strip() for x in BOUNDARY.split(kept) if x.strip()]


def py_paragraphs(t):
    return [p.strip() for p in re.split(r"\n\s*\n", t) if len(p.strip()) >= 3]


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(1)
    bits = ["Mr. ", "dr.", "One. ", "two! ", 'Three? "', "café ", "well-known ", "a,b; c: d — e", "--", "\n", "\n \n", "\x1c", " ", "é.", "A", "x² ", "No. 5", "“", "St.Paul ", "", "_w ", " ", "etc. And "]
    rows = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    return [*rows, "", "   ", "Mr. Brown met Dr. Who. They talked.", "one. two. Three", "no terminal punctuation", "Chapter 1 has 5 words total"]


def test_against_python(spark, odd):
    d = spark.createDataFrame([(x,) for x in odd], "t string")
    t = F.col("t")
    for r in d.select("t", T.word_count(t).alias("w"), T.sentences(t).alias("s"), T.sentence_count(t).alias("n"), T.paragraphs(t).alias("p"), T.strip(t).alias("x"), T.lines(t).alias("l")).collect():
        assert r.w == len(re.findall(r"\b[a-zA-Z0-9]+\b", r.t)), r.t
        assert r.s == py_sentences(r.t), r.t
        assert r.n == (max(1, len(py_sentences(r.t))) if r.t.strip() else 0), r.t
        assert r.p == py_paragraphs(r.t), r.t
        assert r.x == r.t.strip() and r.l == r.t.splitlines(), r.t


def test_ratio_rounds_as_python(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 5000), rnd.randint(1, 800)) for _ in range(3000)] + [(1, 8), (3, 8), (5, 8), (1, 40), (9, 40), (0, 3)]
    for r in spark.createDataFrame(rows, "w long, n long").select("w", "n", T.ratio(F.col("w"), F.col("n")).alias("r")).collect():
        assert r.r == round(r.w / r.n, 2), (r.w, r.n)


def test_null_text(spark):
    t = F.col("t")
    (r,) = spark.createDataFrame([(None,)], "t string").select(T.word_count(t), T.sentences(t), T.paragraphs(t), T.clauses(t), T.strip_boilerplate(t), T.html_to_text(t), T.strip_contents(t)).collect()
    assert all(x is None for x in r)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("CONTENTS\n\nChapter 1\n\nChapter 2\n\nIt was so. Then more came.\n\nEnd of it.", "It was so. Then more came.\n\nEnd of it."),
        ("CONTENTS\n\nChapter 1 .... 3\nChapter 2 .... 9\n\nChapter 1\n\nIt was so. Then.", "Chapter 1\n\nIt was so. Then."),
        ("A Title\n\nTABLE OF CONTENTS:\n\nI. One\nII. Two\n\nProse it is. And on.", "Prose it is. And on."),
        ("CONTENTS\n\nChapter 1\n\nJust prose here. One entry is too few.", None),
        ("This is prose. It comes first.\n\nCONTENTS\n\nChapter 1\n\nChapter 2\n\nMore prose. Yes.", None),
        ("CONTENTS\n\nChapter 1\n\nChapter 2", None),
        ("No label at all.", None),
        ("", None),
    ],
)
def test_contents_pages(spark, text, want):
    (r,) = spark.createDataFrame([(text,)], "t string").select(T.strip_contents(F.col("t")).alias("x")).collect()
    assert r.x == (text if want is None else want)
