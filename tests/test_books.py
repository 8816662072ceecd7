"""Books of each schema with hand-counted nodes, and detection's score rules."""

import pytest
from pyspark.sql import functions as F

from textlattice.functions import patterns as P
from textlattice.operators import books as B

PARA = "The night was long. The road went on, and on."
STANDARD = "\n\n".join(f"CHAPTER {n}\n\n{PARA}\n\n{PARA}" for n in ("I", "II", "III"))
SECTIONED = "\n\n".join(f"PART {p}\n\n" + "\n\n".join(f"CHAPTER {c}\n\n{PARA}" for c in ("I", "II")) for p in ("ONE", "TWO"))
ESSAYS = "\n\n".join(f"{t}\n\nBy A Person\n\n{PARA}" for t in ("THE FIRST ESSAY", "THE SECOND ESSAY", "OF THIRD THINGS"))
FLAT = "\n\n".join([PARA] * 4)
SCRIPTURE = "\n\n".join(f"{b}\n\n" + "\n\n".join(f"{c}:{v} And it was so." for c in (1, 2) for v in (1, 2, 3)) for b in ("GENESIS", "The Second Book of Moses: Called Exodus"))
BOOKS = {1: STANDARD, 2: SECTIONED, 3: ESSAYS, 4: FLAT, 5: SCRIPTURE, 6: "", 7: "   \n ", 8: "CHAPTER I\n\n\n\nCHAPTER II\n\n" + PARA}


@pytest.fixture(scope="module")
def found(spark):
    d = spark.createDataFrame([*BOOKS.items(), (9, None)], "doc_id long, text string")
    clean = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return B.detect(B.with_scores(B.with_evidence(clean))).cache()


def test_detection(found):
    got = {r.doc_id: (r.detected, r.score, r.confidence) for r in found.collect()}
    assert got[1] == ("standard_book", 0.6, "medium") and got[2] == ("sectioned_book", 0.9, "high")
    assert got[3] == ("essay_or_story_collection", 0.6, "medium") and got[4] == ("flat", 0.2, "low")
    assert got[5][0] == "canonical_scripture" and got[5][1] == 0.9
    assert got[6] == got[7] == got[9] == ("flat", 0.2, "low")


def test_override_keeps_the_evidence(spark):
    d = spark.createDataFrame([(1, STANDARD)], "doc_id long, text string")
    (r,) = B.detect(B.with_scores(B.with_evidence(d)), F.lit("flat")).collect()
    assert (r.schema, r.detected, r.overridden, r.score, r.chapter_words) == ("flat", "standard_book", True, 0.6, 3)


def test_nodes(found):
    rows = B.chapter_nodes(B.paragraph_nodes(found.select("doc_id", "schema", "text"))).collect()
    of = lambda i: sorted((r.part, r.part_label, r.chapter, r.label, r.paragraphs, r.sentences, r.words) for r in rows if r.doc_id == i)
    assert of(1) == [(0, None, k, f"CHAPTER {n}", 2, 4, 20) for k, n in enumerate(("I", "II", "III"), 1)]
    assert of(2) == [(p, f"PART {n}", c, f"CHAPTER {m}", 1, 2, 10) for p, n in ((1, "ONE"), (2, "TWO")) for c, m in ((1, "I"), (2, "II"))]
    assert [(x[3], x[4]) for x in of(3)] == [("THE FIRST ESSAY", 2), ("THE SECOND ESSAY", 2), ("OF THIRD THINGS", 2)]
    assert of(4) == [(0, None, 0, None, 4, 8, 40)]
    assert [(x[0], x[2], x[3], x[4], x[6]) for x in of(5)] == [(b, c, f"Chapter {c}", 3, 12) for b in (1, 2) for c in (1, 2)]
    assert of(6) == of(7) == of(9) == [(0, None, 0, None, 0, 0, 0)]
    assert of(8) == [(0, None, 1, "CHAPTER I", 0, 0, 0), (0, None, 2, "CHAPTER II", 1, 2, 10)]


def test_levels_add_up(found):
    nodes = B.paragraph_nodes(found.select("doc_id", "schema", "text")).cache()
    chapters, s = B.chapter_nodes(nodes), {}
    for r in B.summary(chapters).collect():
        s[r.doc_id] = r
    for key in ("paragraphs", "sentences", "words", "tokens"):
        by_doc = {r.doc_id: r.n for r in chapters.groupBy("doc_id").agg(F.sum(key).alias("n")).collect()}
        assert by_doc == {i: r[key] for i, r in s.items()}
    assert (s[1].top_nodes, s[1].mid_nodes, s[2].top_nodes, s[2].mid_nodes, s[4].top_nodes) == (3, None, 2, 4, 4)
    assert (s[1].avg_paragraphs, s[1].avg_sentences, s[1].avg_words, s[4].avg_paragraphs) == (2.0, 2.0, 5.0, 1.0)


def test_analyze_and_empty(spark):
    d = spark.createDataFrame([(1, "x\r\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\r\n" + STANDARD.replace("\n", "\r\n") + "\r\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\r\ny")], "doc_id long, text string")
    (r,) = B.analyze_books(d).collect()
    assert (r.schema, r.top_nodes, r.words) == ("standard_book", 3, 60)
    assert B.analyze_books(d.limit(0)).collect() == []


def test_schemas():
    assert [n for n, _, _ in P.SCHEMAS][-1] == "flat" and len(P.SCHEMAS) == 5
