"""Catalog, library and reference rules on small tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from textlattice.operators import catalog as C, library as L, nested as N, payloads as J, refs as R
from textlattice.sources import sinks as K


def test_search_checks_before_it_plans(spark):
    d = spark.createDataFrame([("gutendex", 1, "t")], "source string, id long, title string")
    for bad in ({"sources": ["x"]}, {"page": 0}, {"page": 313}, {"page": 313, "sources": ["openalex"]}):
        with pytest.raises(C.SearchError):
            C.search_catalog(d, **bad)
    with pytest.raises(C.SearchError):
        C.matches(kinds=["novel"])
    with pytest.raises(C.SearchError):
        C.date_window(["decade"], date(2026, 1, 1))
    assert C.date_window(["today", "7days"], date(2026, 1, 8)) == (date(2026, 1, 2), date(2026, 1, 8))
    with pytest.raises(ValueError):
        L.newest(d, 501)


@pytest.mark.parametrize("asked", [{"sources": ["gutendex"], "dates": ["today"]}, {"sources": ["gutendex"], "categories": ["domain:1"]}, {"sources": ["gutendex"], "categories": ["subject:a", "subject:b"]}, {"sources": ["gutendex"], "kinds": ["other"]}, {"sources": ["openalex"], "isbn": "1"}, {"sources": ["openalex"], "number": 1}, {"sources": ["openalex"], "categories": ["subject:a"]}, {"sources": ["openalex"], "page": 313}, {"sources": ["gutendex"], "categories": ["subject: a"]}, {"sources": [], "categories": ["x"]}])
def test_what_providers_cannot_answer(asked):
    with pytest.raises(C.SearchError):
        C.capable(**asked)
    C.capable(["gutendex"], categories=["subject:a"], kinds=["book"], isbn="1", page=400)


def test_paging(spark):
    n = 33 * 312
    d = spark.range(n).selectExpr("CASE WHEN id % 2 = 0 THEN 'gutendex' ELSE 'openalex' END AS source", "id", "concat('t ', id) AS title").unionByName(spark.range(n).selectExpr("'openalex' AS source", "id + 100000 AS id", "'t' AS title"))
    page = lambda k, **f: [(r.next_page, r.previous_page, r.total) for r in C.search_catalog(d, k, **f).select("next_page", "previous_page", "total").distinct().collect()]
    assert sorted(page(1), key=lambda x: x[2]) == [(2, None, n // 2), (2, None, n // 2 + n)]
    # one provider ends at page 312, the other goes on alone; beyond the last page there is nothing
    assert page(312, sources=["openalex"]) == [(None, 311, n // 2 + n)]
    assert page(161, sources=["gutendex"]) == [(None, 160, n // 2)] and page(400, sources=["gutendex"]) == []
    assert "ends at page 312" in C.paging_warning({"openalex": n * 2}, 312) and C.paging_warning({"gutendex": n}, 312) is None and C.paging_warning({"openalex": 5, "gutendex": 6}, 312) is None
    assert [r.id for r in C.search_books(d, " #42 ", sources=["gutendex"]).collect()] == [42]
    assert C.search_books(d, "t 10294").count() == 1


def test_enrichment_refuses_many_candidates(spark):
    books = spark.createDataFrame([(1, "Straße", ["A B"], None, ""), (2, "Common", ["C"], None, "P"), (3, "x", [], "9780141439518", "")], "id long, title string, authors array<string>, isbn string, publisher string")
    works = spark.createDataFrame([("W1", "STRASSE", ["b a"]), *((f"W{k}", "common", ["C" if k == 20 else "D"]) for k in range(20, 31))], "work_id string, title string, authors array<string>")
    editions = spark.createDataFrame([("9780141439518", "Q")], "isbn string, publisher string")
    out = {r.id: (r.match_method, r.work_id, r.publisher) for r in C.enrich(books, editions, works).collect()}
    assert out == {1: ("title_author", "W1", None), 2: (None, None, "P"), 3: ("isbn", None, "Q")}
    more = editions.selectExpr("*", "'1999' AS date", "0 AS number_of_pages", "'OL1M' AS edition_id")
    (r,) = C.enrich(books.where("id = 3").selectExpr("*", "'' AS date", "12 AS number_of_pages"), more, works).collect()
    assert (r.date, r.number_of_pages, r.edition_id, r.publisher) == ("1999", 12, "OL1M", "Q")


def payload(**k):
    import json

    return json.dumps(k)


def test_payloads(spark):
    book = {"id": 5, "title": "T", "authors": [{"name": "A"}], "languages": ["en"], "subjects": ["s"]}
    bad = [{**book, "id": 0}, {**book, "id": "5"}, {**book, "title": ""}, {**book, "authors": [{}]}, {**book, "authors": "A"}, {"title": "T"}]
    pages = [(1, payload(count=1, results=[book])), *((10 + k, payload(count=9, results=[book, b])) for k, b in enumerate(bad)), (20, payload(count=-1, results=[])), (21, payload(count=1, results=[book] * 33)), (22, "no json"), (23, None), (24, payload(count=9)), (25, payload(count=9, results=[])), (26, payload(count=0, results=[]))]
    d = spark.createDataFrame([(k, 1, p) for k, p in pages], "k int, page int, payload string")
    for k, p in pages:
        rows = J.gutendex(d.where(F.col("k") == k)).collect()
        assert [r.error for r in rows] == ([None] if k == 1 else [] if k == 26 else ["invalid catalog metadata"]), p
    (r,) = J.gutendex(d.where("k = 1")).collect()
    assert (r.id, r.title, r.authors, r.language, r.kind, r.categories, r.url) == ("5", "T", ["A"], "en", "book", ["subject:s"], "https://www.gutenberg.org/ebooks/5")
    work = {"id": "https://openalex.org/W7", "title": None, "display_name": "D", "authorships": [{"author": {"display_name": "A"}}], "publication_date": "2020-02-29", "type": "article", "primary_topic": {"domain": {"id": "https://openalex.org/domains/3"}}}
    bad = [{**work, "id": "W0"}, {**work, "publication_date": "2021-02-29"}, {**work, "publication_date": "2021"}, {**work, "primary_topic": {"domain": {"id": "https://openalex.org/domains/5"}}}, {**work, "display_name": None}]
    pages = [(1, payload(meta={"count": 40, "page": 2}, results=[work])), *((10 + k, payload(meta={"count": 90}, results=[work, b])) for k, b in enumerate(bad)), (20, payload(meta={"count": 40, "page": 1}, results=[work])), (21, payload(meta={"count": 40, "per_page": 25}, results=[work])), (22, payload(meta={"count": 32}, results=[work]))]
    d = spark.createDataFrame([(k, 2, p) for k, p in pages], "k int, page int, payload string")
    errors = {k: [r.error for r in J.openalex(d.where(F.col("k") == k)).collect()] for k, _ in pages}
    assert errors == {k: [None] if k == 1 else ["invalid catalog metadata"] for k, _ in pages}
    (r,) = J.openalex(d.where("k = 1")).collect()
    assert (r.id, r.title, str(r.publication_date), r.categories, r.url, r["count"]) == ("W7", "D", "2020-02-29", ["domain:3"], "https://openalex.org/W7", 40)


def test_sinks(spark, tmp_path):
    one = spark.createDataFrame([("a", 1, '{"n": 1}'), ("b", 1, '{"n": 2}')], "record_id string, version int, json string")
    two = spark.createDataFrame([("a", 2, '{"n": 3}')], "record_id string, version int, json string")
    for rows in (one, two):
        K.append_result(rows, f"{tmp_path}/results")
    assert spark.read.parquet(f"{tmp_path}/results").count() == 3
    assert sorted((r.record_id, r.version, r.json) for r in K.latest_results(spark, f"{tmp_path}/results").collect()) == [("a", 2, '{"n": 3}'), ("b", 1, '{"n": 2}')]
    K.upsert(spark, one, f"{tmp_path}/t1", "record_id")
    K.upsert(spark, spark.createDataFrame([("a", 9, "x"), ("c", 1, "y")], one.schema), f"{tmp_path}/t2", "record_id", f"{tmp_path}/t1")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/t2").collect()) == [("a", 9, "x"), ("b", 1, '{"n": 2}'), ("c", 1, "y")]
    K.write_json(spark.createDataFrame([(1, None)], "a int, b int"), f"{tmp_path}/j")
    assert [r.value for r in spark.read.text(f"{tmp_path}/j").collect()] == ['{"a":1}']
    with pytest.raises(Exception, match="exist"):
        K.write_json(one, f"{tmp_path}/j")


def test_owner_and_views(spark):
    with pytest.raises(ValueError):
        L.scoped(spark.range(1), "")
    d = spark.createDataFrame([(1, "u"), (2, "v"), (3, None)], "id long, user_id string")
    assert [r.id for r in L.scoped(d, "u").collect()] == [1]
    rows = spark.createDataFrame([("a", "x"), ("b", ""), ("c", None), ("d", "[]")], "name string, value string")
    assert [r.name for r in N.shown(rows).collect()] == ["a"]


def test_tokens_by_file(spark):
    import os

    from textlattice.functions import tokens as K2
    from textlattice.operators import books as B

    path = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "word_bpe_49k.json")
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    from tokenizers import Tokenizer

    texts = ["One sentence here. And another!", "", "naïve café — 3.5%"]
    d = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc_id long, text string")
    try:
        ref = Tokenizer.from_file(path)
    except Exception:
        pytest.skip("not a tokenizer of this library")
    got = {r.doc_id: r.n for r in d.select("doc_id", K2.from_file(spark, path)(F.col("text")).alias("n")).collect()}
    assert got == {k: len(ref.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)} | {9: None}
    book = d.where("doc_id = 0")
    by_file, plain, none = (B.analyze_books(book, encoder=e).collect()[0].tokens for e in (K2.from_file(spark, path), K2.white_space, None))
    assert (by_file, plain, none) == (got[0], 5, None)


def test_command_line(tmp_path):
    import json
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "a.md").write_text("# Title\n\nSome words here.")
    out = subprocess.run([sys.executable, "-m", "textlattice", str(tmp_path / "a.md")], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=240)
    got = json.loads(out.stdout[out.stdout.index("{") :])
    assert (got["format"], got["title"], got["words"], got["n_heading"], got["sections"]) == ("markdown", "Title", 3, 1, 1)


def test_epub_books(spark):
    from textlattice.operators import books as B
    from textlattice.plans.format_queries import make_epub

    files = spark.createDataFrame([("a", make_epub("T", ["It was so. And then."] * 3)), ("b", b"junk")], "path string, content binary")
    out = {r.path: r for r in B.analyze_epubs(files).collect()}
    assert (out["a"].schema, out["a"].top_nodes, out["a"].words, out["a"].title, out["a"].error) == ("standard_book", 3, 15, "T", None)
    assert out["b"].error and out["b"].words is None


def test_isbn(spark):
    cases = {"978-0-14-143951-8": "9780141439518", "9780141439519": None, "0-306-40615-2": "0306406152", "080442957x": "080442957X", "0804429571": None, "": None, None: None, "abc": None}
    for r in spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string").select("*", C.valid_isbn(F.col("x")).alias("got")).collect():
        assert r.got == r.want, r.x


REFS = {
    "Vol1:3:4": (None, None, ["Vol1", "3", "4"], None, None, None, None),
    "Vol1:3!word2-4": (None, None, ["Vol1", "3"], "word", 2, 4, None),
    'demo@2026/"Part One":"say ""hi""!"': ("demo", "2026", ["Part One", 'say "hi"!'], None, None, None, None),
    "urn:tf:demo@2026:Part%20One:Intro%3A%20Notes:a+b!word2-3": ("demo", "2026", ["Part One", "Intro: Notes", "a+b"], "word", 2, 3, None),
    "a!word12": (None, None, ["a"], "word1", 2, None, None),
    "a!word10": (None, None, ["a"], "word", 10, None, None),
    "": (None, None, None, None, None, None, "empty"),
    "a!": (None, None, None, None, None, None, "syntax"),
    "a!b!c": (None, None, None, None, None, None, "syntax"),
    "a/b/c": (None, None, None, None, None, None, "syntax"),
    "@1/a": (None, None, None, None, None, None, "syntax"),
    'a"b': (None, None, None, None, None, None, "syntax"),
    "a b": (None, None, None, None, None, None, "syntax"),
    "a::b": (None, None, None, None, None, None, "syntax"),
    "a!word5-2": (None, None, None, None, None, None, "descending range"),
    "urn:tf:demo:a%2": (None, None, None, None, None, None, "percent escape"),
    "urn:tf:demo": (None, None, None, None, None, None, "syntax"),
}


def test_references_parse_and_format(spark):
    d = R.parse(spark.createDataFrame([(k,) for k in REFS], "ref string"))
    c = F.col
    d = d.withColumn("again", R.format_ref(c("corpus_id"), c("version"), c("sections"), c("otype"), c("start_at"), c("end_at")))
    for r in d.collect():
        assert (r.corpus_id, r.version, r.sections, r.otype, r.start_at, r.end_at, r.error) == REFS[r.ref], r.ref
        if r.error is None and not r.ref.startswith("urn:"):
            assert r.again == r.ref


def test_resolve_and_serialize(spark):
    sections = spark.createDataFrame([(100, ["Vol1"]), (110, ["Vol1", "3"]), (111, ["Vol1", "3", "4"]), (112, ["Vol1", "3", "5"])], "node long, path array<string>")
    units = spark.createDataFrame([(2000 + k, "word", ["Vol1", "3", "4" if k <= 4 else "5"]) for k in range(1, 9)] + [(3001, "clause", ["Vol1", "3", "4"]), (3002, "clause", ["Vol1", "3", "5"])], "node long, otype string, path array<string>")
    index = R.unit_index(units, sections).cache()
    want = {"Vol1:3:4": [111], "Vol1:3": [110], "Vol1:3:4!word2": [2002], "Vol1:3:4!word2-4": [2002, 2003, 2004], "Vol1:3!word5": [2005], "Vol1:3:4!sentence1": "type not in section", "Vol1:3:4!word5": "index out of range", "Vol1:9": "section not found", "x y": "syntax"}
    got = {}
    for r in R.resolve(R.parse(spark.createDataFrame([(k,) for k in want], "ref string")), sections, index, "ref").collect():
        if r.error:
            got[r.ref] = r.error
        else:
            got.setdefault(r.ref, []).append(r.node)
    assert {k: sorted(v) if isinstance(v, list) else v for k, v in got.items()} == want
    out = {r.node: r.ref for r in R.serialize(units.select("node"), units, index, "demo", "2026").collect()}
    assert out[2005] == "demo@2026/Vol1:3:5!word1" and out[3001] == "demo@2026/Vol1:3:4!clause1" and len(out) == 10


def test_merge_keeps_what_is_known(spark):
    known = spark.createDataFrame([(1, 10), (2, 20)], "key long, created_at long")
    scans = spark.createDataFrame([(2, 30, 1.0), (2, 40, 2.0), (3, 50, 3.0)], "key long, ts long, value double")
    once = L.merge_scans(known, scans)
    assert sorted(tuple(r) for r in once.collect()) == [(1, 10, None, None, 0, "pending"), (2, 20, 40, 2.0, 2, "scanned"), (3, 50, 50, 3.0, 1, "scanned")]
    again = L.merge_scans(once.select("key", "created_at"), scans)
    assert sorted((r.key, r.created_at) for r in again.collect()) == [(1, 10), (2, 20), (3, 50)]


def test_new_keys_come_once(spark):
    d = L.get_or_create(spark.createDataFrame([("1", "a")], "id string, name string"), spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string"), "name")
    assert sorted((r.name, r.created) for r in d.collect()) == [("a", False), ("b", True)]


def test_stream_of_documents(spark, tmp_path):
    from textlattice.streaming import arrivals as A

    rows = [(1, "2024-01-01 00:10:00", "one two"), (2, "2024-01-01 00:20:00", "three"), (3, "2024-01-01 03:00:00", "late four five"), (1, "2024-01-01 00:15:00", "again")]
    spark.createDataFrame(rows, "id long, ts string, text string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    s = A.documents(spark, f"{tmp_path}/in", "id long, ts timestamp, text string")
    q = A.to_parquet(A.windowed_counts(s, "ts", "text"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    out = [(r.docs, r.words) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert out == [(3, 4)]
