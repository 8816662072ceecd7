"""Short values, preprocessing of whole books, and trees for display."""

from pyspark.sql import functions as F

from textlattice.functions import text as T, values as V
from textlattice.operators import nested as N, refs as R


def column(spark, cases, f):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string").select("k", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.k)]


def test_identifiers(spark):
    assert column(spark, ["/works/OL5W", "OL5M", "/works/OL5W/x", "OLW", None, ""], lambda x: V.open_library_id(x, "W")) == ["OL5W", None, None, None, None, None]
    assert column(spark, ["W1", "W01", "W", "xW1", None], V.is_work_id) == [True, False, False, False, None]
    assert [str(d) for d in column(spark, ["2024-02-29", "2023-02-29", "2024-2-9", "", None], V.iso_day)] == ["2024-02-29", "None", "None", "None", "None"]
    assert column(spark, ["urn:isbn:978-0-14-143951-8!", "no", None], V.isbn_in) == ["9780141439518", None, None]
    assert column(spark, ["Straße ﬁne", "B a", None, ""], V.normal_title) == ["fine strasse", "a b", None, ""]


def test_search_input_and_addresses(spark):
    got = column(spark, [" 978-0-14-143951-8 ", "##42", "#0", "some title", "080442957x"], V.search_input)
    assert [(r.kind, r.value) for r in got] == [("isbn", "9780141439518"), ("gutenberg", "42"), ("title", "#0"), ("title", "some title"), ("isbn", "080442957X")]
    urls = {"https://a.example/x": True, "http://8.8.8.8/": True, "ftp://a.example/": False, "https://u:p@a.example/": False, "http://localhost:1/": False, "http://10.1.2.3/": False, "http://172.16.0.1/": False, "http://172.32.0.1/": True, "http://169.254.0.1/": False, "http://224.0.0.1/": False, "http://[::1]/": False, "http://[fd00::1]/": False, "http://[2001:db8::1]/": True, "nothing": False, "": False}
    assert column(spark, list(urls), V.public_url) == list(urls.values())
    assert column(spark, [None], V.public_url) == [False]


def test_preprocess(spark):
    page = "x\r\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\r\nTITLE\r\n \r\nCONTENTS\r\n\r\nChapter 1\r\nChapter 2\r\n\r\nChapter 1\r\n\r\nIt was so. And on.\r\n\r\n\r\n\r\nChapter 2\r\n\r\nMore of it. Yes.\r\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\r\ny"
    body = "Chapter 1\n\nIt was so. And on.\n\nChapter 2\n\nMore of it. Yes."
    many = "CONTENTS\n\n" + "\n\n".join(f"Chapter {k}" for k in range(1, 200)) + "\n\nProse it is. And on."  # beyond the first blocks
    assert column(spark, [page, body, many, "", None], T.preprocess) == [body, body, "Prose it is. And on.", "", None]


def test_trees_for_display(spark):
    d = spark.createDataFrame([(1, "1", "A", 10, 2), (1, "1.2", "C", 4, 0), (1, "1.10", "D", 0, 0), (1, "2", "E", None, None)], "doc long, path string, text string, words long, sentences long")
    at = {r.path: (r.order, r.depth, r.open) for r in N.path_index(d).collect()}
    assert at == {"1": (1, 1, True), "1.2": (2, 2, False), "1.10": (3, 2, False), "2": (4, 1, True)}
    rows = {r.id: (r.parent, r.words, r.avg_words) for r in N.as_nodes(d).collect()}
    assert rows == {"n1": (None, 10, 5.0), "n1.2": ("n1", 4, 4.0), "n1.10": ("n1", 0, 0.0), "n2": (None, 0, 0.0)}


def test_values_of_references(spark):
    cases = [(("d", "1", ["a"], "word", 1, 2), None), ((None, None, [], None, None, None), "at least one section is required"), ((None, "1", ["a"], None, None, None), "a version requires a corpus id"), (("a/b", None, ["a"], None, None, None), "corpus id contains a reserved delimiter"), (("", None, ["a"], None, None, None), "corpus id contains a reserved delimiter"), (("d", "1:", ["a"], None, None, None), "version contains a reserved delimiter"), (("d", None, ["a"], None, 1, None), "an index requires a unit type"), (("d", None, ["a"], "word", 0, None), "selector indices are 1-based"), (("d", None, ["a"], "word", None, None), "selector indices are 1-based"), (("d", None, ["a"], "word", 3, 2), "range end precedes its start")]
    d = spark.createDataFrame([(k, *v) for k, (v, _) in enumerate(cases)], "k int, c string, v string, s array<string>, o string, a int, b int")
    got = {r.k: r.e for r in d.select("k", R.value_error(*(F.col(x) for x in "cvsoab")).alias("e")).collect()}
    assert [got[k] for k in range(len(cases))] == [e for _, e in cases]
    sections = spark.createDataFrame([(1, ["V"]), (2, ["V", "3"])], "node long, path array<string>")
    asked = R.parse(spark.createDataFrame([("V:3",), ("V:4:5",), ("X:3",), ("V",), ("",)], "ref string"))
    assert {r.ref: r.depth for r in R.missing_depth(asked, sections, "ref").collect()} == {"V:3": None, "V:4:5": 2, "X:3": 1, "V": None}


def test_units_belong_to_the_innermost_section_of_their_first_slot(spark):
    nodes = spark.createDataFrame([(10, "word"), (11, "clause"), (12, "word")], "node long, otype string")
    slots = spark.createDataFrame([(10, 3), (11, 4), (11, 2), (99, 1)], "node long, slot long")
    section_slots = spark.createDataFrame([(1, k) for k in range(1, 5)] + [(2, 1), (2, 2), (3, 3), (3, 4)], "section long, slot long")
    sections = spark.createDataFrame([(1, ["V"]), (2, ["V", "1"]), (3, ["V", "2"])], "node long, path array<string>")
    assert sorted((r.node, r.path) for r in R.anchored_units(nodes, slots, section_slots, sections).collect()) == [(10, ["V", "2"]), (11, ["V", "1"])]
