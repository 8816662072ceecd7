"""Blocks, section trees, EPUB and layout."""

import pytest
from pyspark.sql import functions as F

from textlattice.operators import blocks as K, documents as O, layout as L, sections as S
from textlattice.plans.format_queries import make_epub
from textlattice.sources.epub import epub_parts, parts

MARKDOWN = """---
title: x
---
Opening words here.

# Paper

See [a](http://a.example) and <http://b.example>. A second sentence.

## Method

- one
- two
  - inner one
- three

> quoted words
> go on

```python
code = 1
```

| a | b |
|---|---|
| 1 | 2 |

![pic](p.png)

### Detail

Text[^1] with http://c.example in it.

[^1]: The note.

References
----------

1. First work.
2. Second work.
"""


def kinds(out):
    return [r[1] for r in out.rows]


def nested(out, at=None):
    """Types as a tree: (type, [those inside])."""
    return [(r[1], nested(out, k)) for k, r in enumerate(out.rows) if r[0] == at]


def test_markdown_blocks():
    out = K.markdown_outline(MARKDOWN)
    assert kinds(out) == ["paragraph", "heading", "paragraph", "heading", "list", "list_item", "list_item", "list", "list_item", "list_item", "blockquote", "paragraph", "code_block", "table", "figure", "heading", "paragraph", "footnote", "heading", "list", "list_item", "list_item"]
    assert [r[2] for r in out.rows if r[1] == "heading"] == [1, 2, 3, 2] and sum(r[4] for r in out.rows) == 3
    assert out.rows[2][3] == "See a and . A second sentence."
    assert out.inside()[8] == ["list", "list_item", "list"] and out.inside()[11] == ["blockquote"]


@pytest.mark.parametrize("text", ["", "\n\n", "- ", "#", "```", "> ", "| a |", "[^x]:", "    code", "- a\n\n\n- b", "1) x\n   y\n2) z", "=====", "a\n=", "\t", "> > > deep", "* * *", "-\n-", "> \n\n> ", "- a\n> b\nc", "  - x\n- y\n   - z", "[a]: b\nc", "|-\n-|-"])
def test_odd_inputs(text):
    for parse in K.PARSERS.values():
        assert all(len(r) == 7 for r in K.rows_of(parse(text)))


@pytest.mark.parametrize(
    ("md", "want"),
    [
        # a plain line goes on with a quoted paragraph, wherever it is open
        ("> Quoted\nlazy line", [("blockquote", [("paragraph", [])])]),
        ("> > nested\nlazy", [("blockquote", [("blockquote", [("paragraph", [])])])]),
        ("> - item\nlazy", [("blockquote", [("list", [("list_item", [])])])]),
        # what begins a block, or follows something else than a paragraph, ends the quote
        ("> Quoted text.\n# Next", [("blockquote", [("paragraph", [])]), ("heading", [])]),
        ("> Quoted\n- item", [("blockquote", [("paragraph", [])]), ("list", [("list_item", [])])]),
        ("> Quoted\n```\ncode\n```", [("blockquote", [("paragraph", [])]), ("code_block", [])]),
        ("> Quoted\n---", [("blockquote", [("paragraph", [])])]),
        ("> # Quote title\nNot lazy.", [("blockquote", [("heading", [])]), ("paragraph", [])]),
        ("> ```\n> code\nafter", [("blockquote", [("code_block", [])]), ("paragraph", [])]),
        ("> Title\n> ===\nafter", [("blockquote", [("heading", [])]), ("paragraph", [])]),
        # indented code goes before list marks, but not within a list
        ("    - not a list\n    - still code", [("code_block", [])]),
        ("Intro.\n\n    1. not a list", [("paragraph", []), ("code_block", [])]),
        ("- a\n  - b", [("list", [("list_item", [("list", [("list_item", [])])])])]),
        ("1. a\n\n    - b", [("list", [("list_item", [("list", [("list_item", [])])])])]),
        ("a\nb\n===\nc", [("heading", []), ("paragraph", [])]),
        ("# T\n\n```\ncode\n\n# none\n", [("heading", []), ("code_block", [])]),
    ],
)
def test_markdown_nesting(md, want):
    assert nested(K.markdown_outline(md)) == want


@pytest.mark.parametrize(("md", "links"), [("# [T](https://e.org)", 1), ("## See <https://a.b> and https://c.d", 2), ("[T](https://e.org) [x][ref]\n===", 2), ("Plain\n---", 0), ("![i](https://a.b) <mailto:x@y>", 1)])
def test_markdown_links(md, links):
    assert sum(r[4] for r in K.markdown_outline(md).rows) == links


def test_html_blocks():
    page = "<html><head><title>x</title></head><body><p>In &amp; out <a href='/a'>l</a><h1>T</h1><ul><li>one<li>two<ul><li>in</ul></ul><blockquote><p>q</p></blockquote><table><tr><td>c</td></tr></table><figure><img src=x></figure><img src=y><pre>code</pre><h3>Deep</h3><p class=footnote>n</p><script>x</script></body>"
    out = K.html_outline(page)
    assert kinds(out) == ["paragraph", "heading", "list", "list_item", "list_item", "list", "list_item", "blockquote", "paragraph", "table", "figure", "figure", "code_block", "heading", "footnote"]
    assert out.rows[0][3] == "In & out l" and out.rows[0][4] == 1 and [r[2] for r in out.rows if r[1] == "heading"] == [1, 3]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("one<br>two", [(None, "paragraph", None, "one two", 0)]),
        ("<li><p>a b</p><p>c d</p></li><li></li>", [(None, "list_item", None, "a b c d", 0), (None, "list_item", None, "", 0)]),
        ("<blockquote><h2>q</h2><p>x</p></blockquote>", [(None, "blockquote", None, "", 0), (0, "heading", 2, "q", 0), (0, "paragraph", None, "x", 0)]),
        ("<div role=doc-endnote>n</div>", [(None, "footnote", None, "n", 0)]),
        ("<p id=fn1>m</p><aside id=endnote-2>o</aside><div class='x endnote'>p</div>", [(None, "footnote", None, "m", 0), (None, "footnote", None, "o", 0), (None, "footnote", None, "p", 0)]),
        ("<p class=no-footnotes>z</p><p id=function>y</p>", [(None, "paragraph", None, "z", 0), (None, "paragraph", None, "y", 0)]),
        ("<p role=doc-biblioentry>r <a href=/>l</a></p>", [(None, "reference", None, "r l", 1)]),
        ("<svg><text>gone</text></svg><iframe>gone</iframe><math>x</math>kept", [(None, "paragraph", None, "kept", 0)]),
        ("<dl><dt>t</dt><dd>d</dd></dl><address>a</address>", [(None, "paragraph", None, x, 0) for x in "tda"]),
        ("<table><tr><td><a href=/>x</a><table><tr><td>in</td></tr></table></td></tr></table>after", [(None, "table", None, "", 1), (0, "table", None, "", 0), (None, "paragraph", None, "after", 0)]),
        ("<figure><img src=x><figcaption>c</figcaption></figure>", [(None, "figure", None, "", 0)]),
        ("<h1>Title<p>Open paragraph.<ul><li>item</ul></li></div></span><h2>Next", [(None, "heading", 1, "Title", 0), (None, "paragraph", None, "Open paragraph.", 0), (None, "list", None, "", 0), (2, "list_item", None, "item", 0), (None, "heading", 2, "Next", 0)]),
        ("<a>no link</a> <a href=''>none</a> <a href=/>one</a>", [(None, "paragraph", None, "no link none one", 1)]),
    ],
)
def test_html_rules(page, want):
    assert [tuple(r) for r in K.html_outline(page).rows] == want


def test_text_blocks():
    text = "Title\n=====\nSub\n---\nprose here\n\n- a\n  - b\n    more\n  - c\n- d http://x.y\n\n> 1.2 Head\n>\n> - x\n\n[^1]: note http://a.b\nend\n\na | b\nc | d\n\nFigure 3. Shown\n\nALL CAPS\n\n1. one"
    out = K.text_outline(text)
    assert [(r[1], i) for r, i in zip(out.rows, out.inside(), strict=True)] == [
        ("heading", []), ("heading", []), ("paragraph", []), ("list", []), ("list_item", ["list"]), ("list", ["list", "list_item"]), ("list_item", ["list", "list_item", "list"]), ("list_item", ["list", "list_item", "list"]), ("list_item", ["list"]),
        ("blockquote", []), ("heading", ["blockquote"]), ("list", ["blockquote"]), ("list_item", ["blockquote", "list"]), ("footnote", []), ("table", []), ("figure", []), ("heading", []), ("list", []), ("list_item", ["list"]),
    ]
    assert [r[3] for r in out.rows if r[1] in ("list_item", "footnote")] == ["a", "b more", "c", "d http://x.y", "x", "note http://a.b end", "one"]
    assert [r[2] for r in out.rows if r[1] == "heading"] == [1, 2, 2, 1] and sum(r[4] for r in out.rows) == 2


def test_only_root_headings_open_sections(spark):
    md = spark.createDataFrame([(1, "> # Quoted\n> words here\n\nmore"), (2, "# References\n\nOne work.\n\n- Two\n  - Three\n\n> Four\n\n| a |\n|---|\n\n# Notes\n\nA note here.")], "id long, md string")
    docs = {r.doc: r for r in S.analyze(K.markdown_blocks(md, "id", "md")).collect()}
    assert (docs[1].n_heading, docs[1].sections, docs[1].max_depth, docs[1].n_paragraph) == (1, 1, 1, 2)
    assert (docs[2].n_reference, docs[2].n_footnote, docs[2].n_list_item, docs[2].n_paragraph, docs[2].words) == (4, 1, 0, 0, 3)


def test_analyze_documents(spark):
    files = [
        (1, b"# Paper\n\nSome words here. And more.\n\n- [l](http://a.b)", "text/markdown", None),
        (2, b"<h1>Page</h1><p>One two.</p>", None, "a/b.HTML?x=1"),
        (3, b"TITLE\n\nplain words", "text/plain; charset=utf-8", None),
        (4, b"", "text/plain", None),
        (5, b"x", "image/png", "x.png"),
        (6, b"%PDF-1.4", "application/pdf", None),
        (7, b"a\x00b", "text/plain", None),
        (8, None, "text/html", None),
        (9, "Übung é.".encode("latin-1"), "text/plain", None),
    ]
    d = spark.createDataFrame(files, "doc long, content binary, content_type string, name string")
    out = {r.doc: r for r in O.analyze_documents(d).collect()}
    assert [out[k].format for k in range(1, 10)] == ["markdown", "html", "text", "text", None, "pdf", "text", "html", "text"]
    assert [out[k].error for k in range(1, 10)] == [None, None, None, None, O.UNSUPPORTED, O.NO_RUNS, O.BINARY, None, None]
    assert (out[1].title, out[1].n_heading, out[1].n_paragraph, out[1].n_list_item, out[1].n_link, out[1].sentences, out[1].words, out[1].sections, out[1].max_depth) == ("Paper", 1, 1, 1, 1, 3, 6, 1, 1)
    assert (out[2].title, out[2].words, out[2].content_type, out[3].title, out[3].words) == ("Page", 2, "text/html", "TITLE", 2)
    assert (out[4].sections, out[4].words, out[4].title, out[8].sections, out[8].size_bytes, out[5].sections) == (0, 0, None, 0, 0, None)
    assert out[9].words == 0 and out[9].n_paragraph == 1 and out[1].sha256 and out[1].size_bytes == len(files[0][1])
    detail = [(r.doc, r.sentence, r.words, r.clauses) for r in O.document_detail(d).where("doc = 1").orderBy("pos", "sentence").collect()]
    assert detail == [(1, 1, 3, 1), (1, 2, 2, 1), (1, 1, 1, 1)]
    assert O.analyze_documents(d.limit(0)).collect() == []


def test_section_tree(spark):
    md = spark.createDataFrame([(1, MARKDOWN), (2, "no heading. At all."), (3, ""), (4, None), (5, "# A\n\n### B\n\n## C\n\n# D")], "id long, md string")
    b = K.markdown_blocks(md, "id", "md").cache()
    h = S.paths(S.headings(b))
    tree = {(r.doc, r.text): (r.path, r.level) for r in h.collect()}
    assert tree[1, "Paper"] == ("1", 1) and tree[1, "Method"] == ("1.1", 2) and tree[1, "Detail"] == ("1.1.1", 3) and tree[1, "References"] == ("1.2", 2)
    assert [tree[5, x][0] for x in "ABCD"] == ["1", "1.1", "1.2", "2"]
    own = S.counts(S.retyped(b)).cache()
    docs = {r.doc: r for r in S.document_totals(own, S.headings(b)).collect()}
    assert set(docs) == {1, 2, 5}
    one = docs[1]
    assert (one.n_heading, one.n_list, one.n_list_item, one.n_table, one.n_figure, one.n_code_block, one.n_blockquote, one.n_footnote, one.n_reference, one.n_link, one.sections, one.max_depth) == (4, 3, 4, 1, 1, 1, 1, 1, 2, 3, 5, 3)
    assert (docs[2].sections, docs[2].max_depth, docs[2].sentences) == (1, 1, 2)
    total = {(r.doc, r.section): r.words for r in S.totals(own, S.headings(b)).collect()}
    first = min(r.pos for r in b.where("doc = 1 AND type = 'heading'").collect())
    assert total[1, first] + total[1, S.PREAMBLE] == one.words


def test_text_chunks(spark):
    cases = {
        "Title\n=====\nmore": "heading", "> a\n> b": "blockquote", "[^1]: note": "footnote", "- a\n- b": "list", "1. a": "list", "a | b\nc | d": "table", "a\tb\nc\td": "table", "Figure 3 shows": "figure",
        "1.2 Results": "heading", "ALL CAPS": "heading", "Just a line.": "paragraph", "two\nlines": "paragraph",
    }
    for r in spark.createDataFrame([(k, v) for k, v in cases.items()], "c string, want string").select("*", K.chunk_type(F.col("c")).alias("got")).collect():
        assert r.got == r.want, r.c
    (r,) = spark.createDataFrame([("\n \na  \r\nb\n\n\n\nc\n",)], "t string").select(K.text_chunks(F.col("t")).alias("c")).collect()
    assert r.c == ["a\nb", "c"]


def test_epub(spark):
    good = make_epub("A Title", ["one two", "three &amp; four"])
    rows = parts(good)
    assert [(r["title"], r["language"], r["pos"], r["text"]) for r in rows] == [("A Title", "en", 0, "Chapter 1\n\none two"), ("A Title", "en", 1, "Chapter 2\n\nthree & four")]
    for bad in (None, b"", b"PK junk", good[:100], good.replace(b"application/epub+zip", b"application/xxxx+zip")):
        assert parts(bad)[0].get("error")
    out = epub_parts(spark.createDataFrame([("p", good), ("q", None)], "path string, content binary")).collect()
    assert sorted((r.path, r.pos) for r in out if r.error is None) == [("p", 0), ("p", 1)] and len(out) == 3


def laid_out(spark, rows):
    d = spark.createDataFrame(rows, "doc long, page int, run_pos int, size double, y double, text string")
    return [(r.type, r.level, r.text) for r in L.blocks(L.lines(d)).orderBy("pos").collect()]


def test_layout(spark):
    rows = [(1, 1, 0, 20.0, 700.0, "A Big "), (1, 1, 1, 20.0, 699.5, "Title"), (1, 1, 2, 11.0, 680.0, "It was a long hyphen-"), (1, 1, 3, 11.0, 666.0, "ated line."), (1, 1, 4, 11.0, 630.0, "Next one goes over"), (1, 1, 5, 9.0, 20.0, "Page 1 of 9"), (1, 2, 0, 11.0, 700.0, "the page."), (1, 2, 1, 16.0, 650.0, "Sub"), (1, 2, 2, 11.0, 630.0, "End.")]
    assert laid_out(spark, rows) == [("heading", 1, "A Big Title"), ("paragraph", None, "It was a long hyphenated line."), ("paragraph", None, "Next one goes over the page."), ("heading", 2, "Sub"), ("paragraph", None, "End.")]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        # runs drift by less than a point each, but the third is over one from the line's first
        ([(11.0, 700.0, "one "), (11.0, 699.2, "two"), (11.0, 698.4, "three.")], [("paragraph", None, "one two three.")]),
        # line breaks within a run, blank ones too
        ([(11.0, 700.0, "- a\n- b"), (11.0, 699.5, " more\n \n- c")], [("list", None, ""), ("list_item", None, "a"), ("list_item", None, "b more"), ("list_item", None, "c")]),
        # sizes count to half points; a heading wraps within 1.6 sizes, not beyond
        ([(16.1, 700.0, "Long"), (15.9, 682.0, "heading"), (16.0, 600.0, "Other"), (11.0, 580.0, "Body text that is the longest of all lines here.")], [("heading", 1, "Long heading"), ("heading", 1, "Other"), ("paragraph", None, "Body text that is the longest of all lines here.")]),
        # without a known gap 1.2 body sizes; a line that stands higher begins a column
        ([(10.0, 700.0, "First line of it"), (20.0, 690.0, "Head"), (10.0, 650.0, "Second one here"), (10.0, 690.0, "Third one here")], [("paragraph", None, "First line of it"), ("heading", 1, "Head"), ("paragraph", None, "Second one here"), ("paragraph", None, "Third one here")]),
        # groups are read as plain text, but for headings
        ([*((10.0, 760.0 - 12 * k, "x") for k in range(5)), (10.0, 660.0, "ALL CAPS HERE"), (10.0, 610.0, "Figure 2 shows it"), (10.0, 560.0, "[^1]: a note"), (10.0, 510.0, "> quoted")], [("paragraph", None, "x x x x x"), ("paragraph", None, "ALL CAPS HERE"), ("figure", None, ""), ("footnote", None, "a note"), ("blockquote", None, ""), ("paragraph", None, "quoted")]),
    ],
)
def test_layout_rules(spark, rows, want):
    assert laid_out(spark, [(1, 1, k, *r) for k, r in enumerate(rows)]) == want


def test_pdf_runs_hold_whole_sentences(spark, tmp_path):
    from textlattice.plans import format_queries as Q

    rows = [(1, "One sentence that is a good deal longer than forty characters, so that a prefix shows. Two"), (2, "ab. " + "word " * 300 + ". x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    runs = Q.pdf_runs(spark, str(tmp_path)).orderBy("doc", "run_pos").collect()
    assert {k: "".join(r.text for r in runs if r.doc == k) for k, _ in rows} == {k: t.replace(". ", "") for k, t in rows}
    words = {}
    for r in Q.pdf_blocks(spark, str(tmp_path)).collect():
        words[r.doc] = words.get(r.doc, 0) + r.words
    assert words == {1: 17, 2: 302}
