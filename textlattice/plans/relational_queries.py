"""Catalog, library and reference queries with their oracles.

The catalog is a view of documents, the library one of the order tables, the corpus
one of conversations (volume = conversation, section = turn, units = words and clauses).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from textlattice.functions import text as T, values as V
from textlattice.operators import catalog as C, library as L, payloads as J, refs as R
from textlattice.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}
TODAY = date(2026, 1, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- catalog

_TYPES = ["book", "article", "preprint", "review", "dissertation", "report", "other", "dataset"]
_CATALOG = f"""catalog AS (SELECT CASE doc_id % 2 WHEN 0 THEN 'gutendex' ELSE 'openalex' END AS source, doc_id AS id, text AS title, lang AS language,
    CAST(date '2026-01-01' - CAST(doc_id % 500 AS INT) AS DATE) AS publication_date, {{pick}} AS kind, {{array}} AS categories, '978' || lpad(CAST(doc_id AS VARCHAR(20)), 10, '0') AS isbn FROM documents)"""
_CATALOG_SQL = _CATALOG.format(pick=f"list_extract({_TYPES}, CAST(doc_id % 8 + 1 AS INT))", array="['subject:s' || (doc_id % 5), 'domain:' || (doc_id % 4 + 1)]")


def catalog_view(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        F.when(i % 2 == 0, "gutendex").otherwise("openalex").alias("source"), i.alias("id"), F.col("text").alias("title"), F.col("lang").alias("language"),
        F.date_sub(F.lit(TODAY), (i % 500).cast("int")).alias("publication_date"), F.element_at(F.array(*map(F.lit, _TYPES)), (i % 8 + 1).cast("int")).alias("kind"),
        F.array(F.concat(F.lit("subject:s"), (i % 5).cast("string")), F.concat(F.lit("domain:"), (i % 4 + 1).cast("string"))).alias("categories"),
        F.concat(F.lit("978"), F.lpad(i.cast("string"), 10, "0")).alias("isbn"),
    )


def _page(where: str, n: int, columns: str = "source, id, total") -> str:
    return f"""WITH {_CATALOG_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS rank, count(*) OVER (PARTITION BY source) AS total FROM catalog WHERE {where})
        SELECT {columns} FROM (SELECT * FROM m WHERE rank > {(n - 1) * 32} AND rank <= {n * 32})"""


@query(_page("contains(lower(title), 'th')", 2, "source, id, total, CAST(CASE source WHEN 'gutendex' THEN 1 ELSE 2 END AS BIGINT) AS provider_ord, CASE WHEN max(total) OVER () > 64 THEN 3 END AS next_page"))
def federated_search(spark, sf_dir):
    return C.search_catalog(catalog_view(spark, sf_dir), 2, query="th").select("source", "id", "total", F.col("provider_ord").cast("long"), "next_page")


@query(f"WITH {_CATALOG_SQL} SELECT source, id FROM catalog WHERE kind IN ('book', 'article', 'preprint', 'review', 'dissertation', 'report', 'conference-paper') AND publication_date BETWEEN DATE '2025-01-02' AND DATE '2026-01-01' AND list_has_any(categories, ['subject:s1', 'domain:3']) AND language IN ('en', 'de')")
def filter_algebra(spark, sf_dir):
    return catalog_view(spark, sf_dir).where(C.matches(kinds=["book", "academic"], dates=["7days", "year"], categories=["subject:s1", "domain:3"], languages=["en", "de"], today=TODAY)).select("source", "id")


@query(f"WITH {_CATALOG_SQL}, w(win, days) AS (VALUES ('today', 0), ('7days', 6), ('30days', 29), ('year', 364)) SELECT win, count(*) AS n FROM catalog JOIN w ON publication_date BETWEEN DATE '2026-01-01' - days AND DATE '2026-01-01' GROUP BY win")
def date_windows(spark, sf_dir):
    d = catalog_view(spark, sf_dir)
    return d.agg(*(F.count_if(C.matches(dates=[k], today=TODAY)).alias(k) for k in C.WINDOWS)).unpivot([], [f"`{k}`" for k in C.WINDOWS], "win", "n")


@query(f"WITH {_CATALOG_SQL} SELECT kind, count(*) AS n FROM catalog WHERE kind IN ('article', 'preprint', 'review', 'dissertation', 'report', 'conference-paper', 'other') GROUP BY kind")
def kind_filter(spark, sf_dir):
    return catalog_view(spark, sf_dir).where(C.matches(kinds=["academic", "other"])).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {_CATALOG_SQL} SELECT id FROM catalog WHERE list_has_any(categories, ['subject:s2', 'domain:1'])")
def category_filter(spark, sf_dir):
    return catalog_view(spark, sf_dir).where(C.matches(categories=["subject:s2", "domain:1"])).select("id")


@query(_page("language = 'en'", 3))
def page_slice(spark, sf_dir):
    return C.page_of(catalog_view(spark, sf_dir).where("language = 'en'"), 3, ["source"], ["id"]).select("source", "id", "total")


@query(f"WITH {_CATALOG_SQL}, m AS (SELECT id, title, count(*) OVER (PARTITION BY title) AS n, row_number() OVER (PARTITION BY title ORDER BY id) AS rank FROM catalog) SELECT sha256(title) AS title, id, n, CASE WHEN n = 1 THEN 'book' ELSE 'choice' END AS outcome FROM m WHERE rank <= 10")
def disambiguate(spark, sf_dir):
    return C.disambiguate(catalog_view(spark, sf_dir), ["title"]).select(F.sha2("title", 256).alias("title"), "id", "n", "outcome")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'b' || doc_id WHEN 1 THEN 'c' || doc_id WHEN 2 THEN 'd' || doc_id END AS url FROM documents")
def pick_format(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    m = lambda *kv: F.create_map(*(F.concat(F.lit(v), i) if k % 2 else F.lit(v) for k, v in enumerate(kv)))
    formats = F.when(F.col("doc_id") % 4 == 0, m("text/html", "a", "text/plain", "b")).when(F.col("doc_id") % 4 == 1, m("application/zip", "x", "text/rtf", "c")).when(F.col("doc_id") % 4 == 2, m("image/png", "x", "text/html; charset=utf-8", "d")).otherwise(m("text/x-zip", "z", "image/png", "x"))
    return table(spark, sf_dir, "documents").select("doc_id", C.pick_format(formats).alias("url"))


@query("SELECT doc_id, lang FROM documents WHERE list_has_any([lang, source], string_split('fr,es', ','))")
def lang_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(V.any_language(F.array("lang", "source"), F.lit("fr,es"))).select("doc_id", "lang")


# a provider's pages: 32 documents a page, some with a record that isn't valid

_GUTENDEX_BAD, _OPENALEX_BAD = "n % 7 = 3 OR n % 7 = 5", "n % 5 = 1 OR n % 5 = 3 OR n % 5 = 4"


def _provider_pages(spark, sf_dir, record: str, page: str) -> DataFrame:
    """payload, page: the record expression of each document, gathered by its page expression."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id DIV 32 AS n", "doc_id", f"{record} AS r").groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "r"))), lambda x: x["r"]).alias("results"))
    return d.selectExpr(f"to_json({page}) AS payload", "CAST(n + 1 AS INT) AS page")


@query(f"""SELECT CAST(doc_id // 32 + 1 AS INT) AS page, CAST(NULL AS VARCHAR) AS error, 'g' || CAST(doc_id + 1 AS VARCHAR) AS id, sha256(text) AS title, CASE WHEN doc_id % 2 = 0 THEN 'Ann, Bob' ELSE '' END AS authors, lang || ',xx' AS language, 'subject:' || source AS categories FROM (SELECT *, doc_id // 32 AS n FROM documents) WHERE NOT ({_GUTENDEX_BAD}) AND text <> ''
    UNION ALL SELECT DISTINCT CAST(n + 1 AS INT), 'invalid catalog metadata', NULL, NULL, NULL, NULL, NULL FROM (SELECT doc_id // 32 AS n FROM documents) WHERE {_GUTENDEX_BAD}""")
def catalog_gutendex(spark, sf_dir):
    record = "named_struct('id', CASE WHEN doc_id DIV 32 % 7 = 3 AND doc_id % 32 = 0 THEN 0 ELSE doc_id + 1 END, 'title', text, 'authors', CASE WHEN doc_id % 2 = 0 THEN array(named_struct('name', 'Ann'), named_struct('name', 'Bob')) ELSE array() END, 'languages', array(lang, 'xx'), 'subjects', array(source))"
    page = "named_struct('count', CASE WHEN n % 7 = 5 THEN -1 ELSE 1000000000 END, 'next', CAST(NULL AS STRING), 'results', results)"
    d = J.gutendex(_provider_pages(spark, sf_dir, record, page))
    return d.select("page", "error", F.concat(F.lit("g"), "id").alias("id"), F.sha2("title", 256).alias("title"), F.when(F.col("error").isNull(), F.array_join("authors", ", ")).alias("authors"), F.when(F.col("error").isNull(), F.col("language")).alias("language"), F.when(F.col("error").isNull(), F.array_join("categories", ",")).alias("categories"))


@query(f"""SELECT CAST(doc_id // 32 + 1 AS INT) AS page, CAST(NULL AS VARCHAR) AS error, 'W' || CAST(doc_id + 1 AS VARCHAR) AS id, sha256(text) AS title, CAST(date '2020-01-01' + CAST(doc_id % 300 AS INT) AS DATE) AS publication_date, CASE WHEN doc_id % 3 > 0 THEN 'domain:' || (doc_id % 3) ELSE '' END AS categories FROM (SELECT *, doc_id // 32 AS n FROM documents) WHERE NOT ({_OPENALEX_BAD}) AND text <> ''
    UNION ALL SELECT DISTINCT CAST(n + 1 AS INT), 'invalid catalog metadata', NULL, NULL, NULL, NULL FROM (SELECT doc_id // 32 AS n FROM documents) WHERE {_OPENALEX_BAD}""")
def catalog_openalex(spark, sf_dir):
    record = "named_struct('id', concat(CASE WHEN doc_id DIV 32 % 5 = 1 AND doc_id % 32 = 0 THEN 'X' WHEN doc_id % 2 = 0 THEN 'https://openalex.org/W' ELSE 'W' END, doc_id + 1), 'display_name', text, 'authorships', array(named_struct('author', named_struct('display_name', 'Ann'))), 'publication_date', CASE WHEN doc_id DIV 32 % 5 = 3 AND doc_id % 32 = 0 THEN '2020-02-30' ELSE CAST(date_add(DATE '2020-01-01', CAST(doc_id % 300 AS INT)) AS STRING) END, 'type', 'article', 'primary_topic', CASE WHEN doc_id % 3 > 0 THEN named_struct('domain', named_struct('id', concat('https://openalex.org/domains/', doc_id % 3))) END)"
    page = "named_struct('meta', named_struct('count', 1000000000, 'page', CASE WHEN n % 5 = 4 THEN n + 2 ELSE n + 1 END, 'per_page', 32), 'results', results)"
    d = J.openalex(_provider_pages(spark, sf_dir, record, page))
    return d.select("page", "error", "id", F.sha2("title", 256).alias("title"), "publication_date", F.when(F.col("error").isNull(), F.array_join("categories", ",")).alias("categories"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'OL' || doc_id || 'W' END AS work, CASE WHEN doc_id % 3 = 1 THEN 'OL' || doc_id || 'M' END AS edition FROM documents")
def open_library_id(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    x = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/works/OL"), i, F.lit("W"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("OL"), i, F.lit("M"))).otherwise(F.concat(F.lit("/works/OL"), i, F.lit("W/x")))
    return table(spark, sf_dir, "documents").select("doc_id", V.open_library_id(x, "W").alias("work"), V.open_library_id(x, "M").alias("edition"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IS NOT NULL AS valid FROM events")
def parse_payload(spark, sf_dir):
    d = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return d.select("event_id", "p.k", F.col("p.k").isNotNull().alias("valid"))


_NORM = r"array_to_string(list_sort(regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')), ' ')"


@query(f"SELECT doc_id, {_NORM.format(x='text')} AS title FROM documents")
def norm_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.normal_title(F.col("text")).alias("title"))


_ISBN_TEXT = "CASE doc_id % 3 WHEN 0 THEN '978-0-14-' || lpad(CAST(doc_id * 7 % 1000000 AS VARCHAR(9)), 6, '0') || '-' || (doc_id % 10) WHEN 1 THEN lpad(CAST(doc_id * 7919 % 1000000000 AS VARCHAR(12)), 9, '0') || CASE WHEN doc_id % 11 = 10 THEN 'x' ELSE CAST(doc_id % 10 AS VARCHAR(2)) END ELSE text END"
_ISBN_OK = r"""CASE WHEN regexp_full_match(v, '\d{13}') AND list_sum(list_transform(range(1, 14), lambda i: CAST(substr(v, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 THEN v
    WHEN regexp_full_match(v, '\d{9}[\dX]') AND list_sum(list_transform(range(1, 11), lambda i: CASE WHEN substr(v, i, 1) = 'X' THEN 10 ELSE CAST(substr(v, i, 1) AS INT) END * (11 - i))) % 11 = 0 THEN v END"""


@query(f"SELECT doc_id, {_ISBN_OK} AS isbn FROM (SELECT doc_id, upper(regexp_replace({_ISBN_TEXT}, '[\\s-]', '', 'g')) AS v FROM documents)")
def isbn_check(spark, sf_dir):
    x = F.expr(_ISBN_TEXT.replace("|| (doc_id % 10)", "|| CAST(doc_id % 10 AS STRING)"))
    return table(spark, sf_dir, "documents").select("doc_id", C.valid_isbn(x).alias("isbn"))


@query("SELECT doc_id, nullif(regexp_replace(regexp_extract('urn:isbn:978-' || doc_id || ' 12345678-' || source, '(?i)(?:97[89][-\\s]?)?[\\d][-\\s\\d]{8,}[\\dXx]'), '[-\\s]', '', 'g'), '') AS isbn FROM documents")
def isbn_extract(spark, sf_dir):
    x = F.concat(F.lit("urn:isbn:978-"), F.col("doc_id").cast("string"), F.lit(" 12345678-"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", V.isbn_in(x).alias("isbn"))


@query("SELECT doc_id, regexp_full_match(w, 'W[1-9][0-9]*') AS work_ok, try_cast(d AS DATE) AS day FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'W0' ELSE 'W' END || doc_id AS w, '2024-' || lpad(CAST(doc_id % 14 AS VARCHAR(3)), 2, '0') || '-' || lpad(CAST(doc_id % 33 AS VARCHAR(3)), 2, '0') AS d FROM documents)")
def validate_ids(spark, sf_dir):
    i = F.col("doc_id")
    w = F.concat(F.when(i % 3 == 0, "W0").otherwise("W"), i.cast("string"))
    d = F.concat(F.lit("2024-"), F.lpad((i % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((i % 33).cast("string"), 2, "0"))
    return table(spark, sf_dir, "documents").select("doc_id", V.is_work_id(w).alias("work_ok"), V.iso_day(d).alias("day"))


@query("SELECT doc_id, lower(split_part(trim(' ' || upper(lang) || '-GB '), '-', 1)) AS language FROM documents")
def language_subtag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.language_subtag(F.concat(F.lit(" "), F.upper("lang"), F.lit("-GB "))).alias("language"))


_INPUT = "CASE doc_id % 4 WHEN 0 THEN ' 978-0-14-143951-' || (doc_id % 10) WHEN 1 THEN '##' || doc_id WHEN 2 THEN '0' ELSE '  ' || text || ' ' END"


@query(rf"""SELECT doc_id, CASE WHEN regexp_full_match(c, '\d{{13}}|\d{{9}}[\dXx]') THEN 'isbn' WHEN regexp_full_match(g, '\d+') AND try_cast(g AS BIGINT) > 0 THEN 'gutenberg' ELSE 'title' END AS kind,
    CASE WHEN regexp_full_match(c, '\d{{13}}|\d{{9}}[\dXx]') THEN upper(c) WHEN regexp_full_match(g, '\d+') AND try_cast(g AS BIGINT) > 0 THEN CAST(CAST(g AS BIGINT) AS VARCHAR) ELSE t END AS value
    FROM (SELECT doc_id, t, regexp_replace(t, '[\s-]', '', 'g') AS c, regexp_replace(t, '^#+', '') AS g FROM (SELECT doc_id, regexp_replace({_INPUT}, '^\s+|\s+$', '', 'g') AS t FROM documents))""")
def parse_search(spark, sf_dir):
    x = F.expr(_INPUT.replace("|| (doc_id % 10)", "|| CAST(doc_id % 10 AS STRING)").replace("|| doc_id ", "|| CAST(doc_id AS STRING) "))
    return table(spark, sf_dir, "documents").select("doc_id", V.search_input(x).alias("s")).select("doc_id", "s.kind", "s.value")


@query("SELECT page_id, CASE WHEN regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN u ELSE 'https://' || u END AS url, regexp_extract(u, '([^/?#]+)/?(?:[?#].*)?$', 1) AS name FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS u FROM pages)")
def normalize_url(spark, sf_dir):
    u = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", V.normal_url(u).alias("url"), V.url_name(u).alias("name"))


@query("SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN format('{:.1f} KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN format('{:.1f} MB', b / 1048576.0::DOUBLE) ELSE format('{:.1f} GB', b / 1073741824.0::DOUBLE) END AS size FROM (SELECT doc_id, n_chars * (doc_id % 1000) AS b FROM documents)")
def format_bytes(spark, sf_dir):
    b = F.col("n_chars") * (F.col("doc_id") % 1000)
    return table(spark, sf_dir, "documents").select("doc_id", V.shown_bytes(b).alias("size"))


_URLS = "CASE page_id % 8 WHEN 6 THEN 'http://[::1]/x' WHEN 5 THEN 'https://[2001:db8::1]:80/' WHEN 0 THEN 'http://127.0.0.1/' WHEN 1 THEN 'ftp://a.example/' WHEN 2 THEN 'https://u:p@a.example/' WHEN 3 THEN 'http://10.' || (page_id % 256) || '.0.1/x' WHEN 4 THEN 'https://192.168.1.1' ELSE url END"


@query(rf"""SELECT page_id, regexp_matches(u, '^https?://') AND NOT regexp_matches(u, '^[a-z]+://[^/?#]*@') AND NOT regexp_matches(u, '^[a-z]+://(?:0|10|127)\.\d+\.\d+\.\d+(?:[:/?#]|$)|^[a-z]+://(?:169\.254|192\.168)\.\d+\.\d+(?:[:/?#]|$)|^[a-z]+://172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+(?:[:/?#]|$)|^[a-z]+://(?:22[4-9]|2[3-5]\d)\.\d+\.\d+\.\d+(?:[:/?#]|$)|^[a-z]+://localhost(?:[:/?#]|$)|^[a-z]+://\[(?:::1?\]|::ffff:|f[cd]|fe[89ab]|ff)') AS allowed FROM (SELECT page_id, {_URLS} AS u FROM pages)""")
def url_policy(spark, sf_dir):
    u = F.expr(_URLS.replace("|| (page_id % 256)", "|| CAST(page_id % 256 AS STRING)"))
    return table(spark, sf_dir, "pages").select("page_id", V.public_url(u).alias("allowed"))


@query(f"""WITH b AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN lpad(CAST(p_partkey AS VARCHAR(13)), 13, '0') END AS raw, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END AS publisher, p_type AS author FROM part),
    k AS (SELECT *, CASE WHEN list_sum(list_transform(range(1, 14), lambda i: CAST(substr(raw, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 THEN raw END AS key, {_NORM.format(x='title')} AS t, {_NORM.format(x='author')} AS a FROM b),
    e AS (SELECT lpad(CAST(s_suppkey AS VARCHAR(13)), 13, '0') AS key, s_name AS ed, s_suppkey % 500 AS pages, 'OL' || s_suppkey || 'M' AS edition_id FROM supplier),
    w AS (SELECT CAST(c_custkey AS VARCHAR) AS work_id, {_NORM.format(x="CASE WHEN c_custkey % 200 = 10 THEN 'Ring, SMALL' ELSE 'x ' || c_name END")} AS t, {_NORM.format(x="CASE WHEN c_custkey = 10 THEN 'ECONOMY' ELSE c_mktsegment END")} AS a FROM customer),
    few AS (SELECT t FROM w GROUP BY t HAVING count(DISTINCT work_id) <= 10),
    o AS (SELECT k.id, min(w.work_id) AS work_id FROM k JOIN (SELECT * FROM w WHERE t IN (SELECT t FROM few)) w ON k.key IS NULL AND w.t = k.t AND w.a = k.a GROUP BY k.id HAVING min(w.work_id) = max(w.work_id))
    SELECT k.id, CASE WHEN ed IS NOT NULL THEN 'isbn' WHEN work_id IS NOT NULL THEN 'title_author' END AS match_method, work_id, coalesce(nullif(publisher, ''), ed) AS publisher, coalesce(CASE WHEN k.id % 3 = 0 THEN nullif(k.id % 2, 0) END, nullif(pages, 0)) AS number_of_pages, edition_id FROM k LEFT JOIN e ON e.key = k.key LEFT JOIN o ON o.id = k.id""")
def enrich_books(spark, sf_dir):
    i = F.col("p_partkey")
    books = table(spark, sf_dir, "part").select(i.alias("id"), F.col("p_name").alias("title"), F.array("p_type").alias("authors"), F.when(i % 4 == 0, F.lpad(i.cast("string"), 13, "0")).alias("isbn"), F.when(i % 5 == 0, F.col("p_brand")).otherwise("").alias("publisher"), F.when(i % 3 == 0, i % 2).alias("number_of_pages"))
    editions = table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 13, "0").alias("isbn"), F.col("s_name").alias("publisher"), (F.col("s_suppkey") % 500).alias("number_of_pages"), F.concat(F.lit("OL"), F.col("s_suppkey").cast("string"), F.lit("M")).alias("edition_id"))
    c = F.col("c_custkey")
    works = table(spark, sf_dir, "customer").select(c.cast("string").alias("work_id"), F.when(c % 200 == 10, "Ring, SMALL").otherwise(F.concat(F.lit("x "), F.col("c_name"))).alias("title"), F.array(F.when(c == 10, "ECONOMY").otherwise(F.col("c_mktsegment"))).alias("authors"))
    return C.enrich(books, editions, works)


# ---- library

_BOOKS = "book AS (SELECT o_orderkey AS id, o_orderkey % 2000 AS metadata_id, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS publisher_id, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 7 END AS schema_id, CASE WHEN o_orderkey % 2 = 0 THEN 'gutenberg' ELSE 'upload' END AS source, o_orderdate AS created_at FROM orders)"


def book_rows(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), (k % 2000).alias("metadata_id"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("publisher_id"), F.when(F.col("o_orderstatus") == "F", k % 7).alias("schema_id"), F.when(k % 2 == 0, "gutenberg").otherwise("upload").alias("source"), F.col("o_orderdate").alias("created_at"))


def author_rows(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position"), "l_suppkey")
    return li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("id", "position", F.col("s_name").alias("name"))


_AUTHORS = "author AS (SELECT l_orderkey AS id, list(s_name ORDER BY l_linenumber, s_name) AS authors FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey)"


@query(f"""WITH {_BOOKS}, {_AUTHORS} SELECT b.id, p_name AS title, c_name AS publisher, n_name AS schema, array_to_string(coalesce(a.authors, []), ' | ') AS authors FROM book b JOIN part ON p_partkey = metadata_id
    LEFT JOIN customer ON c_custkey = publisher_id LEFT JOIN nation ON n_nationkey = schema_id LEFT JOIN author a ON a.id = b.id""")
def library_list(spark, sf_dir):
    meta = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("metadata_id"), F.col("p_name").alias("title"))
    pub = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("publisher_id"), F.col("c_name").alias("publisher"))
    sch = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("schema_id"), F.col("n_name").alias("schema"))
    d = L.library_list(book_rows(spark, sf_dir), meta, pub, sch, L.ordered_names(author_rows(spark, sf_dir), "id", "position", "name"), "id")
    return d.select("id", "title", "publisher", "schema", F.array_join("authors", " | ").alias("authors"))


@query(f"WITH {_AUTHORS} SELECT id, array_to_string(authors, ' | ') AS authors FROM author")
def authors_ordered(spark, sf_dir):
    return L.ordered_names(author_rows(spark, sf_dir), "id", "position", "name").select("id", F.array_join("authors", " | ").alias("authors"))


@query(f"WITH {_BOOKS} SELECT id, created_at FROM book WHERE source = 'upload' ORDER BY created_at DESC, id LIMIT 100")
def recent_uploads(spark, sf_dir):
    return L.newest(book_rows(spark, sf_dir), 100, "upload").select("id", "created_at")


@query(f"WITH {_BOOKS} SELECT item_id AS request, b.id IS NOT NULL AS found, b.source, p_name AS title FROM benchmark LEFT JOIN book b ON b.id = item_id * 1000 LEFT JOIN part ON p_partkey = b.metadata_id")
def get_result(spark, sf_dir):
    r = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request"), (F.col("item_id") * 1000).alias("id"))
    return L.get_result(r, book_rows(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("metadata_id"), F.col("p_name").alias("title")))


@query("""WITH e AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier WHERE s_acctbal > 0), i AS (SELECT DISTINCT s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT id, name, false AS created FROM e UNION ALL SELECT sha256(name), name, true FROM i ANTI JOIN e USING (name)""")
def dim_upsert(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    return L.get_or_create(known, author_rows(spark, sf_dir), "name")


@query(f"WITH {_AUTHORS} SELECT id, unnest(range(0, len(authors))) AS position, unnest(authors) AS name FROM author")
def metadata_authors(spark, sf_dir):
    d = L.ordered_names(author_rows(spark, sf_dir), "id", "position", "name")
    return T.each(d, ["id"], "authors", "position", "name").withColumn("position", F.col("position").cast("long"))


@query("""WITH e AS (SELECT c_custkey AS key, TIMESTAMP '2020-01-01 00:00:00' AS created_at FROM customer), s AS (SELECT user_id AS key, arg_max(value, (ts, value)) AS value, min(ts) AS first_at, max(ts) AS updated_at, count(*) AS scans FROM events GROUP BY user_id)
    SELECT coalesce(e.key, s.key) AS key, coalesce(created_at, first_at) AS created_at, updated_at, value, coalesce(scans, 0) AS scans, CASE WHEN updated_at IS NULL THEN 'pending' ELSE 'scanned' END AS status FROM e FULL JOIN s ON e.key = s.key""")
def scan_merge(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    return L.merge_scans(known, table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value"))


@query("""SELECT 'fk orders.custkey' AS rule, count(*) AS violations FROM orders ANTI JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'fk lineitem.orderkey', count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'unique lineitem', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'check discount', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05
    UNION ALL SELECT 'check status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def integrity(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    li, o = t("lineitem"), t("orders")
    rules = {
        "fk orders.custkey": o.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "fk lineitem.orderkey": li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "unique lineitem": li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "check discount": li.where(~F.col("l_discount").between(0, 0.05)),
        "check status": o.where(~F.col("o_orderstatus").isin("F", "O")),
    }
    return L.integrity(rules)


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def owner_scope(spark, sf_dir):
    """What one owner sees: every read names its owner."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("user_id"))
    return L.scoped(rows, rows.agg(F.min("user_id")).first()[0]).select("id", "created_at")


@query("""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'unknown source' END, CASE WHEN o_orderkey % 7 = 0 THEN 'book.title is required' END, CASE WHEN o_orderkey % 11 = 0 THEN 'book.authors.name is required' END, CASE WHEN o_orderkey % 4 = 1 THEN 'format is required' END, CASE WHEN o_orderkey % 4 = 2 THEN 'unknown format' END,
    CASE WHEN o_orderkey % 3 = 1 THEN 'blob is incomplete' END, CASE WHEN o_orderkey % 6 = 5 THEN 'scan is required' END, CASE WHEN o_orderkey % 6 = 4 THEN 'unknown scan.scope' END, CASE WHEN o_orderstatus = 'P' THEN 'updated_at is required' END], lambda x: x IS NOT NULL), '; ') AS violations FROM orders""")
def validate_record(spark, sf_dir):
    k = F.col("o_orderkey")
    null = F.lit(None)
    author = F.struct(F.when(k % 11 != 0, "A").alias("name"))
    book = F.struct(F.when(k % 7 != 0, "T").alias("title"), F.array(F.struct(F.lit("B").alias("name")), author).alias("authors"))
    blob = F.when(k % 3 != 0, F.struct(F.lit("u").alias("url"), F.lit("p").alias("pathname"), F.when(k % 3 == 2, k).alias("size_bytes")))
    scan = F.when(k % 6 != 5, F.struct(F.lit(True).alias("scanned"), F.when(k % 6 == 4, "page").when(k % 6 == 3, "word").alias("scope")))
    fmt = F.when(k % 4 == 2, "pdf").when(k % 4 != 1, "epub")
    v = L.violations(F.when(k % 5 == 0, "kindle").otherwise("upload"), book, fmt.cast("string"), blob, scan, F.col("o_orderdate"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).otherwise(null))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(v, "; ").alias("violations"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS pages, o_orderkey % 3 = 0 AS scanned, o_orderdate AS created_at FROM orders""")
def public_view(spark, sf_dir):
    k, none = F.col("o_orderkey"), lambda kind: F.lit(None).cast(kind)
    scan = F.when(k % 3 == 0, F.struct(F.lit(True).alias("scanned")))
    flat = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.lit("upload").alias("source"), none("long").alias("gutenberg_id"), F.lit("epub").alias("format"), none("string").alias("blob"), F.col("o_orderpriority").alias("title"), F.array(F.lit("a")).alias("authors"), F.lit("en").alias("language"), F.array(F.lit("s")).alias("subjects"),
        none("string").alias("isbn"), none("string").alias("publisher"), none("string").alias("license"), none("string").alias("date"), F.when(k % 2 == 0, k).alias("numberOfPage"), none("string").alias("open_library"), scan.alias("scan"), F.col("o_orderdate").alias("createdAt"), F.col("o_orderdate").alias("updatedAt"), F.lit("internal").alias("_id"),
    )
    return L.public_view(flat).select("id", "book.title", F.col("book.number_of_pages").alias("pages"), "scan.scanned", "created_at")


_NOW = "TIMESTAMP '2024-01-01 12:00:00'"
_ACT = f"(SELECT event_id, CASE WHEN greatest(ts, ts - INTERVAL 400 DAY * (event_id % 3 - 1)) <= {_NOW} THEN greatest(ts, ts - INTERVAL 400 DAY * (event_id % 3 - 1)) END AS act FROM events)"


def activity_rows(spark, sf_dir) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    other = ts - F.make_dt_interval((F.lit(400) * (F.col("event_id") % 3 - 1)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", L.activity(now, ts, other).alias("at"), now.alias("now"))


@query(f"SELECT event_id, coalesce(CAST(act AS DATE) = DATE '2024-01-01', false) AS today, coalesce(act >= {_NOW} - INTERVAL 7 DAY, false) AS week, coalesce(act >= {_NOW} - INTERVAL 365 DAY, false) AS year FROM {_ACT}")
def match_date(spark, sf_dir):
    a, n = F.col("at"), F.col("now")
    return activity_rows(spark, sf_dir).select("event_id", L.matches_date(a, n, ["today"]).alias("today"), L.matches_date(a, n, ["7days"]).alias("week"), L.matches_date(a, n, ["year"]).alias("year"))


_KIND = """CASE doc_id % 6 WHEN 0 THEN ' Canon ' WHEN 1 THEN 'unknown' WHEN 2 THEN '' END AS explicit, CASE doc_id % 5 WHEN 0 THEN 'Gutenberg' WHEN 1 THEN 'openalex' WHEN 2 THEN 'kindle' WHEN 3 THEN 'document' END AS src,
    CASE doc_id % 7 WHEN 0 THEN 'canonical_scripture' WHEN 1 THEN 'essay_or_story_collection' WHEN 2 THEN 'flat' WHEN 3 THEN 'strange' END AS sch"""


@query(f"""SELECT doc_id, CASE WHEN lower(trim(explicit)) IN ('book', 'academic', 'canon', 'collection', 'other') THEN lower(trim(explicit)) WHEN coalesce(trim(explicit), '') = '' AND src = 'openalex' THEN 'academic'
    WHEN sch = 'canonical_scripture' THEN 'canon' WHEN sch = 'essay_or_story_collection' THEN 'collection' WHEN sch = 'flat' THEN 'book' WHEN sch IS NOT NULL THEN 'other' WHEN src IN ('Gutenberg', 'document') THEN 'book' ELSE 'other' END AS kind FROM (SELECT doc_id, {_KIND} FROM documents)""")
def record_kind(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", *(x.strip() + " AS " + n for x, n in ((p.rsplit(" AS ", 1)[0], p.rsplit(" AS ", 1)[1]) for p in _KIND.replace(", CASE", ",\n    CASE").split(",\n    "))))
    return d.select("doc_id", L.record_kind(F.col("explicit"), F.col("src"), F.col("sch")).alias("kind"))


@query(f"WITH {_CATALOG_SQL} SELECT id, list_contains(categories, 'subject:s3') OR list_contains(categories, 'domain:2') AS matched FROM catalog")
def match_category(spark, sf_dir):
    return catalog_view(spark, sf_dir).select("id", (F.array_contains("categories", "subject:s3") | F.array_contains("categories", "domain:2")).alias("matched"))


_MATCH = "contains(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), 'th an') OR contains(isbn, 'than') OR contains(lower(language), 'th an') OR len(list_filter(categories, lambda c: contains(c, 'th an'))) > 0 OR contains(CAST(id AS VARCHAR), 'th an')"


@query(f"WITH {_CATALOG_SQL} SELECT id, {_MATCH} AS matched FROM catalog")
def match_query(spark, sf_dir):
    c = L.matches_query(" TH  an", F.col("title"), F.col("isbn"), F.array("language"), F.col("categories"), F.col("id"))
    return catalog_view(spark, sf_dir).select("id", c.alias("matched"))


@query(f"WITH {_CATALOG_SQL} SELECT id, publication_date FROM catalog WHERE ({_MATCH.replace('th an', 'the').replace('than', 'the')}) AND kind IN ('book', 'article') AND source = 'gutendex' ORDER BY publication_date DESC NULLS LAST, id")
def library_search(spark, sf_dir):
    c = L.matches_query("the", F.col("title"), F.col("isbn"), F.array("language"), F.col("categories"), F.col("id"))
    return catalog_view(spark, sf_dir).where(c & F.col("kind").isin("book", "article") & (L.source_key(F.col("source")) == "gutendex")).orderBy(F.col("publication_date").desc_nulls_last(), "id").select("id", "publication_date")


@query(f"WITH {_CATALOG_SQL} SELECT value, count(*) AS records FROM (SELECT unnest(list_distinct(categories)) AS value FROM catalog) GROUP BY value")
def facets(spark, sf_dir):
    return L.facets(catalog_view(spark, sf_dir), "categories")


# ---- references

_REF = "CASE doc_id % 8 WHEN 0 THEN source || ':' || doc_id || '!word' || (doc_id % 30 + 1) WHEN 1 THEN 'demo@2026/' || source || ':\"a \"\"b\"\": c\"!clause2-4' WHEN 2 THEN source || ':!x1' WHEN 3 THEN 'urn:tf:demo@1:Part%20One:' || doc_id || '!w1-3' WHEN 4 THEN 'demo/' || source WHEN 5 THEN 'a:b!word5-2' WHEN 6 THEN '' ELSE 'urn:tf:demo:bad%2:x' END"
_REF_SPARK = _REF.replace("|| doc_id ", "|| CAST(doc_id AS STRING) ").replace("|| (doc_id % 30 + 1)", "|| CAST(doc_id % 30 + 1 AS STRING)")
_SHORT, _URN, _SEC = R.SHORT.replace("'", "''"), R.URN.replace("'", "''"), R.SECTION
_PARSED = f"""ref AS (SELECT doc_id, {_REF} AS ref FROM documents), p AS (SELECT doc_id, ref, starts_with(ref, 'urn:tf:') AS urn, CASE WHEN starts_with(ref, 'urn:tf:') THEN '{_URN}' ELSE '{_SHORT}' END AS pat FROM ref),
    g AS (SELECT doc_id, ref, urn, CASE WHEN urn THEN regexp_matches(ref, '{_URN}') ELSE regexp_matches(ref, '{_SHORT}') END AS ok, {', '.join(f"nullif(CASE WHEN urn THEN regexp_extract(ref, '{_URN}', {k}) ELSE regexp_extract(ref, '{_SHORT}', {k}) END, '') AS g{k}" for k in range(1, 7))} FROM p),
    er AS (SELECT *, CASE WHEN ref = '' THEN 'empty' WHEN NOT ok THEN 'syntax' WHEN urn AND regexp_matches(regexp_replace(g3, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%') THEN 'percent escape' WHEN CAST(g6 AS BIGINT) < CAST(g5 AS BIGINT) THEN 'descending range' END AS error FROM g),
    parsed AS (SELECT doc_id, ref, error, CASE WHEN error IS NULL THEN g1 END AS corpus_id, CASE WHEN error IS NULL THEN g2 END AS version, CASE WHEN error IS NULL THEN g4 END AS otype, CASE WHEN error IS NULL THEN CAST(g5 AS BIGINT) END AS start_at, CASE WHEN error IS NULL THEN CAST(g6 AS BIGINT) END AS end_at,
        CASE WHEN error IS NULL THEN CASE WHEN urn THEN list_transform(string_split(g3, ':'), lambda s: url_decode(replace(s, '+', '%2B'))) ELSE list_transform(regexp_extract_all(g3, '({_SEC})', 1), lambda s: CASE WHEN starts_with(s, '"') THEN replace(substr(s, 2, length(s) - 2), '""', '"') ELSE s END) END END AS sections FROM er)"""
_FORMAT = """array_to_string(list_transform(sections, lambda s: CASE WHEN s = '' OR regexp_matches(s, '[:/!@"\\s]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END), ':') || coalesce('!' || otype || start_at || coalesce('-' || end_at, ''), '')"""


def parsed_refs(spark, sf_dir) -> DataFrame:
    return R.parse(table(spark, sf_dir, "documents").select("doc_id", F.expr(_REF_SPARK).alias("ref")))


@query(f"WITH {_PARSED} SELECT doc_id, error, corpus_id, version, array_to_string(sections, ' | ') AS sections FROM parsed")
def ref_parse(spark, sf_dir):
    return parsed_refs(spark, sf_dir).select("doc_id", "error", "corpus_id", "version", F.array_join("sections", " | ").alias("sections"))


@query(f"WITH {_PARSED} SELECT doc_id, error, array_to_string(sections, ' | ') AS sections, otype, start_at, end_at FROM parsed WHERE starts_with(ref, 'urn:tf:')")
def ref_parse_urn(spark, sf_dir):
    return parsed_refs(spark, sf_dir).where(F.col("ref").startswith("urn:tf:")).select("doc_id", "error", F.array_join("sections", " | ").alias("sections"), "otype", "start_at", "end_at")


@query(f"WITH {_PARSED} SELECT doc_id, otype, start_at, end_at FROM parsed WHERE error IS NULL")
def ref_selector(spark, sf_dir):
    return parsed_refs(spark, sf_dir).where("error IS NULL").select("doc_id", "otype", "start_at", "end_at")


@query(f"WITH {_PARSED} SELECT doc_id, coalesce(corpus_id || coalesce('@' || version, '') || '/', '') || {_FORMAT} AS short FROM parsed WHERE error IS NULL")
def ref_format(spark, sf_dir):
    c = F.col
    d = parsed_refs(spark, sf_dir).where("error IS NULL")
    return d.select("doc_id", R.format_ref(c("corpus_id"), c("version"), c("sections"), c("otype"), c("start_at"), c("end_at")).alias("short"))


@query(f"WITH {_PARSED} SELECT doc_id, coalesce(corpus_id, 'demo') || '@2026/' || {_FORMAT} AS ref FROM parsed WHERE error IS NULL")
def ref_normalize(spark, sf_dir):
    return parsed_refs(spark, sf_dir).where("error IS NULL").select("doc_id", R.normalize("demo", "2026").alias("ref"))


def corpus_sections(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    top = c.select((conv * 1000000).alias("node"), F.array(conv.cast("string")).alias("path")).distinct()
    return top.unionByName(c.select((conv * 1000000 + (turn + 1) * 10000).alias("node"), F.array(conv.cast("string"), turn.cast("string")).alias("path")))


def corpus_units(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    base, path = F.col("conv_id") * 1000000 + (F.col("turn") + 1) * 10000, F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    words = T.each(c, [base.alias("base"), path.alias("path")], T.word_list(F.col("text")), "pos", "w").select((F.col("base") + 1 + F.col("pos")).alias("node"), F.lit("word").alias("otype"), "path")
    clauses = T.each(c, [base.alias("base"), path.alias("path")], T.clauses(F.col("text")), "pos", "w").select((F.col("base") + 5000 + F.col("pos")).alias("node"), F.lit("clause").alias("otype"), "path")
    return words.unionByName(clauses)


_CORPUS = r"""sec AS (SELECT DISTINCT conv_id * 1000000 AS node, [CAST(conv_id AS VARCHAR)] AS path FROM conversations UNION ALL SELECT conv_id * 1000000 + (turn + 1) * 10000, [CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)] FROM conversations),
    l AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Za-z0-9]+')) AS w, list_filter(list_transform(regexp_split_to_array(text, '[,;:]|—|–|--'), lambda c: regexp_replace(c, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g')), lambda c: c <> '') AS c FROM conversations),
    unit AS (SELECT conv_id * 1000000 + (turn + 1) * 10000 + 1 + unnest(range(0, len(w))) AS node, 'word' AS otype, [CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)] AS path FROM l UNION ALL SELECT conv_id * 1000000 + (turn + 1) * 10000 + 5000 + unnest(range(0, len(c))), 'clause', [CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)] FROM l),
    idx AS (SELECT s.node AS section, s.path, u.otype, u.node, row_number() OVER (PARTITION BY s.node, u.otype ORDER BY u.node) AS pos, count(*) OVER (PARTITION BY s.node, u.otype) AS total FROM unit u JOIN sec s ON s.path = u.path OR s.path = u.path[1:1])"""


def corpus_index(spark, sf_dir) -> DataFrame:
    return R.unit_index(corpus_units(spark, sf_dir), corpus_sections(spark, sf_dir))


@query(f"WITH {_CORPUS} SELECT section, otype, node, pos, total FROM idx")
def unit_index(spark, sf_dir):
    return corpus_index(spark, sf_dir).select("section", "otype", "node", "pos", "total")


_ASK = "CASE doc_id % 5 WHEN 0 THEN '{c}:0!word' || (doc_id % 9 + 1) || '-' || (doc_id % 9 + 10) WHEN 1 THEN '{c}!clause' || (doc_id % 300 + 1) WHEN 2 THEN '{c}:1' WHEN 3 THEN '{c}:99!word10' ELSE '{c}:0!verse1' END"
_ASK_SQL = _ASK.replace("'{c}", "(doc_id % 500) || '")


def asked(spark, sf_dir) -> DataFrame:
    x = _ASK.replace("'{c}", "CAST(doc_id % 500 AS STRING) || '")
    for e in ("(doc_id % 9 + 10)", "(doc_id % 9 + 1)", "(doc_id % 300 + 1)"):
        x = x.replace(f"|| {e}", f"|| CAST{e[:-1]} AS STRING)")
    return R.parse(table(spark, sf_dir, "documents").select("doc_id", F.expr(x).alias("ref")))


_ASKED = f"ask AS (SELECT doc_id, {_ASK_SQL} AS ref FROM documents), p AS (SELECT doc_id, string_split(regexp_extract(ref, '^([^!]+)', 1), ':') AS path, nullif(regexp_extract(ref, '!([A-Za-z0-9_]+)([1-9][0-9]*)(?:-([0-9]+))?$', 1), '') AS otype, TRY_CAST(regexp_extract(ref, '!([A-Za-z0-9_]+)([1-9][0-9]*)(?:-([0-9]+))?$', 2) AS BIGINT) AS a, TRY_CAST(regexp_extract(ref, '!([A-Za-z0-9_]+)([1-9][0-9]*)(?:-([0-9]+))?$', 3) AS BIGINT) AS b FROM ask)"


@query(f"WITH {_CORPUS}, {_ASKED} SELECT doc_id, s.node AS section FROM p LEFT JOIN sec s ON s.path = p.path")
def ref_section(spark, sf_dir):
    s = corpus_sections(spark, sf_dir).select(F.col("node").alias("section"), F.col("path").alias("sections"))
    return asked(spark, sf_dir).join(s, "sections", "left").select("doc_id", "section")


@query(f"""WITH {_CORPUS}, {_ASKED}, t AS (SELECT DISTINCT section, otype, total FROM idx), r AS (SELECT p.*, s.node AS section, t.total, CASE WHEN s.node IS NULL THEN 'section not found' WHEN p.otype IS NOT NULL AND t.total IS NULL THEN 'type not in section' WHEN coalesce(b, a) > t.total THEN 'index out of range' END AS error
    FROM p LEFT JOIN sec s ON s.path = p.path LEFT JOIN t ON t.section = s.node AND t.otype = p.otype)
    SELECT doc_id, error, CASE WHEN error IS NULL THEN coalesce(i.node, r.section) END AS node FROM r LEFT JOIN idx i ON r.error IS NULL AND i.section = r.section AND i.otype = r.otype AND i.pos BETWEEN r.a AND coalesce(r.b, r.a)""")
def ref_resolve(spark, sf_dir):
    return R.resolve(asked(spark, sf_dir), corpus_sections(spark, sf_dir), corpus_index(spark, sf_dir), "doc_id")


@query(f"WITH {_CORPUS} SELECT u.node, 'demo@2026/' || array_to_string(u.path, ':') || '!' || u.otype || i.pos AS ref FROM unit u JOIN idx i ON i.node = u.node AND i.otype = u.otype AND i.path = u.path")
def ref_serialize(spark, sf_dir):
    u = corpus_units(spark, sf_dir)
    return R.serialize(u.select("node"), u, corpus_index(spark, sf_dir), "demo", "2026")


_VALUES = "SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN '' WHEN 2 THEN 'a/b' WHEN 3 THEN NULL ELSE 'demo' END AS corpus_id, CASE doc_id % 7 WHEN 1 THEN '1!' WHEN 2 THEN '2026' WHEN 3 THEN '1' END AS version, doc_id % 11 AS s, CASE WHEN doc_id % 5 > 0 THEN 'word' END AS otype, CASE WHEN doc_id % 13 > 0 THEN doc_id % 4 END AS a, CASE WHEN doc_id % 3 = 0 THEN doc_id % 6 END AS b FROM documents"


@query(rf"""SELECT doc_id, CASE WHEN s = 0 THEN 'at least one section is required' WHEN version IS NOT NULL AND corpus_id IS NULL THEN 'a version requires a corpus id' WHEN corpus_id = '' OR regexp_matches(corpus_id, '[/:@!]') THEN 'corpus id contains a reserved delimiter' WHEN version = '' OR regexp_matches(version, '[/:@!]') THEN 'version contains a reserved delimiter'
    WHEN otype IS NULL AND (a IS NOT NULL OR b IS NOT NULL) THEN 'an index requires a unit type' WHEN otype IS NOT NULL AND coalesce(a, 0) < 1 THEN 'selector indices are 1-based' WHEN b < a THEN 'range end precedes its start' END AS error FROM ({_VALUES})""")
def ref_values(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("ref_values_documents")
    d = spark.sql(_VALUES.replace("FROM documents", "FROM ref_values_documents"))
    sections = F.when(F.col("s") > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    c = F.col
    return d.select("doc_id", R.value_error(c("corpus_id"), c("version"), sections, c("otype"), c("a"), c("b")).alias("error"))


@query(f"WITH {_CORPUS}, {_ASKED}, u AS (SELECT doc_id, d, path[1:d] AS own FROM (SELECT doc_id, path, unnest(range(1, len(path) + 1)) AS d FROM p)) SELECT doc_id, CAST(min(CASE WHEN own NOT IN (SELECT path FROM sec) THEN d END) AS INT) AS depth FROM u GROUP BY doc_id")
def ref_missing_depth(spark, sf_dir):
    return R.missing_depth(asked(spark, sf_dir), corpus_sections(spark, sf_dir), "doc_id")


@query(f"WITH {_CORPUS} SELECT node, otype, array_to_string(path, ':') AS path FROM unit")
def corpus_anchor(spark, sf_dir):
    """The corpus as tables of slots: a unit spans two, the second of which belongs to the next section."""
    units = corpus_units(spark, sf_dir)
    n, base = F.col("node"), F.floor(F.col("node") / 10000) * 10000
    slots = units.select("node", n.alias("slot")).unionByName(units.select("node", (base + 10000 + 9999).alias("slot")))
    sections = corpus_sections(spark, sf_dir)
    leaf = units.select(base.cast("long").alias("section"), n.alias("slot"))
    top = units.select((F.floor(n / 1000000) * 1000000).cast("long").alias("section"), n.alias("slot"))
    d = R.anchored_units(units.select("node", "otype"), slots, leaf.unionByName(top), sections)
    return d.select("node", "otype", F.array_join("path", ":").alias("path"))
