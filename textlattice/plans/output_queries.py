"""Nested output, labels and word-level detail of documents as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlattice.functions import text as T
from textlattice.operators import books as B, nested as N, sections as S
from textlattice.plans import duck as D
from textlattice.plans.book_queries import _CNODES, books
from textlattice.plans.document_queries import _COUNTS, _HEADINGS, conversation_blocks
from textlattice.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query()
def book_json(spark, sf_dir):
    """The whole answer for a book as JSON; its numbers are those of book_structure and chapter_nodes."""
    ch = B.chapter_nodes(B.paragraph_nodes(books(spark, sf_dir)))
    return N.book_json(B.summary(ch), ch)


@query(f"""WITH {_CNODES} SELECT doc_id, part, chapter, coalesce(nullif(label, ''), 'Chapter ' || chapter) AS label, format('{{:,}}', words) || CASE WHEN words = 1 THEN ' word' ELSE ' words' END AS words,
    'n' || (CASE WHEN part > 0 THEN (part - 1) || '.' ELSE '' END) || (chapter - 1) AS node_id FROM cn WHERE chapter > 0""")
def node_labels(spark, sf_dir):
    ch = B.chapter_nodes(B.paragraph_nodes(books(spark, sf_dir))).where("chapter > 0")
    at = F.concat(F.lit("n"), F.when(F.col("part") > 0, F.concat((F.col("part") - 1).cast("string"), F.lit("."))).otherwise(""), (F.col("chapter") - 1).cast("string"))
    return ch.select("doc_id", "part", "chapter", N.node_label(F.lit("chapter"), F.col("chapter"), F.col("label")).alias("label"), N.described(F.col("words"), "word").alias("words"), at.alias("node_id"))


@query(f"""WITH {_COUNTS}, pr AS (SELECT doc, section, unnest({D.sentences('text')}) AS s FROM typed WHERE type IN ('paragraph', 'list_item', 'footnote'))
    SELECT doc, section, count(*) AS sentences, CAST(sum(greatest(1, len({D.clauses('s')}))) AS BIGINT) AS clauses, CAST(sum({D.word_count('s')}) AS BIGINT) AS words FROM pr GROUP BY doc, section""")
def doc_detail(spark, sf_dir):
    d = S.retyped(conversation_blocks(spark, sf_dir)).where(F.col("type").isin(S.PROSE))
    d = T.each(d, ["doc", "section"], T.sentences(F.col("text")), "i", "s")
    return d.groupBy("doc", "section").agg(F.count("*").alias("sentences"), F.sum(F.greatest(F.lit(1), F.size(T.clauses(F.col("s"))))).cast("long").alias("clauses"), F.sum(T.word_count(F.col("s"))).alias("words"))


@query(f"""WITH {_HEADINGS}, pt AS (SELECT a.doc, a.pos, list(hi.idx ORDER BY a.at) AS steps FROM anc a JOIN hi ON hi.doc = a.doc AND hi.pos = a.at GROUP BY a.doc, a.pos)
    SELECT doc, array_to_string(steps, '.') AS path, CAST(len(steps) AS INT) AS depth, CAST(row_number() OVER (PARTITION BY doc ORDER BY steps) AS INT) AS "order", len(steps) <= 1 AS open FROM pt""")
def path_index(spark, sf_dir):
    return N.path_index(S.paths(S.headings(conversation_blocks(spark, sf_dir)))).select("doc", "path", "depth", "order", "open")


@query(f"""WITH {_COUNTS}, pt AS (SELECT a.doc, a.pos, string_agg(CAST(hi.idx AS VARCHAR), '.' ORDER BY a.at) AS path FROM anc a JOIN hi ON hi.doc = a.doc AND hi.pos = a.at GROUP BY a.doc, a.pos),
    tt AS (SELECT doc, "at" AS pos, CAST(sum(words) AS BIGINT) AS words, CAST(sum(sentences) AS BIGINT) AS sentences FROM (SELECT c.*, coalesce(a.at, c.section) AS "at" FROM cnt c LEFT JOIN anc a ON a.doc = c.doc AND a.pos = c.section) GROUP BY doc, "at")
    SELECT doc, 'n' || path AS id, CASE WHEN contains(path, '.') THEN 'n' || regexp_replace(path, '\\.[0-9]+$', '') END AS parent, sha256(text) AS label, words, sentences, {D.ratio('words', 'greatest(sentences, 1)')} AS avg_words FROM pt JOIN hi USING (doc, pos) JOIN tt USING (doc, pos)""")
def tree_nodes(spark, sf_dir):
    b = conversation_blocks(spark, sf_dir)
    h = S.headings(b)
    totals = S.totals(S.counts(S.retyped(b)), h).select("doc", F.col("section").alias("pos"), "words", "sentences")
    return N.as_nodes(S.paths(h).join(totals, ["doc", "pos"])).withColumn("label", F.sha2("label", 256))


@query("SELECT doc_id, count(*) AS shown, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT doc_id, unnest(['lang', 'source', 'text', 'tags', 'blank']) AS name, unnest([lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, text, '[]', '  ']) AS value FROM documents) WHERE value IS NOT NULL AND trim(value) NOT IN ('', '[]', '{}', 'null') GROUP BY doc_id")
def shown_metadata(spark, sf_dir):
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    pairs = F.array(pair("lang", F.col("lang")), pair("source", F.when(F.col("doc_id") % 3 != 0, F.col("source"))), pair("text", F.col("text")), pair("tags", F.lit("[]")), pair("blank", F.lit("  ")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.inline(pairs))
    return N.shown(d).groupBy("doc_id").agg(F.count("*").alias("shown"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
