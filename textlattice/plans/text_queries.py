"""Scans, cleanup and scalar text functions as queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textlattice.functions import patterns as P, text as T
from textlattice.plans import duck as D
from textlattice.sources.tables import resolve_format, sanitize_filename, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""SELECT source, count(*) AS docs, CAST(sum({D.word_count('text')}) AS BIGINT) AS words, CAST(sum({D.sentence_count('text')}) AS BIGINT) AS sentences,
    CAST(sum(len({D.paragraphs('text')})) AS BIGINT) AS paragraphs FROM documents GROUP BY source""")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    d = table(spark, sf_dir, "documents").select("source", T.word_count(t).alias("w"), T.sentence_count(t).alias("s"), F.size(T.paragraphs(t)).alias("p"))
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("w").alias("words"), F.sum("s").alias("sentences"), F.sum("p").cast("long").alias("paragraphs"))


@query(f"SELECT doc_id, {D.word_count('text')} AS words FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(f"SELECT doc_id, {D.sentence_count('text')} AS sentences FROM documents")
def sentence_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sentence_count(F.col("text")).alias("sentences"))


@query(f"""SELECT doc_id, idx, {D.word_count('x')} AS words, CAST(length(x) AS BIGINT) AS n_chars
    FROM (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS idx FROM (SELECT doc_id, {D.sentences('text')} AS s FROM documents))""")
def sentences(spark, sf_dir):
    d = T.each(table(spark, sf_dir, "documents"), ["doc_id"], T.sentences(F.col("text")), "pos", "s")
    return d.select("doc_id", (F.col("pos") + 1).cast("long").alias("idx"), T.word_count(F.col("s")).alias("words"), F.length("s").cast("long").alias("n_chars"))


@query(f"""SELECT doc_id, idx, {D.word_count('x')} AS words, {D.sentence_count('x')} AS sentences
    FROM (SELECT doc_id, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS idx FROM (SELECT doc_id, {D.paragraphs("replace(text, chr(10), chr(10) || chr(10))")} AS p FROM documents))""")
def paragraphs(spark, sf_dir):
    t = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    d = T.each(table(spark, sf_dir, "documents"), ["doc_id"], T.paragraphs(t), "pos", "p")
    return d.select("doc_id", (F.col("pos") + 1).cast("long").alias("idx"), T.word_count(F.col("p")).alias("words"), T.sentence_count(F.col("p")).alias("sentences"))


@query(f"""SELECT doc_id, count(*) AS clauses, CAST(sum({D.word_count('c')}) AS BIGINT) AS words, CAST(max(length(c)) AS BIGINT) AS longest
    FROM (SELECT doc_id, unnest({D.clauses('s')}) AS c FROM (SELECT doc_id, unnest({D.sentences('text')}) AS s FROM documents)) GROUP BY doc_id""")
def clauses(spark, sf_dir):
    d = T.each(table(spark, sf_dir, "documents"), ["doc_id"], T.sentences(F.col("text")), "i", "s")
    d = T.each(d, ["doc_id"], T.clauses(F.col("s")), "k", "c")
    return d.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.sum(T.word_count(F.col("c"))).alias("words"), F.max(F.length("c")).cast("long").alias("longest"))


@query(r"""SELECT lower(w) AS word, count(*) AS n, count(DISTINCT doc_id) AS docs, CAST(min(idx) AS BIGINT) AS first_idx FROM
    (SELECT doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS idx FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Za-z0-9]+')) AS l FROM documents))
    GROUP BY 1""")
def words(spark, sf_dir):
    d = T.each(table(spark, sf_dir, "documents"), ["doc_id"], T.word_list(F.col("text")), "pos", "w")
    per_doc = d.groupBy(F.lower("w").alias("word"), "doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), (F.min("pos") + 1).cast("long").alias("first_idx"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM documents")
def token_counts(spark, sf_dir):
    """The stand-in encoder: tokens between white space."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[^ \t\n\r\x0b\x0c]+")).cast("long").alias("tokens"))


_RAW = "'head' || chr(13) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '*** START OF THE PROJECT GUTENBERG EBOOK ' || doc_id || ' ***' ELSE '' END || chr(10) || CASE WHEN doc_id % 4 = 0 THEN 'A Title' || chr(10) || chr(10) || 'CONTENTS' || chr(10) || chr(10) || 'Chapter 1 .... 3' || chr(10) || 'Chapter 2 .... 9' || chr(10) || chr(10) || 'It was so. And then.' || chr(10) || chr(10) ELSE '' END || text || chr(10) || ' ' || chr(10) || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '*** END OF THIS PROJECT GUTENBERG EBOOK ***' WHEN doc_id % 3 = 1 THEN 'End of the Project Gutenberg EBook of x' ELSE '' END || chr(10) || 'tail'"
_RAW_SPARK = _RAW.replace("chr(13)", "'\\r'").replace("chr(10)", "'\\n'").replace("|| doc_id ||", "|| cast(doc_id as string) ||")


def raw_books(spark, sf_dir) -> DataFrame:
    """Documents wrapped in license lines, with carriage returns and blank runs, every fourth after a contents page."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW_SPARK).alias("raw"))


_LF = rf"regexp_replace(raw, '\r\n?', chr(10), 'g')"
_START = f"regexp_extract(t, {D.q('(?im)' + P.START_MARK)})"
_BODY = f"CASE WHEN {_START} <> '' THEN substr(t, strpos(t, {_START}) + length({_START})) ELSE t END"
_END = f"regexp_extract(b, {D.q('(?im)' + P.END_MARK)})"
_CUT = f"CASE WHEN {_END} <> '' THEN substr(b, 1, strpos(b, {_END}) - 1) ELSE b END"
_STRIPPED = f"SELECT doc_id, {_CUT} AS c FROM (SELECT doc_id, {_BODY} AS b FROM (SELECT doc_id, {_LF} AS t FROM (SELECT doc_id, {_RAW} AS raw FROM documents)))"
_WS = "regexp_replace(regexp_replace(c, '\\n[ \\t]+\\n', chr(10) || chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, sha256(c) AS body_sha256, CAST(length(c) AS BIGINT) AS n_chars FROM ({_STRIPPED})")
def strip_boilerplate(spark, sf_dir):
    d = raw_books(spark, sf_dir).select("doc_id", T.strip_boilerplate(T.newlines(F.col("raw"))).alias("c"))
    return d.select("doc_id", F.sha2("c", 256).alias("body_sha256"), F.length("c").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, sha256(x) AS sha256, CAST(length(x) AS BIGINT) AS n_chars FROM (SELECT doc_id, {D.strip(_WS)} AS x FROM (SELECT doc_id, {_LF} AS c FROM (SELECT doc_id, {_RAW} AS raw FROM documents)))")
def normalise_ws(spark, sf_dir):
    d = raw_books(spark, sf_dir).select("doc_id", T.normalise_blank_lines(T.newlines(F.col("raw"))).alias("x"))
    return d.select("doc_id", F.sha2("x", 256).alias("sha256"), F.length("x").cast("long").alias("n_chars"))


# the contents page of every fourth document, where the start marker makes it the opening
_CLEAN = f"CASE WHEN doc_id % 4 = 0 THEN regexp_replace(x, '^A Title\\n\\nCONTENTS\\n\\nChapter 1 .... 3\\nChapter 2 .... 9\\n\\n', '') ELSE x END"


@query(f"SELECT doc_id, sha256(y) AS sha256, {D.word_count('y')} AS words FROM (SELECT doc_id, {_CLEAN} AS y FROM (SELECT doc_id, {D.strip(_WS)} AS x FROM ({_STRIPPED})))")
def preprocess(spark, sf_dir):
    d = raw_books(spark, sf_dir).select("doc_id", T.preprocess(F.col("raw")).alias("x"))
    return d.select("doc_id", F.sha2("x", 256).alias("sha256"), T.word_count(F.col("x")).alias("words"))


@query(f"""WITH r AS (SELECT doc_id, replace(raw, chr(13), chr(10)) AS m FROM (SELECT doc_id, {_RAW} AS raw FROM documents)),
    s AS (SELECT *, regexp_extract(m, {D.q('(?im)' + P.START_MARK)}) AS a FROM r),
    e AS (SELECT *, CASE WHEN a <> '' THEN strpos(m, a) + length(a) - 1 ELSE 0 END AS fin FROM s),
    f AS (SELECT *, regexp_extract(substr(m, fin + 1), {D.q('(?im)' + P.END_MARK)}) AS z FROM e)
    SELECT doc_id, 'front' AS position, CAST(0 AS BIGINT) AS start_at, CAST(fin AS BIGINT) AS end_at, {D.word_count('substr(m, 1, fin)')} AS words FROM f WHERE a <> ''
    UNION ALL SELECT doc_id, 'back', CAST(fin + strpos(substr(m, fin + 1), z) - 1 AS BIGINT), CAST(length(m) AS BIGINT), {D.word_count('substr(m, fin + strpos(substr(m, fin + 1), z))')} FROM f WHERE z <> ''""")
def matter_regions(spark, sf_dir):
    d = raw_books(spark, sf_dir).select("doc_id", F.replace("raw", F.lit("\r"), F.lit("\n")).alias("m"))
    a = F.split(F.col("m"), f"(?imd){P.START_MARK}", 2)
    d = d.withColumn("front", F.when(F.size(a) > 1, F.length("m") - F.length(a[1])))
    rest = F.substring(F.col("m"), F.coalesce("front", F.lit(0)) + 1, F.length("m"))
    z = F.split(rest, f"(?imd){P.END_MARK}", 2)
    d = d.withColumn("back", F.when(F.size(z) > 1, F.coalesce("front", F.lit(0)) + F.length(z[0])))
    region = lambda name, s, e: F.struct(F.lit(name).alias("position"), s.cast("long").alias("start_at"), e.cast("long").alias("end_at"))
    both = F.array(F.when(F.col("front").isNotNull(), region("front", F.lit(0), F.col("front"))), F.when(F.col("back").isNotNull(), region("back", F.col("back"), F.length("m"))))
    d = d.select("doc_id", "m", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("r"))
    part = F.substring(F.col("m"), F.col("r.start_at").cast("int") + 1, (F.col("r.end_at") - F.col("r.start_at")).cast("int"))
    return d.select("doc_id", "r.position", "r.start_at", "r.end_at", T.word_count(part).alias("words"))


@query(rf"""SELECT page_id, sha256(x) AS sha256, {D.word_count('x')} AS words FROM (SELECT page_id, array_to_string(list_transform(
    CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(regexp_replace(t, '(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}])$', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]') END, lambda l: {D.strip('l')}), chr(10)) AS x
    FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)</(?:p|div|h[1-6]|section|article|pre)>|<br\s*/?>', chr(10) || chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&(?:#\d+|#x[\da-fA-F]+|[a-zA-Z]+);', ' ', 'g') AS t FROM pages))""")
def html_to_text(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("x"))
    return d.select("page_id", F.sha2("x", 256).alias("sha256"), T.word_count(F.col("x")).alias("words"))


@query(r"SELECT doc_id, sha256(replace(regexp_replace(regexp_replace(t, '([A-Za-z])-\n(\p{Ll})', '\1\2', 'g'), '([A-Za-z])-\n(\p{Ll})', '\1\2', 'g'), chr(10), ' ')) AS sha256 FROM (SELECT doc_id, replace(text, ', ', '-' || chr(10)) AS t FROM documents)")
def dehyphenate(spark, sf_dir):
    t = F.replace(F.col("text"), F.lit(", "), F.lit("-\n"))
    x = F.replace(F.regexp_replace(t, r"([A-Za-z])-\n(?=\p{Ll})", "$1"), F.lit("\n"), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(x, 256).alias("sha256"))


_TYPES = "CASE doc_id % 7 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN ' Text/Markdown ' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN '' WHEN 4 THEN 'image/png' WHEN 5 THEN 'application/pdf' END"
_NAMES = "'dir.d/file' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.HTML?x=1.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.unknown' WHEN 3 THEN '.text' ELSE '' END"


@query(f"""SELECT doc_id, coalesce(t.fmt, CASE WHEN kind IN ('', 'application/octet-stream', 'binary/octet-stream') THEN e.fmt END) AS format FROM
    (SELECT doc_id, lower(trim(split_part(coalesce({_TYPES}, ''), ';', 1))) AS kind, regexp_extract(lower(split_part({_NAMES}, '?', 1)), '[^/](\\.[^./]+)$', 1) AS ext FROM documents)
    LEFT JOIN (VALUES {', '.join(str(x) for x in P.CONTENT_TYPES.items())}) t(k, fmt) ON t.k = kind LEFT JOIN (VALUES {', '.join(str(x) for x in P.EXTENSIONS.items())}) e(k, fmt) ON e.k = ext""")
def resolve_format_query(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_TYPES).alias("ctype"), F.expr(_NAMES.replace("|| doc_id ||", "|| cast(doc_id as string) ||")).alias("name"))
    return d.select("doc_id", resolve_format(F.col("ctype"), F.col("name")).alias("format"))


QUERIES["resolve_format"], ORACLE_SQL["resolve_format"] = QUERIES.pop("resolve_format_query"), ORACLE_SQL.pop("resolve_format_query")


@query("""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(n, '^(?s:.*)[/\\\\]', ''), '[^a-zA-Z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'book.epub') AS name
    FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/tmp/' ELSE '' END || text || CASE WHEN doc_id % 5 = 0 THEN '/' ELSE '' END AS n FROM documents)""")
def sanitize_filename_query(spark, sf_dir):
    n = F.concat(F.when(F.col("doc_id") % 3 == 0, "/tmp/").otherwise(""), F.col("text"), F.when(F.col("doc_id") % 5 == 0, "/").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", sanitize_filename(n).alias("name"))


QUERIES["sanitize_filename"], ORACLE_SQL["sanitize_filename"] = QUERIES.pop("sanitize_filename_query"), ORACLE_SQL.pop("sanitize_filename_query")


@query("SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def doc_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(rf"""SELECT page_id, CAST(len(regexp_extract_all(x, '(?i)(?:^|[^\p{{L}}\p{{N}}_])https?://[^{D.SPACE}<>()\[\]"'']+')) AS BIGINT) AS urls FROM (SELECT page_id, 'see ' || url || ' (' || url || ') and x' || url || ' ' || html AS x FROM pages)""")
def bare_urls(spark, sf_dir):
    x = F.concat(F.lit("see "), F.col("url"), F.lit(" ("), F.col("url"), F.lit(") and x"), F.col("url"), F.lit(" "), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", T.bare_urls(x).alias("urls"))


@query(f"""SELECT doc_id, idx, CASE WHEN regexp_full_match(p, '(?is)\\[Illustration(?:\\s*:.*)?\\]') THEN 'illustration' WHEN regexp_full_match(p, {D.q('(?i)' + P.CHAPTER[1:-1])}) OR regexp_full_match(p, {D.q('(?i)' + P.PART[1:-1])}) THEN 'heading' END AS role
    FROM (SELECT doc_id, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS idx FROM (SELECT doc_id, ['CHAPTER ' || (doc_id % 40), '[Illustration: ' || chr(10) || 'x]', 'Part one - ' || source, '[illustration]', 'Chapter of accidents and of many other things', text] AS l FROM documents))""")
def paragraph_roles(spark, sf_dir):
    d = T.each(table(spark, sf_dir, "documents"), ["doc_id"], F.array(F.concat(F.lit("CHAPTER "), (F.col("doc_id") % 40).cast("string")), F.lit("[Illustration: \nx]"), F.concat(F.lit("Part one - "), F.col("source")), F.lit("[illustration]"), F.lit("Chapter of accidents and of many other things"), F.col("text")), "pos", "p")
    p = T.strip(F.col("p"))
    heading = p.rlike(rf"(?idu)\A(?:{P.CHAPTER[1:-1]})\z") | p.rlike(rf"(?idu)\A(?:{P.PART[1:-1]})\z")
    role = F.when(p.rlike(r"(?is)\A\[Illustration(?:\s*:.*)?\]\z"), "illustration").when(heading, "heading")
    return d.select("doc_id", (F.col("pos") + 1).cast("long").alias("idx"), role.alias("role"))
