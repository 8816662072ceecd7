"""Schema detection, splitting and roll-ups as queries with their oracles.

Each document becomes a book: its lines are paragraphs, and headings of the kind
that doc_id names are put between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlattice.functions import patterns as P, text as T
from textlattice.operators import books as B
from textlattice.plans import duck as D
from textlattice.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_HEADS = """CASE doc_id % 5
    WHEN 0 THEN concat(CASE WHEN i = 0 THEN 'GENESIS{nn}' WHEN i = 10 THEN 'EXODUS{nn}' ELSE '' END, CASE WHEN doc_id % 10 = 0 AND i % 5 = 0 THEN concat('CHAPTER ', i {div} 5 + 1, '{nn}') ELSE '' END, i {div} 5 + 1, ':', i % 5 + 1, ' ')
    WHEN 1 THEN concat(CASE WHEN i % 8 = 0 THEN concat('PART ', i {div} 8 + 1, '{nn}') ELSE '' END, CASE WHEN i % 2 = 0 AND i % 16 < 8 THEN concat('CHAPTER ', i {div} 2 + 1, '{nn}') ELSE '' END)
    WHEN 2 THEN CASE WHEN i % 3 = 0 THEN concat(CASE WHEN doc_id % 2 = 0 THEN 'CHAPTER ' ELSE '' END, i {div} 3 + 1, '.{nn}') ELSE '' END
    WHEN 3 THEN CASE WHEN i % 3 = 0 THEN concat('THE ESSAY ', chr(CAST(65 + i {div} 3 % 26 AS INT)), '{nn}', CASE WHEN doc_id % 2 = 0 THEN 'By A Person{nn}' ELSE '' END) ELSE '' END
    ELSE '' END"""


def book_view(spark, sf_dir) -> DataFrame:
    heads = _HEADS.format(nn="\\n\\n", div="div")
    return table(spark, sf_dir, "documents").select("doc_id", T.strip(F.expr(f"array_join(transform(split(text, '\\n', -1), (x, i) -> concat({heads}, x)), '\\n\\n')")).alias("text"))


_NN = "' || chr(10) || chr(10) || '"
_BOOKS = f"""book AS (SELECT doc_id, {D.strip(f"array_to_string(list_transform(string_split(text, chr(10)), lambda x, k: {_HEADS.format(nn=_NN, div='//').replace(' i ', ' (k - 1) ').replace('(i ', '((k - 1) ').replace(', i //', ', (k - 1) //')} || x), chr(10) || chr(10))")} AS text FROM documents)"""


def _n(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(text, {D.q(pattern)})) AS BIGINT)"


_NOT_KEYWORD = f"lambda t: NOT regexp_matches(t, {D.q('(?i)' + chr(92) + 'b(?:' + P.KEYWORDS + ')' + chr(92) + 'b')})"
_EVIDENCE = f"""{_BOOKS}, evidence AS (SELECT doc_id, text, {_n('(?m)' + P.VERSE)} AS verses, {_n('(?mi)' + P.PART)} AS parts, {_n('(?mi)' + P.CHAPTER)} AS chapter_words, {_n('(?m)' + P.NUMERAL)} AS chapter_numerals,
    CAST(len(list_filter(regexp_extract_all(text, {D.q('(?m)' + P.CAPS_TITLE)}), {_NOT_KEYWORD})) AS BIGINT) AS titles,
    CAST(len(list_filter(regexp_extract_all(text, {D.q('(?m)(' + P.CAPS_TITLE + ')[ ' + chr(92) + 't]*' + chr(92) + 'n+(?:[ ' + chr(92) + 't]*' + chr(92) + 'n)*[ ' + chr(92) + 't]*(?i:By)[ ' + chr(92) + 't]+[^' + chr(92) + 'n]+')}, 1), {_NOT_KEYWORD})) AS BIGINT) AS bylines,
    CAST(len(list_filter(string_split(text, chr(10) || chr(10)), lambda b: {D.strip('b')} <> '')) AS BIGINT) AS blocks FROM book)"""


def _strength(n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN least(0.9::DOUBLE, round(0.3::DOUBLE + 0.1::DOUBLE * ({n}), 2)) ELSE 0.0::DOUBLE END"


_CH = "greatest(chapter_words, chapter_numerals)"
_SCORES = f"""{_EVIDENCE}, scores AS (SELECT *, CASE WHEN verses >= 10 THEN {_strength('verses')} ELSE round(0.03::DOUBLE * verses, 2) END AS s_scripture,
    CASE WHEN parts >= 2 AND chapter_words >= 2 THEN {_strength('parts + chapter_words')} ELSE 0.0::DOUBLE END AS s_sectioned, {_strength(_CH)} AS s_standard,
    least({_strength('titles')}, CASE WHEN bylines >= 2 THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END) AS s_essay, CASE WHEN verses + parts + {_CH} + titles = 0 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS s_flat FROM evidence)"""
_DETECT = f"""{_SCORES}, named AS (SELECT *, CASE WHEN verses >= 10 THEN 'canonical_scripture' WHEN parts >= 2 AND chapter_words >= 2 THEN 'sectioned_book' WHEN {_CH} >= 2 THEN 'standard_book' WHEN titles >= 2 THEN 'essay_or_story_collection' ELSE 'flat' END AS detected,
    CAST(verses >= 10 AS INT) + CAST({_CH} >= 2 AS INT) + CAST(titles >= 2 AS INT) AS families FROM scores),
    scored AS (SELECT *, CASE detected WHEN 'canonical_scripture' THEN verses WHEN 'sectioned_book' THEN parts + chapter_words WHEN 'standard_book' THEN {_CH} WHEN 'essay_or_story_collection' THEN titles ELSE blocks END AS markers_found,
    CASE detected WHEN 'canonical_scripture' THEN s_scripture WHEN 'sectioned_book' THEN s_sectioned WHEN 'standard_book' THEN s_standard WHEN 'essay_or_story_collection' THEN s_essay ELSE s_flat END AS own FROM named),
    detect AS (SELECT *, CASE WHEN families > 1 THEN least(own, 0.6::DOUBLE) ELSE own END AS score FROM scored)"""
_CONF = "CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END"


@query(f"WITH {_EVIDENCE} SELECT doc_id, {', '.join(B.EVIDENCE)} FROM evidence")
def evidence(spark, sf_dir):
    return B.with_evidence(book_view(spark, sf_dir)).select("doc_id", *B.EVIDENCE)


@query(f"WITH {_EVIDENCE} SELECT doc_id, bylines FROM evidence WHERE bylines > 0")
def bylines(spark, sf_dir):
    return B.with_evidence(book_view(spark, sf_dir)).where("bylines > 0").select("doc_id", "bylines")


@query(f"WITH {_SCORES} SELECT doc_id, {', '.join(B.SCORES)} FROM scores")
def candidate_scores(spark, sf_dir):
    return B.with_scores(B.with_evidence(book_view(spark, sf_dir))).select("doc_id", *B.SCORES)


def detected(spark, sf_dir, override=None) -> DataFrame:
    return B.detect(B.with_scores(B.with_evidence(book_view(spark, sf_dir))), override)


@query(f"WITH {_DETECT} SELECT doc_id, detected, markers_found, score, {_CONF} AS confidence FROM detect")
def detect_schema(spark, sf_dir):
    return detected(spark, sf_dir).select("doc_id", "detected", "markers_found", "score", "confidence")


@query(f"WITH {_DETECT} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'flat' ELSE detected END AS schema, detected, score, doc_id % 7 = 0 AS overridden FROM detect")
def schema_override(spark, sf_dir):
    return detected(spark, sf_dir, F.when(F.col("doc_id") % 7 == 0, "flat")).select("doc_id", "schema", "detected", "score", "overridden")


@query("SELECT * FROM (VALUES " + ", ".join(f"({D.q(n)}, {D.q(d)}, {D.q(' > '.join(h))})" for n, d, h in P.SCHEMAS) + ") t(name, description, hierarchy)")
def list_schemas(spark, sf_dir):
    rows = [(n, d, " > ".join(h)) for n, d, h in P.SCHEMAS]
    return spark.createDataFrame(rows, "name string, description string, hierarchy string")


def _split(t: str, pattern: str) -> str:
    """DuckDB list of {label, content}."""
    p = f"string_split(regexp_replace({t}, {D.q(pattern)}, chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:]"
    return f"list_transform({p}, lambda p: {{'label': {D.strip('split_part(p, chr(2), 1)')}, 'content': {D.strip('split_part(p, chr(2), 2)')}}})"


_C, _N, _T, _P = f"(?mi)({P.CHAPTER})", f"(?m)({P.NUMERAL})", f"(?m)({P.CAPS_TITLE})", f"(?mi)({P.PART})"
# parts, chapters and paragraphs of all but scripture
_PARTS = f"""{_DETECT}, pl AS (SELECT doc_id, detected AS schema, text, CASE WHEN detected = 'sectioned_book' THEN {_split('text', _P)} ELSE [] END AS p FROM detect WHERE detected <> 'canonical_scripture'),
    pr AS (SELECT doc_id, schema, 'none' AS kind, CAST(0 AS BIGINT) AS part, NULL AS part_label, text AS content FROM pl WHERE len(p) = 0
        UNION ALL SELECT doc_id, schema, 'part', i, x.label, x.content FROM (SELECT doc_id, schema, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS i FROM pl WHERE len(p) > 0))"""
_CHAPTERS = f"""{_PARTS}, cw AS (SELECT *, {_split('content', _C)} AS w, {_split('content', _N)} AS n, {_split('content', _T)} AS e FROM pr),
    cl AS (SELECT *, CASE WHEN schema = 'flat' THEN [] WHEN schema = 'essay_or_story_collection' THEN e WHEN len(w) > 0 THEN w ELSE n END AS c FROM cw),
    ch AS (SELECT doc_id, schema, kind, part, part_label, CASE WHEN kind = 'none' THEN CAST(0 AS BIGINT) ELSE 1 END AS chapter, CASE WHEN kind <> 'none' THEN 'Chapter 1' END AS label, content FROM cl WHERE len(c) = 0
        UNION ALL SELECT doc_id, schema, kind, part, part_label, i, x.label, x.content FROM (SELECT *, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM cl WHERE len(c) > 0))"""
# scripture: its books begin at paragraphs that are a book's name, those without verses don't count; chapters by their headings, else by the verses' numbers
_BOOK_NAME = P.SCRIPTURE_BOOKS
_SCRIPTURE = f"""{_CHAPTERS}, sb AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS b FROM detect WHERE detected = 'canonical_scripture'),
    sh AS (SELECT *, list_filter(range(1, len(b) + 1), lambda k: regexp_full_match(b[k], {D.q('(?i)(?:(?:' + _BOOK_NAME + ')|BOOK' + chr(92) + 's+(?:OF' + chr(92) + 's+)?[A-Z][A-Z' + chr(92) + 's]+)[ ' + chr(92) + 't]*')})) AS h FROM sb),
    sc AS (SELECT doc_id, j, {D.strip('b[h[j]]')} AS label, {D.strip("array_to_string(b[h[j] + 1:CASE WHEN j < len(h) THEN h[j + 1] - 1 ELSE len(b) END], chr(10) || chr(10))")} AS content FROM (SELECT *, unnest(range(1, len(h) + 1)) AS j FROM sh)),
    sp AS (SELECT doc_id, 'canonical_scripture' AS schema, 'book' AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS part, label AS part_label, content, {_split('content', _C)} AS w FROM sc WHERE regexp_matches(content, {D.q('(?m)' + P.VERSE)})),
    sw AS (SELECT doc_id, schema, kind, part, part_label, unnest(range(1, len(w) + 1)) AS chapter, unnest(list_transform(w, lambda x: x.label)) AS label, unnest(list_transform(w, lambda x: x.content)) AS content FROM sp WHERE len(w) > 0),
    sl AS (SELECT *, CASE WHEN len(l) > 0 THEN l ELSE p END AS v FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(content, {D.q('(?m)' + P.VERSE)}), lambda x: {D.strip('x')}), lambda x: length(x) >= 3) AS l, {D.paragraphs('content')} AS p FROM sw)),
    vm AS (SELECT doc_id, schema, kind, part, part_label, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT *, string_split(regexp_replace(content, '(^|\\s)(\\d{{1,3}}):(\\d{{1,3}})\\s', '\\1' || chr(1) || '\\2:\\3' || chr(2), 'g'), chr(1))[2:] AS l FROM sp WHERE len(w) = 0)),
    vn AS (SELECT doc_id, schema, kind, part, part_label, pos, CAST(split_part(split_part(x, chr(2), 1), ':', 1) AS BIGINT) AS c, CAST(split_part(split_part(x, chr(2), 1), ':', 2) AS BIGINT) AS v, {D.strip('split_part(x, chr(2), 2)')} AS text FROM vm),
    vr AS (SELECT *, CASE WHEN c IS DISTINCT FROM lag(c) OVER (PARTITION BY doc_id, part ORDER BY pos) THEN 1 ELSE 0 END AS new FROM vn WHERE text <> ''),
    sv AS (SELECT doc_id, schema, kind, part, part_label, CAST(sum(new) OVER (PARTITION BY doc_id, part ORDER BY pos) AS BIGINT) AS chapter, 'Chapter ' || c AS label, v AS idx, text FROM vr)"""
_PARAS = f"""{_SCRIPTURE}, pal AS (SELECT *, {D.paragraphs('content')} AS l FROM ch),
    pa AS (SELECT doc_id, schema, kind, part, part_label, chapter, label, NULL AS idx, NULL AS text FROM pal WHERE len(l) = 0
        UNION ALL SELECT doc_id, schema, kind, part, part_label, chapter, label, unnest(range(1, len(l) + 1)), unnest(l) FROM pal WHERE len(l) > 0
        UNION ALL SELECT doc_id, schema, kind, part, part_label, chapter, label, NULL, NULL FROM sl WHERE len(v) = 0
        UNION ALL SELECT doc_id, schema, kind, part, part_label, chapter, label, unnest(range(1, len(v) + 1)), unnest(v) FROM sl WHERE len(v) > 0
        UNION ALL SELECT doc_id, schema, kind, part, part_label, chapter, label, idx, text FROM sv),
    nodes AS (SELECT doc_id, schema, kind, part, part_label, chapter, label, idx, CAST(CASE WHEN text IS NOT NULL THEN greatest(1, len({D.sentences('text')})) END AS BIGINT) AS sentences, {D.word_count('text')} AS words,
        CAST(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM pa)"""
_CNODES = f"""{_PARAS}, cn AS (SELECT doc_id, schema, kind, part, part_label, chapter, label, count(idx) AS paragraphs, CAST(coalesce(sum(sentences), 0) AS BIGINT) AS sentences, CAST(coalesce(sum(words), 0) AS BIGINT) AS words, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens
    FROM nodes GROUP BY ALL)"""
_AVG = f"{D.ratio('sentences', 'greatest(paragraphs, 1)')} AS avg_sentences, {D.ratio('words', 'greatest(sentences, 1)')} AS avg_words"


def books(spark, sf_dir) -> DataFrame:
    return detected(spark, sf_dir).select("doc_id", "schema", "text")


def chapters_of(spark, sf_dir, schema: str) -> DataFrame:
    d = detected(spark, sf_dir).where(F.col("schema") == schema).select("doc_id", "schema", "text")
    return B.chapters(d).select("doc_id", "part", "part_label", "chapter", "label", T.word_count(F.col("content")).alias("words"))


def _of(schema: str) -> str:
    return f"WITH {_CHAPTERS} SELECT doc_id, part, part_label, chapter, label, {D.word_count('content')} AS words FROM ch WHERE schema = '{schema}'"


@query(f"WITH {_BOOKS} SELECT doc_id, unnest(range(1, len(c) + 1)) AS idx, unnest(list_transform(c, lambda x: x.label)) AS label, unnest(list_transform(c, lambda x: sha256(x.content))) AS content_sha256 FROM (SELECT doc_id, {_split('text', _C)} AS c FROM book)")
def chapters(spark, sf_dir):
    d = T.each(book_view(spark, sf_dir), ["doc_id"], B.split_on(F.col("text"), B.CHAPTERS), "i", "x")
    return d.select("doc_id", (F.col("i") + 1).cast("long").alias("idx"), "x.label", F.sha2("x.content", 256).alias("content_sha256"))


@query(_of("standard_book"))
def standard_book(spark, sf_dir):
    return chapters_of(spark, sf_dir, "standard_book")


@query(_of("sectioned_book"))
def sectioned_book(spark, sf_dir):
    return chapters_of(spark, sf_dir, "sectioned_book")


@query(_of("essay_or_story_collection"))
def essays(spark, sf_dir):
    return chapters_of(spark, sf_dir, "essay_or_story_collection")


@query(f"WITH {_PARAS} SELECT doc_id, idx, sentences, words FROM nodes WHERE schema = 'flat' AND idx IS NOT NULL")
def flat_book(spark, sf_dir):
    d = detected(spark, sf_dir).where("schema = 'flat'").select("doc_id", "schema", "text")
    return B.paragraph_nodes(d).where("idx IS NOT NULL").select("doc_id", "idx", "sentences", "words")


@query(rf"""WITH {_BOOKS}, v AS (SELECT doc_id, pos, CAST(split_part(split_part(x, chr(2), 1), ':', 1) AS BIGINT) AS chapter, CAST(split_part(split_part(x, chr(2), 1), ':', 2) AS BIGINT) AS verse, {D.strip('split_part(x, chr(2), 2)')} AS t FROM
    (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '(^|\s)(\d{{1,3}}):(\d{{1,3}})\s', '\1' || chr(1) || '\2:\3' || chr(2), 'g'), chr(1))[2:] AS l FROM book))),
    f AS (SELECT *, CASE WHEN chapter IS DISTINCT FROM lag(chapter) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM v WHERE t <> '')
    SELECT doc_id, CAST(run AS BIGINT) AS run, min(chapter) AS chapter, count(*) AS verses, min(verse) AS first_verse, CAST(sum({D.word_count('t')}) AS BIGINT) AS words FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f) GROUP BY doc_id, run""")
def verse_islands(spark, sf_dir):
    d = book_view(spark, sf_dir).withColumnRenamed("text", "content")
    v = B.verses(d, ["doc_id"])
    return v.groupBy("doc_id", "run").agg(F.min("chapter").alias("chapter"), F.count("*").alias("verses"), F.min("verse").alias("first_verse"), F.sum(T.word_count(F.col("text"))).alias("words"))


@query(rf"""WITH {_BOOKS}, c AS (SELECT doc_id, unnest(range(1, len(c) + 1)) AS chapter, unnest(list_transform(c, lambda x: x.content)) AS content FROM (SELECT doc_id, {_split('text', _C)} AS c FROM book)),
    v AS (SELECT doc_id, chapter, list_filter(list_transform(regexp_split_to_array(content, '(?m)^\d+:\d+\s'), lambda x: {D.strip('x')}), lambda x: length(x) >= 3) AS l, {D.paragraphs('content')} AS p FROM c)
    SELECT doc_id, chapter, unnest(range(1, len(x) + 1)) AS idx, unnest(list_transform(x, lambda y: {D.word_count('y')})) AS words FROM (SELECT doc_id, chapter, CASE WHEN len(l) > 0 THEN l ELSE p END AS x FROM v)""")
def chapter_verses(spark, sf_dir):
    d = T.each(book_view(spark, sf_dir), ["doc_id"], B.split_on(F.col("text"), B.CHAPTERS), "i", "x")
    d = T.each(d, ["doc_id", (F.col("i") + 1).cast("long").alias("chapter")], B.verse_pieces(F.col("x.content")), "k", "v")
    return d.select("doc_id", "chapter", (F.col("k") + 1).cast("long").alias("idx"), T.word_count(F.col("v")).alias("words"))


@query(f"WITH {_CNODES} SELECT doc_id, kind, part, part_label, chapter, label, paragraphs, sentences, words FROM cn WHERE schema = 'canonical_scripture'")
def scripture(spark, sf_dir):
    """Books, chapters and verses."""
    d = detected(spark, sf_dir).where("schema = 'canonical_scripture'").select("doc_id", "schema", "text")
    return B.chapter_nodes(B.paragraph_nodes(d)).select("doc_id", "kind", "part", "part_label", "chapter", "label", "paragraphs", "sentences", "words")


@query(f"WITH {_PARAS} SELECT doc_id, part, chapter, idx, sentences, words, {D.ratio('words', 'sentences')} AS avg_words FROM nodes WHERE idx IS NOT NULL")
def paragraph_nodes(spark, sf_dir):
    return B.paragraph_nodes(books(spark, sf_dir)).where("idx IS NOT NULL").select("doc_id", "part", "chapter", "idx", "sentences", "words", "avg_words")


@query(f"WITH {_PARAS} SELECT doc_id, part, chapter, idx AS paragraph, CAST(i AS BIGINT) AS sentence, {D.word_count('s')} AS words, CAST(greatest(1, len({D.clauses('s')})) AS BIGINT) AS clauses FROM (SELECT *, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, {D.sentences('text')} AS l FROM pa WHERE idx IS NOT NULL))")
def detail_sentence(spark, sf_dir):
    d = T.each(B.paragraphs(books(spark, sf_dir)), ["doc_id", "part", "chapter", F.col("idx").alias("paragraph")], T.sentences(F.col("text")), "i", "s")
    return d.select("doc_id", "part", "chapter", "paragraph", (F.col("i") + 1).cast("long").alias("sentence"), T.word_count(F.col("s")).alias("words"), F.greatest(F.lit(1), F.size(T.clauses(F.col("s")))).cast("long").alias("clauses"))


@query(f"""WITH {_PARAS}, s AS (SELECT doc_id, part, chapter, idx AS paragraph, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS sentence FROM (SELECT *, {D.sentences('text')} AS l FROM pa WHERE idx IS NOT NULL))
    SELECT doc_id, part, chapter, paragraph, sentence, unnest(range(1, len(c) + 1)) AS clause, unnest(list_transform(c, lambda x: {D.word_count('x')})) AS words FROM (SELECT *, {D.clauses('s')} AS c FROM s)""")
def detail_clause(spark, sf_dir):
    d = T.each(B.paragraphs(books(spark, sf_dir)), ["doc_id", "part", "chapter", F.col("idx").alias("paragraph")], T.sentences(F.col("text")), "i", "s")
    d = T.each(d, ["doc_id", "part", "chapter", "paragraph", (F.col("i") + 1).cast("long").alias("sentence")], T.clauses(F.col("s")), "k", "c")
    return d.select("doc_id", "part", "chapter", "paragraph", "sentence", (F.col("k") + 1).cast("long").alias("clause"), T.word_count(F.col("c")).alias("words"))


@query(rf"""WITH {_PARAS}, w AS (SELECT doc_id, part, chapter, idx AS paragraph, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z0-9]+')) AS l FROM pa WHERE idx IS NOT NULL)
    SELECT doc_id, part, chapter, paragraph, count(*) AS words, CAST(sum(i * length(x)) AS BIGINT) AS weighted FROM (SELECT *, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM w) GROUP BY ALL""")
def detail_word(spark, sf_dir):
    d = T.each(B.paragraphs(books(spark, sf_dir)), ["doc_id", "part", "chapter", F.col("idx").alias("paragraph")], T.word_list(F.col("text")), "i", "w")
    return d.groupBy("doc_id", "part", "chapter", "paragraph").agg(F.count("*").alias("words"), F.sum((F.col("i") + 1) * F.length("w")).cast("long").alias("weighted"))


@query(f"WITH {_CNODES} SELECT doc_id, part, chapter, label, paragraphs, sentences, words, {_AVG} FROM cn WHERE chapter > 0")
def chapter_nodes(spark, sf_dir):
    return B.chapter_nodes(B.paragraph_nodes(books(spark, sf_dir))).where("chapter > 0").select("doc_id", "part", "chapter", "label", "paragraphs", "sentences", "words", "avg_sentences", "avg_words")


ORACLE_SQL["verse_chapters"] = ORACLE_SQL["verse_islands"].replace("min(verse) AS first_verse, ", "").replace("count(*) AS verses", "'Chapter ' || min(chapter) AS label, count(*) AS paragraphs")


@query(ORACLE_SQL["verse_chapters"])
def verse_chapters(spark, sf_dir):
    v = verse_islands(spark, sf_dir)
    return v.select("doc_id", "run", "chapter", F.concat(F.lit("Chapter "), F.col("chapter")).alias("label"), F.col("verses").alias("paragraphs"), "words")


@query(f"WITH {_CNODES} SELECT doc_id, part, part_label, count(*) AS children, CAST(sum(paragraphs) AS BIGINT) AS paragraphs, CAST(sum(words) AS BIGINT) AS words FROM cn WHERE part > 0 GROUP BY ALL")
def part_nodes(spark, sf_dir):
    return B.part_nodes(B.chapter_nodes(B.paragraph_nodes(books(spark, sf_dir)))).select("doc_id", "part", "part_label", "children", "paragraphs", "words")


_SUMMARY = f"""{_CNODES}, su AS (SELECT doc_id, schema, max(part) AS parts, count(*) FILTER (chapter > 0) AS chapters, CAST(sum(paragraphs) AS BIGINT) AS paragraphs, CAST(sum(sentences) AS BIGINT) AS sentences, CAST(sum(words) AS BIGINT) AS words, CAST(sum(tokens) AS BIGINT) AS tokens FROM cn GROUP BY ALL),
    summary AS (SELECT doc_id, schema, CASE WHEN chapters = 0 THEN paragraphs WHEN parts > 0 THEN parts ELSE chapters END AS top_nodes, CASE WHEN parts > 0 THEN chapters END AS mid_nodes, paragraphs, sentences, words, tokens,
        CASE WHEN chapters = 0 THEN 1.0::DOUBLE ELSE {D.ratio('paragraphs', 'greatest(chapters, 1)')} END AS avg_paragraphs, {_AVG} FROM su)"""


def summaries(spark, sf_dir) -> DataFrame:
    return B.summary(B.chapter_nodes(B.paragraph_nodes(books(spark, sf_dir))))


@query(f"WITH {_SUMMARY} SELECT * EXCLUDE (mid_nodes, tokens) FROM summary WHERE mid_nodes IS NULL")
def book_summary(spark, sf_dir):
    return summaries(spark, sf_dir).where("mid_nodes IS NULL").drop("mid_nodes", "tokens")


@query(f"WITH {_SUMMARY} SELECT * EXCLUDE (tokens) FROM summary WHERE mid_nodes IS NOT NULL")
def part_summary(spark, sf_dir):
    return summaries(spark, sf_dir).where("mid_nodes IS NOT NULL").drop("tokens")


@query(f"WITH {_SUMMARY} SELECT doc_id, tokens, words FROM summary")
def token_rollup(spark, sf_dir):
    return summaries(spark, sf_dir).select("doc_id", "tokens", "words")


@query(f"WITH {_CNODES} SELECT doc_id, part, chapter, label, paragraphs, words, true AS pruned FROM cn WHERE chapter > 0")
def no_paragraphs(spark, sf_dir):
    """Chapters without the list of their paragraphs, whose counts stay."""
    return B.chapter_tree(B.paragraph_nodes(books(spark, sf_dir)), include_paragraphs=False).where("chapter > 0").select("doc_id", "part", "chapter", "label", "paragraphs", "words", F.col("nodes").isNull().alias("pruned"))


@query(f"WITH {_PARAS} SELECT doc_id, part, chapter, label, count(idx) AS listed, CAST(sum(words) AS BIGINT) AS words, min(idx) AS first FROM nodes GROUP BY doc_id, part, chapter, label")
def with_paragraphs(spark, sf_dir):
    d = B.chapter_tree(B.paragraph_nodes(books(spark, sf_dir)))
    total = F.aggregate("nodes", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return d.select("doc_id", "part", "chapter", "label", F.size("nodes").cast("long").alias("listed"), F.when(F.size("nodes") > 0, total).alias("words"), F.array_min(F.transform("nodes", lambda x: x["idx"])).alias("first"))


@query(f"WITH {_SUMMARY} SELECT schema, count(*) AS books, count(DISTINCT words) AS distinct_words, quantile_cont(words, 0.5) AS median_words, quantile_cont(words, 0.9) AS p90_words, max(words) AS max_words FROM summary GROUP BY schema")
def schema_distribution(spark, sf_dir):
    return B.distribution(summaries(spark, sf_dir))


@query(f"WITH {_SUMMARY} SELECT * FROM summary")
def book_structure(spark, sf_dir):
    return summaries(spark, sf_dir)


@query(f"WITH {_CNODES} SELECT schema, part, chapter, CAST(grouping_id(schema, part, chapter) AS BIGINT) AS level, CAST(sum(paragraphs) AS BIGINT) AS paragraphs, CAST(sum(words) AS BIGINT) AS words FROM cn GROUP BY ROLLUP (schema, part, chapter)")
def structure_rollup(spark, sf_dir):
    d = B.chapter_nodes(B.paragraph_nodes(books(spark, sf_dir)))
    return d.rollup("schema", "part", "chapter").agg(F.grouping_id().cast("long").alias("level"), F.sum("paragraphs").alias("paragraphs"), F.sum("words").alias("words"))
