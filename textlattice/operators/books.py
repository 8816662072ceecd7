"""Books: schema detection, splitting into parts, chapters and paragraphs, and roll-ups.

A book is a row (doc_id, text). Every level is a flat node table; deeper levels are
only computed when something reads them, and roll-ups group on doc_id first, so one
exchange serves all levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlattice.functions import patterns as P, text as T
from textlattice.functions.tokens import Encoder, white_space
from textlattice.sources.epub import epub_parts

PIECES = "array<struct<label:string,content:string>>"


def once(df: DataFrame, keep: list[str], new: dict[str, Column]) -> DataFrame:
    """The columns named in keep and new ones, each worked out once a row: filters on them aren't pushed below, where they would be worked out again."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in new.items())))))


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern)).cast("long")


def caps_titles(x: Column, then: str = "") -> Column:
    """All-capital title lines without structural keywords; then: what must follow."""
    found = F.regexp_extract_all(x, F.lit(f"(?md)({P.CAPS_TITLE}){then}"), F.lit(1))
    return F.size(F.filter(found, lambda t: ~t.rlike(rf"(?i)(?<!{P.WORD_CHAR})(?:{P.KEYWORDS})(?!{P.WORD_CHAR})"))).cast("long")


def with_evidence(books: DataFrame) -> DataFrame:
    """Adds the seven counts that schema detection rests on."""
    t = F.col("text")
    blocks = F.filter(F.split(t, "\n\n", -1), lambda b: T.strip(b) != "")
    return once(books, books.columns, {
        "verses": count(t, r"(?mdU)^\d+:\d+[\s\x1c-\x1f]"),
        "parts": count(t, f"(?imdu){P.PART}"),
        "chapter_words": count(t, f"(?imdu){P.CHAPTER}"),
        "chapter_numerals": count(t, f"(?md){P.NUMERAL}"),
        "titles": caps_titles(t),
        "bylines": caps_titles(t, r"(?=[ \t]*\n+(?:[ \t]*\n)*[ \t]*(?i:By)[ \t]+[^\n]+)"),
        "blocks": F.size(blocks).cast("long"),
    })


EVIDENCE = ["verses", "parts", "chapter_words", "chapter_numerals", "titles", "bylines", "blocks"]


def strength(n: Column) -> Column:
    return F.when(n > 0, F.least(F.lit(0.9), F.round(F.lit(0.3) + n * 0.1, 2))).otherwise(0.0)


def with_scores(evidence: DataFrame) -> DataFrame:
    """Adds the support of each of the five schemas."""
    c = F.col
    chapters = F.greatest("chapter_words", "chapter_numerals")
    none = (c("verses") + c("parts") + chapters + c("titles")) == 0
    return evidence.withColumns({
        "s_scripture": F.when(c("verses") >= 10, strength(c("verses"))).otherwise(F.round(c("verses") * 0.03, 2)),
        "s_sectioned": F.when((c("parts") >= 2) & (c("chapter_words") >= 2), strength(c("parts") + c("chapter_words"))).otherwise(0.0),
        "s_standard": strength(chapters),
        "s_essay": F.least(strength(c("titles")), F.when(c("bylines") >= 2, 0.85).otherwise(0.65)),
        "s_flat": F.when(none, 0.2).otherwise(0.1),
    })


SCORES = ["s_scripture", "s_sectioned", "s_standard", "s_essay", "s_flat"]


def detect(scores: DataFrame, override: Column | None = None) -> DataFrame:
    """Adds detected, markers_found, score, confidence, schema (the override where there is one) and overridden."""
    c = F.col
    chapters = F.greatest("chapter_words", "chapter_numerals")
    rules = [(c("verses") >= 10, 0, c("verses")), ((c("parts") >= 2) & (c("chapter_words") >= 2), 1, c("parts") + c("chapter_words")), (chapters >= 2, 2, chapters), (c("titles") >= 2, 3, c("titles"))]
    name, markers, own = F.lit(P.SCHEMAS[4][0]), c("blocks"), c("s_flat")
    for test, k, n in reversed(rules):
        name, markers, own = F.when(test, P.SCHEMAS[k][0]).otherwise(name), F.when(test, n).otherwise(markers), F.when(test, c(SCORES[k])).otherwise(own)
    families = sum(x.cast("int") for x in (c("verses") >= 10, chapters >= 2, c("titles") >= 2))
    score = F.when(families > 1, F.least(own, F.lit(0.6))).otherwise(own)
    override = F.lit(None).cast("string") if override is None else override
    out = scores.withColumns({"detected": name, "markers_found": markers.cast("long"), "score": score})
    confidence = F.when(c("score") >= 0.8, "high").when(c("score") >= 0.5, "medium").otherwise("low")
    out = out.withColumns({"confidence": confidence, "schema": F.coalesce(override, c("detected")), "overridden": override.isNotNull()})
    return once(out, scores.columns, {n: c(n) for n in ("detected", "markers_found", "score", "confidence", "schema", "overridden")})


def split_on(x: Column, pattern: str) -> Column:
    """(heading, text up to the next heading) of every match, stripped; what stands before the first is dropped."""
    marked = F.regexp_replace(F.translate(x, "\x01\x02", "  "), pattern, "\x01$0\x02")
    parts = F.split(marked, "\x01", -1)
    return F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
        lambda p: F.struct(T.strip(F.split_part(p, F.lit("\x02"), F.lit(1))).alias("label"), T.strip(F.split_part(p, F.lit("\x02"), F.lit(2))).alias("content")),
    )


CHAPTERS, NUMERALS, TITLES, PARTS = f"(?imdu){P.CHAPTER}", f"(?md){P.NUMERAL}", f"(?md){P.CAPS_TITLE}", f"(?imdu){P.PART}"
SCRIPTURE = f"(?idu){P.SCRIPTURE_BOOK}"


def whole(x: Column) -> Column:
    return F.array(F.struct(F.lit("").alias("label"), x.alias("content"))).cast(PIECES)


def parts(books: DataFrame) -> DataFrame:
    """One row per part: doc_id, schema, part (1, 2, ...; 0 where the book has no such level), part_label, content."""
    t, s = F.col("text"), F.col("schema")
    by_part = split_on(t, PARTS)
    by_book = F.filter(split_on(t, SCRIPTURE), lambda b: b["content"].rlike(r"(?mdU)^\d+:\d+[\s\x1c-\x1f]"))
    d = books.withColumn("p", F.when(s == "canonical_scripture", by_book).when(s == "sectioned_book", by_part))
    # scripture without books falls back to parts, and those to chapters
    d = d.withColumn("kind", F.when((s == "canonical_scripture") & (F.size("p") > 0), "book").when(s.isin("canonical_scripture", "sectioned_book"), "part").otherwise("none"))
    d = d.withColumn("p", F.when((F.col("kind") == "part") & (s == "canonical_scripture"), by_part).otherwise(F.col("p")))
    d = d.withColumn("kind", F.when((F.col("kind") == "part") & (F.size("p") == 0), "none").otherwise(F.col("kind")))
    d = d.withColumn("p", F.when(F.col("kind") == "none", whole(t)).otherwise(F.col("p")))
    d = T.each(d, ["doc_id", "schema", "kind"], F.col("p"), "i", "x")
    label = F.when(F.col("x.label") != "", F.col("x.label")).otherwise(F.concat(F.initcap("kind"), F.lit(" "), F.col("i") + 1))
    return d.select("doc_id", "schema", "kind", F.when(F.col("kind") == "none", 0).otherwise(F.col("i") + 1).cast("long").alias("part"), F.when(F.col("kind") != "none", label).alias("part_label"), F.col("x.content").alias("content"))


def chapters(books: DataFrame) -> DataFrame:
    """One row per chapter or essay: doc_id, schema, kind, part, part_label, chapter (0 for a flat text), label, content.

    Scripture without chapter headings is left as one row per book, for ``verses`` to cut.
    """
    c, s = F.col("content"), F.col("schema")
    none = F.array().cast(PIECES)
    by_word = F.when(s == "flat", none).when(s == "essay_or_story_collection", split_on(c, TITLES)).otherwise(split_on(c, CHAPTERS))
    d = parts(books)
    d = once(d, d.columns, {"w": by_word})
    # numerals count where no chapter word does
    d = once(d, d.columns, {"ch": F.when((F.size("w") == 0) & s.isin("standard_book", "sectioned_book", "canonical_scripture") & (F.col("kind") != "book"), split_on(c, NUMERALS)).otherwise(F.col("w"))})
    d = d.withColumn("bare", F.size("ch") == 0)
    d = T.each(d, ["doc_id", "schema", "kind", "part", "part_label", "bare"], F.when(F.col("bare"), whole(c)).otherwise(F.col("ch")), "i", "x")
    flat = F.col("bare") & (F.col("kind") == "none")
    word = F.when(s == "essay_or_story_collection", "Essay").otherwise("Chapter")
    label = F.when(F.col("x.label") != "", F.col("x.label")).otherwise(F.concat(word, F.lit(" "), F.col("i") + 1))
    return d.select("doc_id", "schema", "kind", "part", "part_label", "bare", F.when(flat, 0).otherwise(F.col("i") + 1).cast("long").alias("chapter"), F.when(~flat, label).alias("label"), F.col("x.content").alias("content"))


def verses(content_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Verses of texts without chapter headings: runs of one chapter number make a chapter (run), the number may come again."""
    marked = F.regexp_replace(F.translate("content", "\x01\x02", "  "), f"(?mdU){P.VERSE_MARK}", "\x01$1:$2\x02")
    cut = F.split(marked, "\x01", -1)
    d = T.each(content_rows, keys, F.slice(cut, 2, F.greatest(F.size(cut), F.lit(1))), "pos", "x")
    head = F.split_part("x", F.lit("\x02"), F.lit(1))
    d = d.select(*keys, "pos", F.split_part(head, F.lit(":"), F.lit(1)).cast("long").alias("chapter"), F.split_part(head, F.lit(":"), F.lit(2)).cast("long").alias("verse"), T.strip(F.split_part("x", F.lit("\x02"), F.lit(2))).alias("text")).where("text <> ''")
    w = Window.partitionBy(*keys).orderBy("pos")
    new = F.coalesce((F.col("chapter") != F.lag("chapter").over(w)).cast("long"), F.lit(1))
    return d.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def verse_pieces(c: Column) -> Column:
    """Verses under a chapter heading: cut at verse marks, at least 3 characters; paragraphs where there is none."""
    v = F.filter(F.transform(F.split(c, r"(?mdU)^\d+:\d+[\s\x1c-\x1f]", -1), T.strip), lambda x: F.length(x) >= 3)
    return F.when(F.size(v) > 0, v).otherwise(T.paragraphs(c))


NODE = ["doc_id", "schema", "kind", "part", "part_label", "chapter", "label"]


def _pieces(books: DataFrame) -> DataFrame:
    """One row per paragraph or verse in order (i), and one with null i for a chapter without any.

    Verses of scripture without chapter headings carry their chapter and verse numbers (c, v).
    """
    x = F.col("content")
    bare = (F.col("kind") == "book") & F.col("bare") & x.rlike(f"(?mdU){P.VERSE_MARK}")
    marked = F.split(F.regexp_replace(F.translate(x, "\x01\x02", "  "), f"(?mdU){P.VERSE_MARK}", "\x01$1:$2\x02"), "\x01", -1)
    head = lambda m, k: F.split_part(F.split_part(m, F.lit("\x02"), F.lit(1)), F.lit(":"), F.lit(k)).cast("long")
    piece = lambda c, v, t: F.struct(c.cast("long").alias("c"), v.cast("long").alias("v"), t.alias("text"))
    verses = F.transform(F.slice(marked, 2, F.greatest(F.size(marked), F.lit(1))), lambda m: piece(head(m, 1), head(m, 2), T.strip(F.split_part(m, F.lit("\x02"), F.lit(2)))))
    none = F.lit(None)
    whole_pieces = lambda a: F.transform(a, lambda t: piece(none, none, t))
    found = F.when(bare, F.filter(verses, lambda p: p["text"] != "")).when(F.col("kind") == "book", whole_pieces(verse_pieces(x))).otherwise(whole_pieces(T.paragraphs(x)))
    d = chapters(books).select(*NODE, F.posexplode_outer(found).alias("i", "p"))
    return d.select(*NODE, "i", "p.c", "p.v", "p.text")


def _numbered(pieces: DataFrame) -> DataFrame:
    """Verses with numbers of their own get chapters by runs of one chapter number; all pieces get their idx."""
    w = Window.partitionBy("doc_id", "part").orderBy("chapter", "i")
    new = F.when(F.col("c").isNotNull(), F.coalesce((F.col("c") != F.lag("c").over(w)).cast("long"), F.lit(1)))
    d = pieces.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.col("c").isNotNull()
    d = d.withColumns({"chapter": F.when(own, F.col("run")).otherwise(F.col("chapter")), "label": F.when(own, F.concat(F.lit("Chapter "), F.col("c"))).otherwise(F.col("label")), "idx": F.coalesce(F.col("v"), (F.col("i") + 1).cast("long"))})
    return d.drop("i", "c", "v", "new", "run")


def paragraphs(books: DataFrame) -> DataFrame:
    """One row per paragraph or verse, and one with null idx for a chapter without any: NODE, idx, text."""
    return _numbered(_pieces(books)).select(*NODE, "idx", "text")


def role(x: Column) -> Column:
    """illustration or heading, else null; a heading's pattern can't match a long paragraph, so only short ones are tried."""
    p = T.strip(x)
    heading = p.rlike(rf"(?idu)\A(?:{P.CHAPTER[1:-1]})\z") | p.rlike(rf"(?idu)\A(?:{P.PART[1:-1]})\z")
    short = F.length(p) <= 200
    return F.when(p.startswith("["), F.when(p.rlike(r"(?is)\A\[Illustration(?:\s*:.*)?\]\z"), "illustration")).when(short, F.when(heading, "heading"))


def paragraph_nodes(books: DataFrame, encoder: Encoder | None = white_space) -> DataFrame:
    """Counts of each paragraph: sentences (at least 1), words, tokens (null without an encoder), average, role."""
    t = F.col("text")
    sentences = F.when(t.isNotNull(), F.greatest(F.lit(1), T.sentence_count(t)))
    tokens = encoder(t).cast("long") if encoder else F.lit(None).cast("long")
    # counted before rows are dealt by document, so no text is shuffled
    d = _pieces(books)
    d = once(d, [*NODE, "i", "c", "v"], {"sentences": sentences, "words": T.word_count(t), "tokens": tokens, "role": role(t)})
    d = _numbered(d)
    return d.withColumn("avg_words", T.ratio(F.col("words"), F.col("sentences")))


def _least_one(c: str) -> Column:
    return F.greatest(F.col(c), F.lit(1))


def chapter_nodes(nodes: DataFrame, with_tokens: bool = True) -> DataFrame:
    """From paragraph nodes; chapters without paragraphs keep zeros. with_tokens: the paragraphs were encoded; else all tokens are null."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    tokens = s("tokens") if with_tokens else F.max("tokens")
    d = nodes.groupBy(*NODE).agg(F.count("idx").alias("paragraphs"), s("sentences").alias("sentences"), s("words").alias("words"), tokens.alias("tokens"))
    return d.withColumns({"avg_sentences": T.ratio(F.col("sentences"), _least_one("paragraphs")), "avg_words": T.ratio(F.col("words"), _least_one("sentences"))})


def chapter_tree(nodes: DataFrame, include_paragraphs: bool = True) -> DataFrame:
    """Chapter rows with nodes, the list of their paragraphs' counts in order; null where paragraphs are left out."""
    one = F.struct(*("idx", "sentences", "words", "tokens", "avg_words", "role"))
    listed = F.array_sort(F.filter(F.collect_list(F.when(F.col("idx").isNotNull(), one)), lambda x: x.isNotNull())) if include_paragraphs else F.lit(None)
    keys, s = [F.col(c) for c in NODE], lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return nodes.groupBy(*keys).agg(F.count("idx").alias("paragraphs"), s("sentences").alias("sentences"), s("words").alias("words"), listed.alias("nodes") if include_paragraphs else F.max(listed).alias("nodes"))


def part_nodes(chapter_rows: DataFrame) -> DataFrame:
    d = chapter_rows.where("part > 0").groupBy("doc_id", "schema", "kind", "part", "part_label")
    return d.agg(F.count("*").alias("children"), *(F.sum(c).alias(c) for c in ("paragraphs", "sentences", "words", "tokens")))


def summary(chapter_rows: DataFrame) -> DataFrame:
    """One row per book: ratios are ratios of sums."""
    sums = [F.sum(c).alias(c) for c in ("paragraphs", "sentences", "words", "tokens")]
    d = chapter_rows.groupBy("doc_id", "schema").agg(F.max("part").alias("parts"), F.count_if(F.col("chapter") > 0).alias("chapters"), *sums)
    flat = F.col("chapters") == 0
    top = F.when(flat, F.col("paragraphs")).when(F.col("parts") > 0, F.col("parts")).otherwise(F.col("chapters"))
    return d.select(
        "doc_id", "schema", top.alias("top_nodes"), F.when(F.col("parts") > 0, F.col("chapters")).alias("mid_nodes"), "paragraphs", "sentences", "words", "tokens",
        F.when(flat, 1.0).otherwise(T.ratio(F.col("paragraphs"), _least_one("chapters"))).alias("avg_paragraphs"),
        T.ratio(F.col("sentences"), _least_one("paragraphs")).alias("avg_sentences"), T.ratio(F.col("words"), _least_one("sentences")).alias("avg_words"),
    )


def distribution(summaries: DataFrame) -> DataFrame:
    """Per schema: books, distinct word counts, and the middle, ninth tenth and largest number of words."""
    return summaries.groupBy("schema").agg(F.count("*").alias("books"), F.count_distinct("words").alias("distinct_words"), F.percentile("words", 0.5).alias("median_words"), F.percentile("words", 0.9).alias("p90_words"), F.max("words").alias("max_words"))


def analyze_books(books: DataFrame, override: Column | None = None, encoder: Encoder | None = white_space) -> DataFrame:
    """Detection and summary of every (doc_id, text): the whole way from raw text."""
    clean = once(books, ["doc_id"], {"text": T.preprocess(F.col("text"))})
    d = detect(with_scores(with_evidence(clean)), override)
    found = d.select("doc_id", "detected", "score", "confidence", "markers_found")
    return summary(chapter_nodes(paragraph_nodes(d, encoder), encoder is not None)).join(found, "doc_id")


def analyze_epubs(files: DataFrame, override: Column | None = None) -> DataFrame:
    """files: path, content. The same for EPUB files, whose parts are read in spine order; unreadable files come with error."""
    parts = epub_parts(files)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    whole_books = parts.where("error IS NULL").groupBy(F.col("path").alias("doc_id")).agg(text.alias("text"), F.first("title").alias("title"), F.first("language").alias("language"))
    out = analyze_books(whole_books, override).join(whole_books.select("doc_id", "title", "language"), "doc_id")
    return out.withColumnRenamed("doc_id", "path").unionByName(parts.where("error IS NOT NULL").select("path", "error"), allowMissingColumns=True)
