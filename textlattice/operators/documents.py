"""Single documents of any format to their semantic structure: dispatch, envelope and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textlattice.functions import patterns as P, text as T
from textlattice.operators import blocks as K, sections as S
from textlattice.sources.tables import MAX_BYTES, decode, resolve_format

#: Why a document has no structure.
TOO_LARGE, UNSUPPORTED, BINARY, NO_RUNS = "too large", "unsupported type", "binary content in a text document", "a PDF is read from its runs"


def canonical_type(content_type: Column, fmt: Column) -> Column:
    """The content type that is reported: the one that was given where it names a format, else the format's own."""
    given = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    own = F.create_map(*[F.lit(x) for kv in P.CANONICAL_TYPES.items() for x in kv])
    return F.when(fmt.isNotNull(), F.when(given.isin(list(P.CONTENT_TYPES)), given).otherwise(own[fmt]))


def title(blocks: DataFrame) -> DataFrame:
    """doc, title: the text of a document's first heading of the highest level that it has."""
    h = blocks.where("type = 'heading' AND text <> ''")
    return h.groupBy("doc").agg(F.min_by("text", F.struct("level", "pos")).alias("title"))


def envelope(files: DataFrame) -> DataFrame:
    """files: doc, content, and content_type, name, url where they are known.

    Adds format, content_type, size_bytes, sha256, text, and error where the document can't be analysed.
    """
    have = lambda c: F.col(c) if c in files.columns else F.lit(None).cast("string")
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    fmt = resolve_format(have("content_type"), F.coalesce(have("name"), have("url"), F.lit("")))
    text = decode(F.coalesce(F.col("content"), F.expr("x''")))
    d = files.select("doc", "content", have("name").alias("name"), have("url").alias("url"), fmt.alias("format"), canonical_type(have("content_type"), fmt).alias("content_type"), size.alias("size_bytes"), F.sha2(F.coalesce(F.col("content"), F.expr("x''")), 256).alias("sha256"))
    error = F.when(F.col("size_bytes") > MAX_BYTES, TOO_LARGE).when(F.col("format").isNull(), UNSUPPORTED).when(F.col("format") == "pdf", NO_RUNS).when(text.isNull(), BINARY)
    d = d.withColumn("error", error)
    return d.withColumn("text", F.when(F.col("error").isNull(), text)).drop("content")


def analyze_documents(files: DataFrame) -> DataFrame:
    """One row per document of files (doc, content, and content_type, name, url where they are known): envelope, title, totals.

    A document without blocks has zeros; one that can't be analysed has nulls and says why in error.
    """
    d = envelope(files)
    b = K.blocks_of(d.where("error IS NULL"))
    found = S.analyze(b).join(title(b), "doc", "left")
    sums = [*S.SUMS, "sections", "max_depth"]
    out = d.drop("text").join(found, "doc", "left")
    return out.select(*(c for c in d.columns if c != "text"), "title", *(F.when(F.col("error").isNull(), F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in sums))


def document_detail(files: DataFrame) -> DataFrame:
    """doc, section, pos, sentence (from 1), words, clauses of all prose of the documents."""
    d = S.retyped(K.blocks_of(envelope(files).where("error IS NULL"))).where(F.col("type").isin(S.PROSE))
    s = T.each(d, ["doc", "section", "pos"], T.sentences(F.col("text")), "i", "s")
    return s.select("doc", "section", "pos", (F.col("i") + 1).cast("long").alias("sentence"), T.word_count(F.col("s")).alias("words"), F.greatest(F.lit(1), F.size(T.clauses(F.col("s")))).cast("long").alias("clauses"))
