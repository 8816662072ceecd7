"""Provider payloads (one JSON page a row) to typed catalog records, strictly checked.

A page counts as a whole: where any of it isn't what its provider documents, none of
its records are taken and error says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textlattice.functions import values as V
from textlattice.operators.catalog import PAGE_SIZE

RECORD = ["source", "id", "title", "authors", "language", "publication_date", "kind", "categories", "url"]
# What the providers' pages hold.
GUTENDEX = "count long, results array<struct<id: long, title: string, authors: array<struct<name: string>>, languages: array<string>, subjects: array<string>>>"
OPENALEX = "meta struct<count: long, page: long, per_page: long>, results array<struct<id: string, title: string, display_name: string, authorships: array<struct<author: struct<display_name: string>>>, language: string, publication_date: string, type: string, primary_topic: struct<domain: struct<id: string>>>>"
DOMAIN = r"\Ahttps://openalex\.org/domains/[1-4]\z"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _strings(a: Column, empty: Column | None = None) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def _checked(pages: DataFrame, schema: str, count: Column, ok: Column, page: Column) -> DataFrame:
    """Adds p (the parsed page) and error. count, ok: of p; page: which page was asked for."""
    d = pages.withColumn("p", F.from_json("payload", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    size = F.size(F.col("p.results"))
    left = F.greatest(count - (page - 1) * PAGE_SIZE, F.lit(0))
    fits = (size <= PAGE_SIZE) & (size <= left) & ~((size == 0) & (left > 0))
    good = F.col("p._corrupt").isNull() & F.col("p.results").isNotNull() & (count >= 0) & fits & F.forall("p.results", lambda r: F.coalesce(ok(r), F.lit(False)))
    return d.withColumn("error", F.when(~F.coalesce(good, F.lit(False)), "invalid catalog metadata"))


def gutendex(pages: DataFrame) -> DataFrame:
    """pages: payload, page (from 1). One row per record with page, count and RECORD; one with error for an invalid page."""
    ok = lambda r: (r["id"] > 0) & (F.length(r["title"]) > 0) & F.forall(F.coalesce(r["authors"], F.array().cast("array<struct<name: string>>")), lambda a: a["name"].isNotNull()) & ~F.coalesce(F.exists(r["languages"], lambda x: x.isNull()) | F.exists(r["subjects"], lambda x: x.isNull()), F.lit(False))
    d = _checked(pages, GUTENDEX, F.col("p.count"), ok, F.col("page")).withColumn("r", F.explode_outer(F.when(F.col("error").isNull(), F.col("p.results")).otherwise(F.array(F.lit(None)))))
    r = F.col("r")
    return d.select(
        "page", "error", F.when(F.col("error").isNull(), F.col("p.count")).alias("count"), F.when(r.isNotNull(), "gutendex").alias("source"), r["id"].cast("string").alias("id"), r["title"].alias("title"), _strings(F.transform(r["authors"], lambda a: a["name"])).alias("authors"),
        F.array_join(_strings(r["languages"]), ",").alias("language"), _none("date").alias("publication_date"), F.when(r.isNotNull(), "book").alias("kind"), _strings(F.transform(r["subjects"], lambda s: F.concat(F.lit("subject:"), s))).alias("categories"), F.concat(F.lit("https://www.gutenberg.org/ebooks/"), r["id"].cast("string")).alias("url"),
    ).where(F.col("id").isNotNull() | F.col("error").isNotNull())


def openalex(pages: DataFrame) -> DataFrame:
    """pages: payload, page (from 1). One row per record with page, count and RECORD; one with error for an invalid page."""
    work = lambda r: F.regexp_replace(r["id"], r"\Ahttps://openalex\.org/", "")
    title = lambda r: F.coalesce(r["title"], r["display_name"])

    def ok(r: Column) -> Column:
        authors = F.forall(F.coalesce(r["authorships"], F.array().cast("array<struct<author: struct<display_name: string>>>")), lambda a: a["author"]["display_name"].isNotNull())
        domain, day = r["primary_topic"]["domain"], r["publication_date"]
        return V.is_work_id(work(r)) & (F.length(title(r)) > 0) & authors & (domain.isNull() | domain["id"].rlike(DOMAIN)) & (day.isNull() | V.iso_day(day).isNotNull())

    d = _checked(pages, OPENALEX, F.col("p.meta.count"), ok, F.col("page"))
    meta = F.coalesce(F.col("p.meta.page") == F.col("page"), F.lit(True)) & F.coalesce(F.col("p.meta.per_page") == PAGE_SIZE, F.lit(True))
    d = d.withColumn("error", F.coalesce("error", F.when(~meta, "invalid catalog metadata")))
    d = d.withColumn("r", F.explode_outer(F.when(F.col("error").isNull(), F.col("p.results")).otherwise(F.array(F.lit(None)))))
    r = F.col("r")
    domain = F.element_at(F.split(r["primary_topic"]["domain"]["id"], "/"), -1)
    return d.select(
        "page", "error", F.when(F.col("error").isNull(), F.col("p.meta.count")).alias("count"), F.when(r.isNotNull(), "openalex").alias("source"), work(r).alias("id"), title(r).alias("title"), _strings(F.transform(r["authorships"], lambda a: a["author"]["display_name"])).alias("authors"),
        F.coalesce(r["language"], F.lit("")).alias("language"), V.iso_day(r["publication_date"]).alias("publication_date"), F.coalesce(r["type"], F.lit("")).alias("kind"), F.when(domain.isNotNull(), F.array(F.concat(F.lit("domain:"), domain))).otherwise(_strings(_none("array<string>"))).alias("categories"), F.concat(F.lit("https://openalex.org/"), work(r)).alias("url"),
    ).where(F.col("id").isNotNull() | F.col("error").isNotNull())
