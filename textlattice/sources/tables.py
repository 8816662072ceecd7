"""Scans: parquet tables, raw files, and byte decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textlattice.functions import patterns as P

MAX_BYTES = 20 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores is dealt out to all of them; others stay as they are.

    Small files have one row group, which one task reads; what is worked out per row would stay in that task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file within the size limit: path, content."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= MAX_BYTES).select("path", "content")


def decode(b: Column) -> Column:
    """UTF-8 where the bytes are, else Latin-1; a leading byte order mark goes; null where the start holds a zero byte."""
    text = F.when(F.is_valid_utf8(b.cast("string")), F.decode(b, "UTF-8")).otherwise(F.decode(b, "ISO-8859-1"))
    zero = F.locate("\u0000", F.decode(F.substring(b, 1, 4096), "ISO-8859-1")) > 0
    return F.when(~zero, F.regexp_replace(text, "^﻿", ""))


def resolve_format(content_type: Column, name: Column) -> Column:
    """The format of an upload by its content type; by its extension only where the type is generic."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    by_type = F.create_map(*[F.lit(x) for kv in P.CONTENT_TYPES.items() for x in kv])
    by_ext = F.create_map(*[F.lit(x) for kv in P.EXTENSIONS.items() for x in kv])
    ext = F.regexp_extract(F.lower(F.split_part(name, F.lit("?"), F.lit(1))), r"[^/](\.[^./]+)$", 1)
    return F.coalesce(by_type[kind], F.when(kind.isin(P.GENERIC_TYPES), by_ext[ext]))


def sanitize_filename(name: Column) -> Column:
    """The base name; runs of anything but letters, digits, dot, underscore and dash become a dash; the ends lose dashes and dots."""
    base = F.regexp_replace(name, r"^(?s:.*)[/\\]", "")
    clean = F.regexp_replace(F.regexp_replace(base, r"[^a-zA-Z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("book.epub"))
