"""Writers: JSON rows, versioned results, and merges into parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_json(rows: DataFrame, path: str) -> None:
    """One object a row; nulls are left out."""
    rows.write.mode("errorifexists").json(path)


def append_result(rows: DataFrame, path: str) -> None:
    """rows: record_id, version, json. Old versions stay."""
    rows.select("record_id", "version", "json").write.mode("append").parquet(path)


def latest_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("record_id").agg(F.max("version").alias("version"), F.max_by("json", "version").alias("json"))


def upsert(spark: SparkSession, rows: DataFrame, path: str, key: str, previous: str | None = None) -> None:
    """A new table at path: rows of previous whose key isn't among the new ones, and the new ones."""
    if previous is None:
        rows.write.mode("errorifexists").parquet(path)
    else:
        spark.read.parquet(previous).join(rows.select(key), key, "left_anti").unionByName(rows).write.mode("errorifexists").parquet(path)
