"""Streams of arriving documents and scans: the batch expressions, incrementally. An extension of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from textlattice.functions import text as T


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def fresh(docs: DataFrame, key: str, ts: str, ttl: str = "24 hours") -> DataFrame:
    """A key counts once within its time to live."""
    return docs.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def windowed_counts(docs: DataFrame, ts: str, text: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Words and documents by time window; a window is given once it can't change any more."""
    d = docs.withWatermark(ts, late).select(F.window(ts, width).alias("w"), T.word_count(F.col(text)).alias("words"))
    return d.groupBy("w").agg(F.count("*").alias("docs"), F.sum("words").alias("words")).select("w.start", "w.end", "docs", "words")


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    d = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return d.select(key, "w.start", "w.end", "events")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
