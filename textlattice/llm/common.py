"""Shared plumbing of the operators: grouping of documents, size bounds, checkpoints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text in one group of documents (one Python call), and of exchanged keys in one bucket.
GROUP_BYTES = 3 << 20
BUCKET_BYTES = 12 << 20
LAST_ID = np.iinfo(np.int64).max


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(df: DataFrame, col: Column) -> int:
    return int(df.agg(F.sum(F.octet_length(col)).alias("n")).first()["n"] or 0)


def parts_for(n_bytes: int, each: int) -> int:
    return max(1, -(-n_bytes // each))


def power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the folder that the session names in spark.checkpoint.dir; without one only a local session gets one of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def grouped_docs(docs: DataFrame, id_col: str, text_col: str, n_groups: int, carry: list[str] = ()) -> DataFrame:
    """id, real (the id isn't null), text, a group number g that depends on id and text, and columns to carry as c0, c1, ...

    A null id takes the place of the largest in all comparisons. The text counts for the group too, so that no group
    gathers the rows of an id that many share.
    """
    key, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    g = F.pmod(F.xxhash64(key, text), F.lit(n_groups)).cast("int")
    return docs.select(F.coalesce(key, F.lit(LAST_ID)).alias("id"), key.isNotNull().alias("real"), text.alias("text"), g.alias("g"), *(docs[c].alias(f"c{i}") for i, c in enumerate(carry)))


def names_beside(keep: list[str], new: list[str]) -> list[str]:
    """Names of the kept columns in a result that has the new ones too: a name that is taken gets _in at its end."""
    out: list[str] = []
    for name in keep:
        while name in new or name in out:
            name += "_in"
        out.append(name)
    return out


def kept_columns(df: DataFrame, keep: list[str], new: list[str]) -> tuple[list[Column], list[str], list[str]]:
    """The kept columns under names that nothing else has, their names in the result, and these with their types."""
    names, kinds = names_beside(keep, new), dict(df.dtypes)
    return [df[k].alias(f"_kept{i}") for i, k in enumerate(keep)], names, [f"`{n}` {kinds[k]}" for n, k in zip(names, keep, strict=True)]
