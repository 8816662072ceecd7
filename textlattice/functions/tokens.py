"""Token counts of texts by an encoder that the caller chooses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import LongType

Encoder = Callable[[Column], Column]


def white_space(x: Column) -> Column:
    """The stand-in encoder: tokens between white space."""
    return F.regexp_count(x, F.lit(r"[^ \t\n\r\x0b\x0c]++")).cast("long")


_LOADED: dict[str, object] = {}


def from_file(spark: SparkSession, path: str) -> Encoder:
    """Counts by a tokenizer file (JSON), without special tokens. The driver reads the file, workers get its text once."""
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def count(x: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        if path not in _LOADED:
            _LOADED[path] = Tokenizer.from_str(shared.value)
        own = [v for v in x if v is not None]
        sizes = iter([len(e.ids) for e in _LOADED[path].encode_batch(own, add_special_tokens=False)])
        return pd.Series([None if v is None else next(sizes) for v in x], dtype="Int64")

    return F.pandas_udf(count, LongType())
