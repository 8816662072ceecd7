"""python -m textlattice FILE: the structure of one Markdown, HTML or text file as JSON."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="textlattice", description="Counts of a document's blocks, sections, sentences and words, as JSON.")
    parser.add_argument("file", type=Path)
    path = parser.parse_args(args).file

    from pyspark.sql import SparkSession

    from textlattice.operators import documents as O

    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    d = spark.createDataFrame([(path.name, path.read_bytes())], "doc string, content binary").selectExpr("doc", "content", "doc AS name")
    (row,) = O.analyze_documents(d).collect()
    print(json.dumps({k: v for k, v in row.asDict().items() if v is not None and k not in ("doc", "url")}, indent=2))


if __name__ == "__main__":
    main()
