"""The training-corpus pipeline: five operators in a row over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textlattice.llm.common import cut_lineage, names_beside, read
from textlattice.llm.decontaminate import clean_documents
from textlattice.llm.exact_substring import NEW, substring_dedup
from textlattice.llm.language import accepted, fit, held_out
from textlattice.llm.mixing import DOMAINS, domain, mix
from textlattice.llm.simhash import first_of_groups


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: without letters, or far from every language."""
    return accepted(docs, fit(docs, ~held_out(F.col("doc_id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked wide fingerprints the document with the smallest id stays, once."""
    return first_of_groups(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are cut out; documents that consist of nothing else go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = substring_dedup(docs, carry=rest, keep_layout=True).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    own = dict(zip(rest, names_beside(rest, ["doc_id", *NEW]), strict=True)) | {"doc_id": "doc_id", "text": "kept"}
    n_chars = F.coalesce(F.length("kept"), F.lit(0)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*(n_chars.alias(c) if c == "n_chars" else F.col(own[c]).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark windows go."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rate at which each remaining document is to be taken, with its tokens and domain posteriors."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), domain(F.col("quality"), F.col("toxic")).alias("label"))
    out = mix(docs, labels)
    return out.select("doc_id", "n_tokens", *(F.col("posteriors")[i].alias(f"p_{n}") for i, n in enumerate(sorted(DOMAINS))), "rate")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
]

#: SQL can't express the trained stages; the tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
