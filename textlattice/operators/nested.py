"""Node tables to nested documents and JSON, and how nodes are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlattice.functions import text as T


def nest(children: DataFrame, parent: list[str], order: str, fields: list[str], name: str) -> DataFrame:
    """One row per parent with its children as an array in their order. A parent is a part of one document."""
    one = F.struct(F.col(order), *(F.col(f) for f in fields if f != order))
    return children.groupBy(*parent).agg(F.array_sort(F.collect_list(one)).alias(name))


def book_json(summary: DataFrame, chapters: DataFrame) -> DataFrame:
    """doc_id, json: the summary with parts and chapters below it; absent values are left out."""
    fields = ["chapter", "label", "paragraphs", "sentences", "words", "tokens", "avg_sentences", "avg_words"]
    parts = nest(chapters, ["doc_id", "part", "part_label"], "chapter", fields, "chapters")
    tree = nest(parts, ["doc_id"], "part", ["part", "part_label", "chapters"], "parts")
    d = summary.join(tree, "doc_id")
    return d.select("doc_id", F.to_json(F.struct(*(c for c in d.columns))).alias("json"))


def path_index(tree: DataFrame, first_open: int = 1) -> DataFrame:
    """doc, path, depth (from 1), order (depth first), open: sections by their paths, those above first_open levels expanded.

    tree: doc, path (dotted sibling numbers).
    """
    steps = F.transform(F.split("path", r"\."), lambda x: x.cast("int"))
    d = tree.withColumns({"depth": F.size(steps), "at": steps})
    return d.withColumn("order", F.row_number().over(Window.partitionBy("doc").orderBy("at"))).withColumn("open", F.col("depth") <= first_open).drop("at")


def as_nodes(sections: DataFrame) -> DataFrame:
    """Section rows (doc, path, text, counts with all below) as generic tree nodes: id, parent, label, words, sentences, average words of a sentence."""
    parent = F.regexp_replace("path", r"\.?[0-9]+$", "")
    words, sentences = F.coalesce("words", F.lit(0)), F.coalesce("sentences", F.lit(0))
    return sections.select("doc", F.concat(F.lit("n"), "path").alias("id"), F.when(parent != "", F.concat(F.lit("n"), parent)).alias("parent"), F.col("text").alias("label"), words.alias("words"), sentences.alias("sentences"), T.ratio(words, F.greatest(sentences, F.lit(1))).alias("avg_words"))


def shown(pairs: DataFrame) -> DataFrame:
    """Metadata (name, value) without what is empty: null, blank, or an empty list written as JSON."""
    return pairs.where(F.col("value").isNotNull() & ~F.trim("value").isin("", "[]", "{}", "null"))


def node_label(kind: Column, index: Column, label: Column) -> Column:
    """A node's own label, else its kind and number."""
    return F.coalesce(F.nullif(label, F.lit("")), F.concat(F.initcap(kind), F.lit(" "), index.cast("string")))


def described(n: Column, word: str) -> Column:
    """A count with its noun: 1 word, 1,234 words."""
    return F.concat(F.format_number(n, 0), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
