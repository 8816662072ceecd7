"""Section trees over flat blocks: headings nest by level, without any stack or recursion.

blocks: doc, pos (order in the document), type, level (headings), text, and where blocks
nest also inside (the types of the blocks around each). Of each level the latest heading
so far is one running maximum; those that no later, higher heading has closed are the
open sections. Only headings at the root open sections. Windows are partitioned by
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlattice.functions import patterns as P, text as T

PROSE = ["paragraph", "list_item", "footnote"]
TYPES = ["heading", "paragraph", "list", "list_item", "table", "figure", "code_block", "blockquote", "footnote", "reference", "link"]
PREAMBLE = -1


def _open_sections(before_level: Column | None) -> Column:
    """Positions of the open sections, outermost first; before_level: only those of a smaller level."""
    def alive(k: int) -> Column:
        c = F.col(f"last{k}").isNotNull()
        if k > 1:
            c &= F.col(f"last{k}") > F.coalesce(F.greatest(*(F.coalesce(F.col(f"last{j}"), F.lit(-2)) for j in range(1, k)), F.lit(-2)), F.lit(-2))
        return c if before_level is None else c & (F.lit(k) < before_level)

    return F.filter(F.array(*(F.when(alive(k), F.col(f"last{k}")) for k in range(1, 7))), lambda x: x.isNotNull())


def opens(blocks: DataFrame) -> Column:
    """Whether a block is a heading that opens a section."""
    heading = F.col("type") == "heading"
    return heading & (F.size("inside") == 0) if "inside" in blocks.columns else heading


def headings(blocks: DataFrame) -> DataFrame:
    """doc, pos, level, text, ancestors (positions, outermost first), parent (null for none), idx among its siblings."""
    h = blocks.where(opens(blocks)).withColumn("level", F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce("level", F.lit(1)))))
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(1, 7):
        h = h.withColumn(f"last{k}", F.max(F.when(F.col("level") == k, F.col("pos"))).over(w))
    h = h.withColumn("ancestors", _open_sections(F.col("level")))
    h = h.select("doc", "pos", "level", "text", "ancestors", F.when(F.size("ancestors") > 0, F.element_at("ancestors", -1)).alias("parent"))
    return h.withColumn("idx", F.row_number().over(Window.partitionBy("doc", "parent").orderBy("pos")))


def paths(h: DataFrame) -> DataFrame:
    """Adds path, the dotted sibling numbers from the root."""
    up = h.select("doc", "pos", F.explode(F.concat("ancestors", F.array("pos"))).alias("at"))
    named = up.join(h.select("doc", F.col("pos").alias("at"), "idx"), ["doc", "at"])
    path = named.groupBy("doc", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "idx"))), lambda x: x["idx"].cast("string")), ".").alias("path"))
    return h.join(path, ["doc", "pos"])


def own_class(text: Column) -> Column:
    """What a heading makes of the prose under it, by its title alone."""
    t = T.strip(text)
    return F.when(t.rlike(f"(?iu){P.REFERENCES_HEADING}"), "reference").when(t.rlike(f"(?iu){P.NOTES_HEADING}"), "footnote")


def section_class(h: DataFrame) -> DataFrame:
    """Adds target: the class of the nearest section above or at it that has one."""
    mine = h.withColumn("own", own_class(F.col("text")))
    up = mine.select("doc", "pos", F.explode(F.concat("ancestors", F.array("pos"))).alias("at"))
    found = up.join(mine.where("own IS NOT NULL").select("doc", F.col("pos").alias("at"), "own"), ["doc", "at"]).groupBy("doc", "pos").agg(F.max_by("own", "at").alias("target"))
    return h.join(found, ["doc", "pos"], "left")


def with_section(blocks: DataFrame) -> DataFrame:
    """Adds section, the position of the heading that a block stands under (PREAMBLE before the first)."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(opens(blocks), F.col("pos")), ignorenulls=True).over(w)
    return blocks.withColumn("section", F.coalesce(last, F.lit(PREAMBLE)))


def retyped(blocks: DataFrame) -> DataFrame:
    """Paragraphs and list items under references and notes count as such, also within lists, quotes and each other."""
    target = section_class(headings(blocks)).select("doc", F.col("pos").alias("section"), "target")
    d = with_section(blocks).join(target, ["doc", "section"], "left")
    reached = F.col("target").isNotNull() & F.col("type").isin("paragraph", "list_item")
    if "inside" in blocks.columns:
        reached &= F.forall("inside", lambda t: t.isin("list", "blockquote", "list_item", "paragraph") | (t == F.col("target")))
    return d.withColumn("type", F.when(reached, F.col("target")).otherwise(F.col("type"))).drop("target")


def counts(typed: DataFrame) -> DataFrame:
    """doc, section, a count for each type, sentences and words of the prose. A heading counts in its own section."""
    prose = F.col("type").isin(PROSE)
    tallies = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES]
    if "links" in typed.columns:  # adapters count links on the block that holds them
        tallies[TYPES.index("link")] = F.sum("links").cast("long").alias("n_link")
    words = F.sum(F.when(prose, T.word_count(F.col("text"))).otherwise(0)).cast("long")
    sentences = F.sum(F.when(prose, T.sentence_count(F.col("text"))).otherwise(0)).cast("long")
    return typed.groupBy("doc", "section").agg(*tallies, sentences.alias("sentences"), words.alias("words"))


SUMS = [*(f"n_{t}" for t in TYPES), "sentences", "words"]


def totals(own: DataFrame, h: DataFrame) -> DataFrame:
    """doc, section and the counts of the section with all below it."""
    up = h.select("doc", F.col("pos").alias("section"), F.concat("ancestors", F.array("pos")).alias("all"))
    d = own.join(up, ["doc", "section"], "left").withColumn("at", F.explode(F.coalesce("all", F.array("section"))))
    return d.groupBy("doc", F.col("at").alias("section")).agg(*(F.sum(c).alias(c) for c in SUMS))


def document_totals(own: DataFrame, h: DataFrame) -> DataFrame:
    """One row per document: counts, sections (the preamble is one) and the depth of the tree."""
    depth = h.groupBy("doc").agg(F.max(F.size("ancestors") + 1).alias("max_depth"))
    d = own.groupBy("doc").agg(*(F.sum(c).alias(c) for c in SUMS), F.count("*").alias("sections"))
    return d.join(depth, "doc", "left").withColumn("max_depth", F.coalesce("max_depth", F.lit(1)).cast("long"))


def analyze(blocks: DataFrame) -> DataFrame:
    typed = retyped(blocks)
    return document_totals(counts(typed), headings(blocks))
