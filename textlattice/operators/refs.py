"""Positional references into annotated corpora: parse, format, resolve, serialise, normalise.

A reference is ``[corpus[@version]/]section(:section)*[!typeN[-N]]``; sections with
reserved characters are quoted, quotes inside doubled. Errors are columns, not
exceptions, so that one bad reference doesn't end a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SECTION = r'(?:"(?:[^"]|"")*"|[^:/!@"\s]+)'
SHORT = rf"^(?:([^/:@!\"]+)(?:@([^/:@!\"]+))?/)?({SECTION}(?::{SECTION})*)(?:!([A-Za-z0-9_]+)([1-9][0-9]*)(?:-([1-9][0-9]*))?)?\z"
URN = r"^urn:tf:([^/:@!]+)(?:@([^/:@!]+))?:([^:!]+(?::[^:!]+)*)(?:!([A-Za-z0-9_]+)([1-9][0-9]*)(?:-([1-9][0-9]*))?)?\z"


def _group(x: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, k), F.lit(""))


def parse(refs: DataFrame, col: str = "ref") -> DataFrame:
    """Adds corpus_id, version, sections, otype, start_at, end_at and error. The type takes as many digits as it can."""
    x = F.col(col)
    urn = x.startswith("urn:tf:")
    part = lambda k: F.when(urn, _group(x, URN, k)).otherwise(_group(x, SHORT, k))
    quoted = F.transform(
        F.regexp_extract_all(part(3), F.lit(f"({SECTION})"), F.lit(1)),
        lambda s: F.when(s.startswith('"'), F.replace(F.substring(s, F.lit(2), F.length(s) - 2), F.lit('""'), F.lit('"'))).otherwise(s),
    )
    plain = F.transform(F.split(part(3), ":"), lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))
    bad_escape = urn & part(3).rlike("%(?![0-9A-Fa-f]{2})")
    start, end = part(5).cast("long"), part(6).cast("long")
    error = (
        F.when(x.isNull() | (x == ""), "empty")
        .when(urn & ~x.rlike(URN) | ~urn & ~x.rlike(SHORT), "syntax")
        .when(bad_escape, "percent escape")
        .when(end < start, "descending range")
    )
    d = refs.withColumn("error", error)
    ok = F.col("error").isNull()
    sections = F.when(urn, plain).otherwise(quoted)
    return d.withColumns({"corpus_id": F.when(ok, part(1)), "version": F.when(ok, part(2)), "sections": F.when(ok, sections), "otype": F.when(ok, part(4)), "start_at": F.when(ok, start), "end_at": F.when(ok, end)})


def escape(s: Column) -> Column:
    return F.when((s == "") | s.rlike(r'[:/!@"\s]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def percent(s: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def format_ref(corpus_id: Column, version: Column, sections: Column, otype: Column, start: Column, end: Column, urn: bool = False) -> Column:
    identity = F.concat(corpus_id, F.coalesce(F.concat(F.lit("@"), version), F.lit("")))
    unit = F.coalesce(F.concat(F.lit("!"), otype, start.cast("string"), F.coalesce(F.concat(F.lit("-"), end.cast("string")), F.lit(""))), F.lit(""))
    if urn:
        return F.concat(F.lit("urn:tf:"), identity, F.lit(":"), F.array_join(F.transform(sections, percent), ":"), unit)
    return F.concat(F.coalesce(F.concat(identity, F.lit("/")), F.lit("")), F.array_join(F.transform(sections, escape), ":"), unit)


def anchored_units(nodes: DataFrame, slots: DataFrame, section_slots: DataFrame, sections: DataFrame) -> DataFrame:
    """node, otype, path for unit_index, from a corpus as three tables: each unit belongs to the innermost section of its first slot.

    nodes: node, otype; slots: node, slot; section_slots: section, slot; sections: node, path. Units without slots are left out.
    """
    first = slots.groupBy("node").agg(F.min("slot").alias("slot"))
    paths = section_slots.join(sections.select(F.col("node").alias("section"), "path"), "section")
    inner = paths.groupBy("slot").agg(F.max_by("path", F.size("path")).alias("path"))
    return nodes.join(first, "node").join(inner, "slot").select("node", "otype", "path")


def unit_index(units: DataFrame, sections: DataFrame) -> DataFrame:
    """section, otype, node, pos, total: every unit under its own section and all above it, numbered in node order.

    units: node, otype, path (of the section of its first slot); sections: node, path.
    """
    up = units.select("node", "otype", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("path"))
    s = sections.select(F.col("node").alias("section"), "path")
    w = Window.partitionBy("section", "otype")
    d = up.join(s, "path").select("section", "path", "otype", "node")
    return d.withColumns({"pos": F.row_number().over(w.orderBy("node")).cast("long"), "total": F.count("*").over(w)})


def resolve(parsed: DataFrame, sections: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """One row per node that a reference names, or one with an error: section, type or range not found."""
    s = sections.select(F.col("node").alias("section"), F.col("path").alias("sections"))
    d = parsed.join(s, "sections", "left")
    counts = index.select("section", "otype", "total").distinct()
    d = d.join(counts, ["section", "otype"], "left")
    last = F.coalesce("end_at", "start_at")
    error = F.coalesce("error", F.when(F.col("section").isNull(), "section not found").when(F.col("otype").isNotNull() & F.col("total").isNull(), "type not in section").when(last > F.col("total"), "index out of range"))
    d = d.withColumn("error", error)
    wanted = F.when(F.col("error").isNull() & F.col("otype").isNotNull(), F.sequence("start_at", last))
    d = d.withColumn("pos", F.explode_outer(wanted))
    d = d.join(index.select("section", "otype", "pos", "node"), ["section", "otype", "pos"], "left")
    return d.select(key, "error", F.when(F.col("error").isNull(), F.coalesce("node", "section")).alias("node"))


def serialize(nodes: DataFrame, units: DataFrame, index: DataFrame, corpus_id: str, version: str) -> DataFrame:
    """node, ref: the position within the innermost section of the unit's first slot."""
    own = nodes.join(units, "node").join(index.select("path", "otype", "node", "pos"), ["path", "otype", "node"])
    return own.select("node", format_ref(F.lit(corpus_id), F.lit(version), F.col("path"), F.col("otype"), F.col("pos"), F.lit(None)).alias("ref"))


def value_error(corpus_id: Column, version: Column, sections: Column, otype: Column, start: Column, end: Column) -> Column:
    """Why values make no reference, whatever they were read from; null where they do."""
    reserved = lambda x: x.isNotNull() & ((x == "") | x.rlike("[/:@!]"))
    return (
        F.when(F.coalesce(F.size(sections), F.lit(0)) < 1, "at least one section is required")
        .when(version.isNotNull() & corpus_id.isNull(), "a version requires a corpus id")
        .when(reserved(corpus_id), "corpus id contains a reserved delimiter")
        .when(reserved(version), "version contains a reserved delimiter")
        .when(otype.isNull() & (start.isNotNull() | end.isNotNull()), "an index requires a unit type")
        .when(otype.isNotNull() & F.coalesce(start < 1, F.lit(True)), "selector indices are 1-based")
        .when(end < start, "range end precedes its start")
    )


def missing_depth(parsed: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """key, depth: the first level (from 1) of a reference's section path that the corpus doesn't have; null where it has all."""
    p = F.col("sections")
    up = parsed.where(p.isNotNull()).select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.struct(k.alias("depth"), F.slice(p, F.lit(1), k).alias("path")))).alias("x"))
    up = up.select(key, "x.depth", "x.path").join(sections.select("path", F.lit(True).alias("known")).distinct(), "path", "left")
    return up.groupBy(key).agg(F.min(F.when(F.col("known").isNull(), F.col("depth"))).alias("depth"))


def resolve_ref(refs: DataFrame, sections: DataFrame, index: DataFrame, col: str = "ref") -> DataFrame:
    """The nodes of references given as text, by their older name."""
    return resolve(parse(refs, col), sections, index, col)


def node_to_ref(nodes: DataFrame, units: DataFrame, index: DataFrame, corpus_id: str, version: str) -> DataFrame:
    """The references of nodes, by their older name."""
    return serialize(nodes, units, index, corpus_id, version)


def normalize(corpus_id: str, version: str) -> Column:
    """Over parsed rows: the corpus where none is named, always this version."""
    return format_ref(F.coalesce("corpus_id", F.lit(corpus_id)), F.lit(version), F.col("sections"), F.col("otype"), F.col("start_at"), F.col("end_at"))
