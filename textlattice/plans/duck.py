"""DuckDB text of the shared expressions, for the oracles."""

from __future__ import annotations

from textlattice.functions import patterns as P


def q(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def word_count(x: str) -> str:
    return rf"CAST(len(list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z0-9]+'))) AS BIGINT)"


def sentences(x: str) -> str:
    kept = f"regexp_replace({x}, {q(P.ABBREVIATION_RE2)}, '\\1\\2{P.KEPT_STOP}', 'g')"
    marked = f"regexp_replace({kept}, {q(P.SENTENCE_RE2)}, '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip(f"replace(s, '{P.KEPT_STOP}', '.')")}), lambda s: s <> '')"


def sentence_count(x: str) -> str:
    return f"CAST(CASE WHEN {strip(x)} = '' THEN 0 ELSE greatest(1, len({sentences(x)})) END AS BIGINT)"


def paragraphs(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '\n[{SPACE}]*\n'), lambda p: {strip('p')}), lambda p: length(p) >= 3)"


def clauses(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {q(P.CLAUSE)}), lambda c: {strip('c')}), lambda c: c <> '')"


def ratio(w: str, n: str) -> str:
    """Python's round(w / n, 2)."""
    w, n = f"CAST({w} AS BIGINT)", f"CAST({n} AS BIGINT)"
    x = f"(CAST({w} AS DOUBLE) / {n})"
    k = f"(100 * {w} // {n})"
    r2 = f"(2 * (100 * {w} - {k} * {n}))"
    p = f"(CAST(1 AS BIGINT) << CAST(52 - floor(log2({x})) AS INTEGER))"
    m, edge = f"(CAST({x} * {p} AS BIGINT) * 200)", f"((2 * {k} + 1) * {p})"
    return f"CASE WHEN {w} = 0 THEN 0.0::DOUBLE ELSE ({k} + CASE WHEN {r2} > {n} THEN 1 WHEN {r2} < {n} THEN 0 WHEN {m} > {edge} THEN 1 WHEN {m} < {edge} THEN 0 ELSE {k} % 2 END) / 100.0::DOUBLE END"
