"""All queries of the structural analytics engine, with their DuckDB counterparts."""

from __future__ import annotations

from textlattice.plans import book_queries, document_queries, format_queries, output_queries, relational_queries, text_queries

FLAGSHIP = "scan_documents"
MODULES = [text_queries, book_queries, document_queries, format_queries, output_queries, relational_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
