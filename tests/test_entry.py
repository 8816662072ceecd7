"""The entry module: queries and SQL agree, and the optional parts are optional."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from textlattice import registry

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and registry.FLAGSHIP in registry.queries()


def test_rest_stands_alone(tmp_path):
    for p in (ROOT / "textlattice").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"textlattice\.llm|from \.+llm|import llm", p.read_text()), p
    shutil.copytree(ROOT / "textlattice", tmp_path / "textlattice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.registry.queries()), set(e.oracle_sql()) == set(e.registry.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == ["True", "True"], out.stderr


@pytest.fixture(scope="module")
def duck():
    if not SMALL.is_dir():
        pytest.skip("the driver's tables aren't here")
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", ["scan_documents", "sentences", "preprocess", "matter_regions", "detect_schema", "book_structure", "section_totals", "text_chunk_type", "pdf_headings", "federated_search", "enrich_books", "library_list", "scan_merge", "ref_resolve", "ref_serialize"])
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, str(SMALL))
    cols = sorted(df.columns)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


#: Titles that end within a character reference, as the larger tables have them.
CUT = ["One &amp; two&amp", "three &am", "&quo", "AT&T &amp;amp; so&copy", "four &amp;&amp;&amp;"]


@pytest.mark.parametrize("name", ["epub_spine", "html_blocks", "analyze_document"])
def test_cut_references(spark, tmp_path, name):
    pages = [(k, f"<html><head><title>x</title></head><body><h1>{t}</h1><p>some words &middot; <a href=\"/a?b=1&amp\">more</a></p></body></html>") for k, t in enumerate(CUT)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)
