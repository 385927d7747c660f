"""Every query with SQL against DuckDB, and the others for their shape, at sf0.001."""

import os

import duckdb
import pytest

from corpusloom.plans import catalog, queries_report, queries_search, queries_session, queries_text  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return "\0"
    return f"{v:.5f}" if isinstance(v, float) else str(v)


def rows(df):
    columns = sorted(df.columns)
    return sorted(tuple(map(cell, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())


@pytest.mark.parametrize("missing", ["xxhash", "public_tokenizers", "corpusloom.llm"])
def test_core_stands_without_optional_modules(missing):
    import subprocess
    import sys
    from pathlib import Path

    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; from corpusloom.plans import catalog; assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLES) <= set(e.oracle_sql()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
