"""Every query with a SQL form against DuckDB, on the smallest tables; all others give rows of a stable schema."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from plazaflow.catalog import COVERS, ORACLE_SQL, QUERIES

from .conftest import SMALL


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}") + 0.0
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return str(value) if not isinstance(value, int | bool | type(None)) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_twice_alike(spark, name):
    rows = [sorted(map(str, QUERIES[name](spark, SMALL).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_every_query_names_what_it_covers():
    assert set(COVERS) == set(QUERIES) and all(COVERS.values())


def test_one_query_claims_the_join_of_all_similar_pairs():
    """It is held against brute force in test_similar.py."""
    assert [name for name, covers in COVERS.items() if "J25" in covers] == ["similar_pages"]
