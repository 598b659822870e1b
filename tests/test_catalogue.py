"""Every query with SQL gives what DuckDB gives on the same tables."""

import datetime

import duckdb
import pytest

import __spark_entry__
from foliograph.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = tables.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == sorted(repr([plain(r[i]) for i in order]) for r in cursor.fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_grid_places(spark):
    from foliograph.operators.render import grid_places

    cells = spark.createDataFrame([(1, 0, 0, 2, 1), (1, 0, 1, 1, 2), (1, 1, 2, 1, 1), (1, 1, 3, 1, 1), (1, 2, 4, 1, 1)], "t int, row int, ordinal int, col_span int, row_span int")
    assert {r.ordinal: r.grid_column for r in grid_places(cells, "t").collect()} == {0: 0, 1: 2, 2: 0, 3: 1, 4: 0}


def test_inheritance_nearest_wins_and_root_first_reproduces_the_fold(spark):
    from foliograph.operators.styles import inherit

    rows = spark.createDataFrame([("leaf", "mid", None, None), ("mid", "root", "m", None), ("root", None, "r", "x"), ("loop", "loop2", None, None), ("loop2", "loop", "l", None)], "name string, parent string, a string, b string")
    found = inherit(spark, rows, "name", "parent", ["a", "b"]).collect()
    near = {r.name: (r.a, r.b) for r in found}
    assert near["leaf"] == ("m", "x") and near["root"] == ("r", "x") and near["loop"] == (None, None)
    assert {r.name: r.error for r in found} == {"leaf": None, "mid": None, "root": None, "loop": "circular", "loop2": "circular"}
    fold = {r.name: (r.a, r.b) for r in inherit(spark, rows, "name", "parent", ["a", "b"], root_first=True).collect()}
    assert fold["leaf"] == ("r", "x") and fold["mid"] == ("m", "x")
