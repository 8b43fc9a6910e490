"""Every registered query against its SQL, over the smallest tables."""

import math

import duckdb
import pytest

from scorelattice import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    if isinstance(v, float):
        return round(v, 6)
    return int(v) if hasattr(v, "__index__") else v


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((repr(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(want) > 0 or name in ("system_groups", "staff_groups", "line_runs", "barline_intersect", "cell_boxes")


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
