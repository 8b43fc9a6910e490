"""The registered queries over the smallest tables, and against SQL where there is any."""

import duckdb
import pytest

import corpus_pipeline
from scorelattice.llm import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = catalog.queries()[name](spark, DIR)
    rows = sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=repr)
    con = duckdb.connect()
    table = "embeddings" if name.startswith("op6_") else "documents"
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    assert len(rows) == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    if name in catalog.oracle_sql():
        want = con.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in want.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(got.columns) == sorted(names)
        assert rows == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_pipeline_runs(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, DIR).count() > 0
