"""Driver contract and Spark-vs-DuckDB parity of every registered query on sf0.001."""


import duckdb
import pytest

import __spark_entry__ as E
from regspark.plans.oracles import ORACLES
from tools.oracle_check import digest

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    df = E.queries()[name](spark, sf_dir)
    s_cols, s_hash, _ = digest(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    d_cols, d_hash, _ = digest([c[0] for c in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert s_hash == d_hash


def test_entry_without_the_training_data_subpackage(monkeypatch):
    import sys
    from regspark.plans.catalog import QUERIES
    for gone in ("regspark.llm.queries", "corpus_pipeline"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, gone, None)
            assert set(E.queries()) == set(QUERIES) and set(E.oracle_sql()) == set(ORACLES)
