"""Spark against DuckDB for the training-data queries that SQL can express."""

import duckdb
import pytest

from conftest import SF_SMALL, plan
from regspark.llm.queries import ORACLES, QUERIES
from tools.oracle_check import digest


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    assert got[:2] == digest([c[0] for c in cur.description], cur.fetchall())[:2]


@pytest.mark.parametrize("name", ["op7_url_filters", "op10_chat_formatting", "op12_secret_scan"])
def test_native_queries_run_no_python(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert not any(x in p for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
