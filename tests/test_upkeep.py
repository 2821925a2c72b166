"""Distinct rows kept up to date, joins from buckets, counts from footers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from regspark.operators.incremental_dedup import add_new_rows, distinct_rows, held_digests
from regspark.schemas import string_schema
from regspark.sinks.bucketed import read_bucketed_join, write_bucketed_pair
from regspark.sources.footers import footer_column_counts, footer_row_counts

SCHEMA = string_schema(["id", "v"])


# --- distinct, batch by batch ---------------------------------------------------------------------

def test_distinct_equals_full_dedup_after_every_batch(spark, tmp_path):
    rng, table, seen = random.Random(5), str(tmp_path / "t"), []
    for _ in range(4):
        batch = [(rng.choice(["a", "ab", "", None]), rng.choice(["b", "1:b", "", None, "é"])) for _ in range(12)]
        before = len(set(seen))
        seen += batch
        got = add_new_rows(spark.createDataFrame(batch, SCHEMA), table)
        assert got == {"n_read": 12, "n_new": len(set(seen)) - before}
        assert rows(distinct_rows(spark, table, SCHEMA)) == sorted(set(seen), key=repr)
    assert add_new_rows(spark.createDataFrame(seen, SCHEMA), table)["n_new"] == 0       # a replayed batch
    assert add_new_rows(spark.createDataFrame([], SCHEMA), table) == {"n_read": 0, "n_new": 0}


def test_distinct_takes_values_as_equal_like_drop_duplicates(spark, tmp_path):
    schema = "f float, d double, t timestamp, b binary, n decimal(10,2), k boolean"
    nan, at = float("nan"), dt.datetime(2024, 1, 1)
    data = [(0.0, -0.0, at, b"\xff", None, True), (-0.0, 0.0, at, b"\xff", None, True), (nan, nan, None, b"\xfe", None, None),
            (nan, nan, None, b"\xfe", None, None), (None, None, None, b"", None, False), (None, None, None, None, None, False)]
    df = spark.createDataFrame(data, schema)
    for part in (df.limit(1), df, df):
        add_new_rows(part, str(tmp_path / "t"))
    assert distinct_rows(spark, str(tmp_path / "t"), df.schema).count() == df.dropDuplicates().count() == 4
    with pytest.raises(ValueError):
        add_new_rows(df.select(F.array("d").alias("a")), str(tmp_path / "u"))
    with pytest.raises(ValueError):
        add_new_rows(df.select(F.col("b").alias("row_digest")), str(tmp_path / "u"))


def test_distinct_reads_digests_only_and_skips_unfinished_runs(spark, tmp_path):
    table = str(tmp_path / "t")
    assert distinct_rows(spark, table, SCHEMA).count() == 0
    add_new_rows(spark.createDataFrame([("1", "a")], SCHEMA), table)
    assert "ReadSchema: struct<row_digest:binary>" in held_digests(spark, table)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    spark.createDataFrame([("2", "b")], SCHEMA).write.parquet(f"{table}/rows/run=99999999999999999999-dead")
    (tmp_path / "t" / "rows" / "run=99999999999999999999-dead" / "_SUCCESS").unlink()
    assert rows(distinct_rows(spark, table, SCHEMA)) == [("1", "a")]


def test_distinct_shards_stream(spark, tmp_path):
    from regspark.streaming.incremental import ingest_distinct_shards
    src, table, ckpt = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    src.mkdir()
    want = set()
    for i, text in enumerate(["1;a\n2;b\n1;a\n", "2;b\n3;c\n", "1;a\n", ""]):
        (src / f"Socios{i}.csv").write_text(text)
        ingest_distinct_shards(spark, f"{src}/*.csv", SCHEMA, table, ckpt, max_files_per_trigger=1)
        want |= {tuple(line.split(";")) for line in text.split()}
        assert rows(distinct_rows(spark, table, SCHEMA)) == sorted(want)


# --- joins from buckets ----------------------------------------------------------------------------

def _pair(spark, n=400):
    left = spark.createDataFrame([(None if i % 9 == 0 else "hot" if i % 3 == 0 else f"k{i % 40}", i) for i in range(n)], "key string, x int")
    right = spark.createDataFrame([(None if i % 11 == 0 else "hot" if i % 3 == 0 else f"k{i % 50}", -i) for i in range(n)], "key string, x int")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [3, 50, 10_000])
def test_bucketed_join_equals_join(spark, tmp_path, how, hot_rows):
    left, right = _pair(spark)
    path = write_bucketed_pair(left, right, F.col("key"), F.col("key"), str(tmp_path / "p"), 4, hot_rows)
    got = read_bucketed_join(spark, path, how)
    assert got.columns == ["key", "x", "key", "x"]
    want = left.alias("l").join(right.alias("r"), F.col("l.key") == F.col("r.key"), how)
    assert rows(got) == rows(want)


def test_bucketed_join_has_no_exchange_and_no_hot_bucket(spark, tmp_path):
    left, right = _pair(spark, 2_000)
    path = write_bucketed_pair(left, right, F.col("key"), F.col("key"), str(tmp_path / "p"), 4, 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = read_bucketed_join(spark, path, "left")
        # the two branches of the union: buckets, then hot keys
        buckets = plan(joined).split("left_hot")[0]
        from regspark.sinks.bucketed import KEY, _bucketed
        l, r = (_bucketed(spark, path, side, 4) for side in ("left", "right"))
        alone = plan(l.join(r, l[KEY] == r[KEY], "left"))
        assert "SortMergeJoin" in alone and "Exchange" not in alone and "SortMergeJoin" in buckets
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert l.where(F.col("key").isNull() | (F.col("key") == "hot")).count() == 0
    assert l.groupBy(KEY).count().agg(F.max("count")).first()[0] <= 100


def test_bucketed_pair_in_another_session_and_written_again(spark, tmp_path):
    left, right = _pair(spark, 60)
    path = write_bucketed_pair(left, right, F.col("key"), F.col("key"), str(tmp_path / "p"), 4)
    want = rows(read_bucketed_join(spark, path))
    for t in spark.catalog.listTables():
        if t.name.startswith("bucketed_"):
            spark.sql(f"DROP TABLE {t.name}")                 # a session that has not seen the pair
    assert rows(read_bucketed_join(spark, path)) == want
    write_bucketed_pair(left.limit(0), right, F.col("key"), F.col("key"), path, 2)
    assert rows(read_bucketed_join(spark, path)) == []
    with pytest.raises(ValueError):
        write_bucketed_pair(left, right, F.col("key"), F.col("x"), path, 2)
    with pytest.raises(ValueError):
        read_bucketed_join(spark, path, "full")


# --- counts from footers ---------------------------------------------------------------------------

def test_counts_come_from_footers(spark, tmp_path):
    out = str(tmp_path / "t")
    data = [(i, None if i % 3 else str(i), "2023-05" if i % 2 else "2025-01") for i in range(100)]
    spark.createDataFrame(data, "i int, s string, snapshot string").write.partitionBy("snapshot").parquet(out)
    total, months, columns = footer_row_counts(spark, {"t": out}), footer_row_counts(spark, {"t": out}, by="snapshot"), footer_column_counts(spark, {"t": out})
    for df in (total, months, columns):
        text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "PushedAggregation: [COUNT(*)" in text, text
    assert rows(total) == [("t", 100)] and rows(months) == [("t", "2023-05", 50), ("t", "2025-01", 50)]
    assert ("t", "s", 100, 34) in rows(columns) and ("t", "i", 100, 100) in rows(columns)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"               # the caller's session is as it was
    with pytest.raises(ValueError):
        footer_row_counts(spark, {})


def test_nested_tables_are_counted(spark, tmp_path):
    out = str(tmp_path / "n")
    spark.createDataFrame([(1, [1, 2]), (2, None), (None, [])], "i int, a array<int>").write.parquet(out)
    assert rows(footer_column_counts(spark, {"n": out})) == [("n", "a", 3, 2), ("n", "i", 3, 2)]
    assert rows(footer_row_counts(spark, {"n": out})) == [("n", 3)]
