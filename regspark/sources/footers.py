"""Counts that Parquet footers answer: no page of data is read.

Spark pushes ``count(*)`` and ``count(column)``, also grouped by folder columns such as ``snapshot``,
into its Parquet scan if the scan is of the newer kind and the push-down is on.  Both settings hold
for a session, so these scans get one of their own (same application, same executors) and the
caller's settings stay as they are.  Nested tables cannot be counted by column from footers; they are
read as usual.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def footer_session(spark: SparkSession) -> SparkSession:
    """A session whose Parquet scans take aggregates."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def footer_row_counts(spark: SparkSession, paths: dict[str, str], by: str | None = None) -> DataFrame:
    """``(table_name, n_rows)`` of Parquet tables, or ``(table_name, <by>, n_rows)`` for each value of a folder column."""
    if not paths:
        raise ValueError("footer_row_counts needs at least one table")
    own, keys = footer_session(spark), [by] if by else []
    return reduce(DataFrame.union, [
        own.read.parquet(path).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), *keys, "n_rows")
        for name, path in paths.items()])


def footer_column_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(table_name, column_name, n_rows, n_values)``: rows, and rows with a value, of every column."""
    if not paths:
        raise ValueError("footer_column_counts needs at least one table")
    own, found = footer_session(spark), []
    for name, path in paths.items():
        df = own.read.parquet(path)
        if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema):
            df = spark.read.parquet(path)
        columns = df.columns
        counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_values")) for i, c in enumerate(columns)]))
        found.append(counts.select("n", each.alias("c")).select(F.lit(name).alias("table_name"), "c.column_name", F.col("n").alias("n_rows"), "c.n_values"))
    return reduce(DataFrame.union, found)
