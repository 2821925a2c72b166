"""Full-row duplicate removal and its effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_full_row(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop exact duplicate rows (nulls compare equal).

    Planned as partial HashAggregate → shuffle on all columns → final HashAggregate, so
    a group of identical copies collapses to one row per map task before the shuffle.
    """
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def dedup_effect(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row ``(n_before, n_after, n_removed)`` from a single aggregation pass."""
    cols = cols or df.columns
    per_row = df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_before"),
        F.count(F.lit(1)).alias("n_after"),
    ).withColumn("n_removed", F.col("n_before") - F.col("n_after"))
