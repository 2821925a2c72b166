"""Previews and schema reports as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows; with ``order_by`` a deterministic top-n (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, position, column_name, data_type, n_rows, n_non_null)`` per column.

    Type names come from the schema; the counts come from one aggregation per table.
    """
    parts = []
    for name, df in tables.items():
        fields = df.schema.fields
        aggs = [F.count(F.lit(1)).alias("__n")] + [
            F.count(F.col(f"`{f.name}`")).alias(f"__c{i}") for i, f in enumerate(fields)]
        counts = df.agg(*aggs)
        stack = ", ".join(
            f"{i + 1}, '{f.name}', '{f.dataType.simpleString()}', __c{i}" for i, f in enumerate(fields))
        parts.append(counts.selectExpr(
            f"'{name}' as table_name", "__n as n_rows",
            f"stack({len(fields)}, {stack}) as (position, column_name, data_type, n_non_null)")
            .select("table_name", "position", "column_name", "data_type", "n_rows", "n_non_null"))
    return reduce(DataFrame.union, parts)
