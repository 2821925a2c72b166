"""Row counts as data, shards concatenation, gapless row numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from regspark.session import cut_lineage


def row_count(df: DataFrame, label: str | None = None, label_col: str = "table_name") -> DataFrame:
    """``count(*)`` as a one-row DataFrame (optionally labelled)."""
    out = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return out.select(F.lit(label).alias(label_col), "n_rows") if label is not None else out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, n_rows)`` for every table, as one unioned DataFrame."""
    if not tables:
        raise ValueError("row_counts needs at least one table")
    return reduce(DataFrame.union, [row_count(df, name) for name, df in tables.items()])


def union_shards(frames: list[DataFrame], allow_missing_columns: bool = False) -> DataFrame:
    """Concatenate shards by column name; ``indexed_union`` also numbers the rows."""
    if not frames:
        raise ValueError("union_shards needs at least one frame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing_columns), frames)


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before, by the ``order`` columns (unique).

    Rows are dealt to ranges of the order; each range is summed by itself, and only one sum of
    each range goes through the driver."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), name="ranges")
    before, at = 0, {}
    for r in sorted(ranged.groupBy("__range").agg(F.sum(value).alias("s")).collect()):
        at[r["__range"]], before = before, before + r["s"]
    starts = F.array(*[F.lit(at.get(i, before)).cast("long") for i in range(max(at, default=0) + 1)])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn(out, F.get(starts, F.col("__range")) + F.sum(value).over(inside) - F.col(value)).drop("__range")


def indexed_union(frames: list[DataFrame], index_col: str = "index") -> DataFrame:
    """Concatenate shards by column name with a gapless row number from 0.

    Rows are numbered by frame, then by (path, offset) if the frame scans files, else by
    partition, then in reading order.  No window sees more than one split's count: rows are counted
    for each split, the counts summed up over the splits, and a row's number is its split's sum plus
    its place in the split."""
    if not frames:
        raise ValueError("indexed_union needs at least one frame")
    tagged = []
    for i, df in enumerate(frames):
        try:
            named = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"))
        except AnalysisException:
            named = df.select("*", F.lit("").alias("__path"), F.spark_partition_id().cast("long").alias("__start"))
        tagged.append(named.withColumns({"__frame": F.lit(i), "__at": F.monotonically_increasing_id()}))
    split = ["__frame", "__path", "__start"]
    rows = cut_lineage(reduce(DataFrame.unionByName, tagged), name="indexed-rows")
    counts = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    sums = prefix_sums(counts, split, "__n", "__before").drop("__n")
    return (rows.join(sums, split).withColumn(index_col, F.col("__before") + F.col("__at") - F.col("__first"))
            .select(index_col, *frames[0].columns))
