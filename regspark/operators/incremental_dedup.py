"""Full-row distinct kept up to date batch by batch.

A *distinct table* is ``<table>/rows/run=<id>/``: the rows that one run added, each with the SHA-256
of its values.  A new batch is compared with the digest column alone (Parquet reads no other), never
with the rows held.  Digests that the table holds are looked up by a semi-join whose right side is the
batch, so a small batch is broadcast by its measured size and the table is not shuffled; a large one
shuffles 32 bytes a row.  Digests are spread evenly whatever the rows are, and copies within a batch
collapse by hash aggregation before any shuffle, so no key is hot.

A run's folder counts once Spark has committed it, in one step with its digests.  A run that dies
leaves the table as it was, and a batch that is given again adds nothing.  One run at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.session import cut_lineage
from regspark.sources.ledger import _runs, new_run

DIGEST, COPIES = "row_digest", "row_copies"


def row_digest(schema: T.StructType) -> Column:
    """SHA-256 of a row's values, equal exactly where ``dropDuplicates`` takes rows as equal: nulls are
    equal to each other and to nothing else, and so are NaNs; 0.0 equals -0.0.

    A value is written with its length before it, so values cannot run into each other."""
    parts = []
    for f in schema:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"{f.name}: only columns of single values can be compared by digest")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            value = F.when(value == 0, F.lit(0).cast(f.dataType)).otherwise(value)
        if isinstance(f.dataType, T.TimestampType):
            value = F.unix_micros(value)                     # a local time may come twice a year
        text = F.hex(value) if isinstance(f.dataType, T.BinaryType) else value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _run_paths(spark: SparkSession, table: str) -> list[str]:
    folder = f"{table.rstrip('/')}/rows"
    return [f"{folder}/run={r}" for r in _runs(spark, folder)]


def distinct_rows(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """All distinct rows added so far."""
    paths = _run_paths(spark, table)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def held_digests(spark: SparkSession, table: str) -> DataFrame:
    return distinct_rows(spark, table, T.StructType([T.StructField(DIGEST, T.BinaryType())]))


def add_new_rows(batch: DataFrame, table: str) -> dict[str, int]:
    """Add the rows of a batch that the table does not hold; ``{n_read, n_new}``."""
    if DIGEST in batch.columns or COPIES in batch.columns:
        raise ValueError(f"a column is named {DIGEST} or {COPIES}")
    spark, run = batch.sparkSession, f"{table.rstrip('/')}/rows/run={new_run()}"
    columns = [F.col(f"`{c}`") for c in batch.columns]
    once = batch.groupBy(*columns).agg(F.count(F.lit(1)).alias(COPIES)).withColumn(DIGEST, row_digest(batch.schema))
    staged = cut_lineage(once, spark, "distinct-batch")
    held = held_digests(spark, table).join(staged.select(DIGEST), DIGEST, "left_semi")
    staged.join(held, DIGEST, "left_anti").select(*columns, DIGEST).write.parquet(run)
    return {"n_read": staged.agg(F.sum(COPIES)).first()[0] or 0, "n_new": spark.read.schema(f"{DIGEST} binary").parquet(run).count()}
