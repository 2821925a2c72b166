"""Incremental pickup of newly landed shards (Structured Streaming file source).

Each run processes only files the checkpoint has not seen, then stops
(``trigger(availableNow=True)``).  The Parquet file sink commits exactly once per batch,
so re-running after a crash or with nothing new adds no duplicate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.schemas import REGISTRY, Dialect
from regspark.sources.shards import snapshot_from_path


def shard_stream(spark: SparkSession, source_glob: str, schema: T.StructType,
                 dialect: Dialect = REGISTRY, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of delimited shards with ``snapshot`` and ``source_file`` columns."""
    r = spark.readStream.schema(schema).options(**dialect.read_options())
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = r.csv(source_glob)
    return (df.select("*", F.col("_metadata.file_path").alias("source_file"))
            .withColumn("snapshot", snapshot_from_path("source_file")))


def ingest_new_shards(spark: SparkSession, source_glob: str, schema: T.StructType,
                      sink_path: str, checkpoint_path: str, dialect: Dialect = REGISTRY,
                      partition_by: tuple = ("snapshot",),
                      max_files_per_trigger: int | None = None) -> dict:
    """Append rows of not-yet-seen shards to a Parquet table; returns the last progress."""
    df = shard_stream(spark, source_glob, schema, dialect, max_files_per_trigger)
    w = (df.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint_path).outputMode("append")
         .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q.lastProgress or {}


def ingest_new_archives(spark: SparkSession, archive_dir: str, schema: T.StructType,
                        sink_path: str, checkpoint_path: str, dialect: Dialect = REGISTRY,
                        member_suffix: str | None = ".csv", spread_partitions: int | None = None) -> dict:
    """Unpack and load zip archives of a folder not seen before (a ``registry_zip`` stream, a task
    for each member, archives of any size).

    Every micro-batch is split into rows and rejected archives (whole-archive rejection, as in batch
    reads) and written to ``<sink>/good/batch=<id>``, ``<sink>/rejects/batch=<id>`` and, with the versions of
    the archives, ``<sink>/versions/batch=<id>``, each with overwrite: a batch replayed after a
    failure rewrites the same folders, so the result stays exactly-once.  An archive that is published
    again under its name, or removed, comes in a later batch; read ``ingested_archives``, which holds
    the rows of the newest version of each.  Lines are spread over ``spread_partitions`` tasks (default: the
    shuffle partitions) before parsing.
    """
    from regspark.session import cut_lineage, qualified
    from regspark.sources.archives import parse_lines, split_rejects
    from regspark.sources.zip_source import zip_line_stream

    lines = zip_line_stream(spark, qualified(spark, archive_dir), f"{qualified(spark, checkpoint_path)}/listings", encoding=dialect.encoding, memberSuffix=member_suffix or "",
                            quote=dialect.quote if dialect.multi_line else "")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        staged = cut_lineage(batch, batch.sparkSession, "zip-batch")      # unpacked once
        good, bad = split_rejects(staged)
        spread = spread_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = parse_lines(good, schema, dialect, dialect.header, keep=["archive", "member", "version"], spread_partitions=spread)
        versions = staged.groupBy("archive").agg(F.max("version").alias("version"))
        for df, name in ((rows, "good"), (bad, "rejects"), (versions, "versions")):
            df.write.mode("overwrite").parquet(f"{sink_path}/{name}/batch={batch_id}")

    return _finished(lines.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
                     .trigger(availableNow=True).start())


def ingested_archives(spark: SparkSession, sink_path: str, schema: T.StructType) -> DataFrame:
    """Rows of the newest version of every archive, with ``archive`` and ``member``; an archive
    whose newest version was rejected has none."""
    full = T.StructType([T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()),
                         T.StructField("version", T.LongType()), *schema.fields])
    newest = (spark.read.parquet(f"{sink_path}/versions").groupBy("archive").agg(F.max("version").alias("version")))
    rows = spark.read.schema(full).parquet(f"{sink_path}/good")
    return rows.join(newest, ["archive", "version"], "left_semi").select("archive", "member", *schema.fieldNames())


def _finished(q) -> dict:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q.lastProgress or {}


def follow_shards(spark: SparkSession, source_glob: str, schema: T.StructType, table: str,
                  dialect: Dialect = REGISTRY) -> dict[str, int]:
    """One incremental run over text shards whose rows follow their files: new shards are added, a
    shard republished under its name replaces its own rows, a removed one takes them away.

    Unlike ``ingest_new_shards``, whose file source knows paths only, this keeps a ledger of file
    versions (``sources.ledger``); run it again at any time, nothing is read twice.  Read the
    rows with ``followed_shards``."""
    from regspark.sources.ledger import read_shard_files, sync_files
    return sync_files(spark, source_glob, table, read_shard_files(spark, schema, dialect))


def followed_shards(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The rows that ``follow_shards`` holds, with ``snapshot`` and ``source_file``."""
    from regspark.sources.ledger import read_synced
    rows = read_synced(spark, table, schema)
    return rows.withColumn("snapshot", snapshot_from_path("source_file"))


def ingest_distinct_shards(spark: SparkSession, source_glob: str, schema: T.StructType, table: str,
                           checkpoint_path: str, dialect: Dialect = REGISTRY,
                           max_files_per_trigger: int | None = None) -> dict:
    """Add the rows of not-yet-seen shards that no earlier shard had to a distinct table
    (``operators.incremental_dedup``), whose rows are not read again for it; returns the last progress.

    After every batch the table equals the full-row distinct of all shards so far.  A batch that is
    replayed after a failure adds nothing.  Read the rows with ``distinct_rows``."""
    from regspark.operators.incremental_dedup import add_new_rows
    stream = shard_stream(spark, source_glob, schema, dialect, max_files_per_trigger).select(*[F.col(f"`{c}`") for c in schema.fieldNames()])
    return _finished(stream.writeStream.foreachBatch(lambda batch, _: add_new_rows(batch, table) and None)
                     .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())
