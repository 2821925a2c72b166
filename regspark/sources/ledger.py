"""File versions, and tables whose rows follow the files they came from.

A file version is (path, length, modification time), as the file system lists it; no file is
read for it.  A *source table* keeps, beside its rows, a ledger of the file versions they came
from.  ``sync_files`` compares the ledger with the listing of now: rows of files that are new or
have another version are read and written, rows of files that changed or went away stop
counting.  A shard that is repaired under its old name so replaces its own rows.

Layout: ``<table>/rows/run=<id>/`` holds what one run read, with the ``source_file`` of each row;
``<table>/ledger/run=<id>/`` the whole list of file versions after that run, each with the run
that holds its rows.  The newest complete ledger is the table: writing it is the commit, so a run
that dies before it leaves the table as it was, and its rows are never read.

A file that is rewritten with the same length and modification time cannot be told apart.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.operators.dims import bounded_broadcast
from regspark.session import _hadoop_path

VERSIONS = "path string, length long, modified timestamp"
LEDGER = VERSIONS + ", run string"


def _absent(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e) or "UNABLE_TO_INFER" in str(e)


def list_files(spark: SparkSession, pattern: str, recursive: bool = True) -> DataFrame:
    """``(path, length, modified)`` of every file of a glob or folder; empty if there is none.

    Hidden files (``_`` or ``.`` first) are left out.  Only the listing is read: the content
    column of the scan is pruned."""
    try:
        found = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(pattern)
                 .select("path", "length", F.col("modificationTime").alias("modified")))
    except AnalysisException as e:
        if not _absent(e):
            raise
        return spark.createDataFrame([], VERSIONS)
    return found.where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))


def file_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, change)`` of two listings: ``new``, ``changed``, ``removed`` or ``same``."""
    a = before.select(F.col("path").alias("was"), F.struct("length", "modified").alias("old"))
    b = now.select("path", F.struct("length", "modified").alias("found"))
    change = (F.when(F.col("was").isNull(), "new").when(F.col("path").isNull(), "removed")
              .when(F.col("old") != F.col("found"), "changed").otherwise("same"))
    return b.join(a, F.col("path") == F.col("was"), "full_outer").select(F.coalesce("path", "was").alias("path"), change.alias("change"))


def new_run() -> str:
    """A run id; later ones are greater."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _runs(spark: SparkSession, folder: str) -> list[str]:
    """Complete runs under a folder, oldest first."""
    p, fs = _hadoop_path(spark, folder)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("run=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(f.getName()[4:] for f in found if fs.exists(done(f, "_SUCCESS")))


def ledger(spark: SparkSession, table: str) -> DataFrame:
    """``(path, length, modified, run)`` of the files whose rows the table holds."""
    runs = _runs(spark, f"{table.rstrip('/')}/ledger")
    if not runs:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{table.rstrip('/')}/ledger/run={runs[-1]}")


def pending_files(spark: SparkSession, table: str, pattern: str) -> DataFrame:
    """``(path, change)`` of what the next ``sync_files`` would do, without the unchanged."""
    return file_changes(ledger(spark, table), list_files(spark, pattern)).where("change <> 'same'")


def sync_files(spark: SparkSession, pattern: str, table: str, read: Callable[[list[str]], DataFrame],
               max_files: int = 100_000) -> dict[str, int]:
    """Bring a source table up to date; returns the number of files by change.

    ``read(paths)`` gives the rows of some files with their ``source_file`` (the path as listed).  Paths
    go through the driver, as every list of files to scan does: beyond ``max_files`` changed ones
    the run raises, and a narrower pattern is needed.
    """
    table = table.rstrip("/")
    before, now = ledger(spark, table), list_files(spark, pattern)
    from regspark.session import cut_lineage
    now = cut_lineage(now, spark, "listing")            # one listing decides all that follows
    changes = cut_lineage(file_changes(before, now), spark, "changes")
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    if not set(counts) - {"same"}:
        return counts
    fresh = changes.where(F.col("change").isin("new", "changed")).select("path")
    paths = sorted(r["path"] for r in fresh.limit(max_files + 1).collect())
    if len(paths) > max_files:
        raise ValueError(f"more than {max_files} new or changed files under {pattern}")
    run = new_run()
    if paths:
        read(paths).write.parquet(f"{table}/rows/run={run}")
    kept = before.select("path", F.col("run").alias("old_run")).join(changes.where("change = 'same'"), "path").select("path", "old_run")
    (now.join(kept, "path", "left").select("path", "length", "modified", F.coalesce("old_run", F.lit(run)).alias("run"))
     .write.parquet(f"{table}/ledger/run={run}"))
    return counts


def read_synced(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """Rows of the table, with ``source_file``; ``schema`` is that of the rows without it.

    Only the runs that the ledger names are scanned; a row counts if the ledger has its file
    with its run."""
    table = table.rstrip("/")
    full = T.StructType([*schema.fields, T.StructField("source_file", T.StringType()), T.StructField("run", T.StringType())])
    valid = ledger(spark, table).select(F.col("path").alias("source_file"), "run")
    held = sorted(r["run"] for r in valid.select("run").distinct().collect())
    folders = [f"{table}/rows/run={r}" for r in held]
    folders = [f for f in folders for p, fs in [_hadoop_path(spark, f)] if fs.exists(p)]
    if not folders:
        return spark.createDataFrame([], T.StructType(full.fields[:-1]))
    rows = spark.read.schema(full).option("basePath", f"{table}/rows").parquet(*folders)
    return rows.join(bounded_broadcast(valid), ["source_file", "run"], "left_semi").drop("run").select(*[f.name for f in full.fields[:-1]])


def drop_superseded_runs(spark: SparkSession, table: str) -> int:
    """Delete rows and ledgers that the newest ledger does not need; returns the folders deleted.
    Readers of an older state fail, so call it when there are none."""
    table = table.rstrip("/")
    done = _runs(spark, f"{table}/ledger")
    if not done:
        return 0
    need = {r["run"] for r in ledger(spark, table).select("run").distinct().collect()}
    gone = [f"{table}/ledger/run={r}" for r in done[:-1]]
    gone += [f"{table}/rows/run={r}" for r in _runs(spark, f"{table}/rows") if r not in need and r <= done[-1]]
    for folder in gone:
        p, fs = _hadoop_path(spark, folder)
        fs.delete(p, True)
    return len(gone)


def read_shard_files(spark: SparkSession, schema: T.StructType, dialect=None) -> Callable[[list[str]], DataFrame]:
    """A ``read`` for ``sync_files``: delimited text, with ``source_file`` as the listing names it."""
    from regspark.schemas import REGISTRY
    from regspark.sources.delimited import read_delimited

    def read(paths: list[str]) -> DataFrame:
        rows = read_delimited(spark, paths, schema, dialect or REGISTRY)
        return rows.select(*[f.name for f in schema.fields], listed_path(F.col("_metadata.file_path")).alias("source_file"))
    return read


def listed_path(path):
    """A ``_metadata.file_path`` as the listing writes it: one slash after ``file:``, no escapes."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")
