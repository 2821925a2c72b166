"""Writers: partitioned Parquet, delimited text shards, CSV export, conversion jobs."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.schemas import REGISTRY, Dialect
from regspark.sources.delimited import CORRUPT_COL
from regspark.session import _hadoop_path
from regspark.sources.shards import list_shards, scan_shards, snapshot_from_path

EXPORT_DIALECT = Dialect(sep=",", header=True, encoding="UTF-8")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | tuple = ("snapshot",),
                  mode: str = "overwrite") -> str:
    """Parquet, partitioned by the given columns that exist (``snapshot`` by default).

    Readers then prune snapshot folders (``PartitionFilters``) and push value filters
    into the Parquet scan.
    """
    parts = [c for c in partition_by if c in df.columns]
    w = df.write.mode(mode)
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)
    return path


def write_shards(df: DataFrame, root: str, table_col: str = "shard_name",
                 snapshot_col: str = "snapshot", dialect: Dialect = REGISTRY,
                 mode: str = "overwrite") -> str:
    """Delimited text in the registry layout ``<root>/snapshot=<s>/shard_name=<T><i>/``.

    One job writes every shard of every snapshot; the two label columns become folders.
    """
    df.write.mode(mode).partitionBy(snapshot_col, table_col).options(**dialect.write_options()).csv(root)
    return root


def unique_names(df: DataFrame, suffix: str = "_2") -> DataFrame:
    """Rename repeated column names positionally (``pais``, ``pais`` -> ``pais``, ``pais_2``)."""
    seen: Counter = Counter()
    names = []
    for c in df.columns:
        name = c
        while name in seen:
            name = f"{name}{suffix}"
        seen[name] += 1
        names.append(name)
    return df.toDF(*names)


def export_csv(df: DataFrame, path: str, dialect: Dialect = EXPORT_DIALECT,
               mode: str = "overwrite") -> str:
    """Distributed tabular export with a header row (no driver collect)."""
    unique_names(df).write.mode(mode).options(**dialect.write_options()).csv(path)
    return path


STATUS_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("error", T.StringType()),
])


FILE_ERROR_SCHEMA = "table_name string, file string, error string"


def _convert(files: list[str], job) -> list[tuple[str, str]]:
    """Run ``job(files)``; if it fails, on halves, down to single files.  [(file, error)] of those
    that fail alone: with b of n files unreadable, about b log2(n) jobs more."""
    try:
        job(files)
        return []
    except Exception as e:  # noqa: BLE001 — reported per file, as data
        if len(files) == 1:
            return [(files[0], f"{type(e).__name__}: {str(e).splitlines()[0][:300]}")]
    half = len(files) // 2
    return _convert(files[:half], job) + _convert(files[half:], job)


def csv_to_parquet(spark: SparkSession, src_root: str, out_root: str,
                   tables: dict[str, tuple[str, T.StructType]], dialect: Dialect = REGISTRY,
                   partition_by: tuple = ("snapshot",), errors: list | None = None) -> DataFrame:
    """Convert every shard of every table to Parquet, one Spark job per table.

    A table that fails (missing input, write error) does not stop the others, and a file that cannot be
    read does not stop its table: the other files are converted, and the table's status is
    ``partial``.  The result is one status row per table with the rows written, which the writing job
    itself counts.  ``errors`` (a list) receives (table_name, file, error) of every such file; see
    ``FILE_ERROR_SCHEMA``.
    """
    status = []
    for name, (keyword, schema) in tables.items():
        path, counted = f"{out_root.rstrip('/')}/{name}", []

        def job(files, schema=schema, path=path, counted=counted):
            full = T.StructType([*schema.fields, T.StructField(CORRUPT_COL, T.StringType(), True)])
            df = (spark.read.schema(full).options(**dialect.read_options()).option("columnNameOfCorruptRecord", CORRUPT_COL)
                  .option("columnPruning", "false").csv(files))
            rows = df.select("*", snapshot_from_path(F.col("_metadata.file_path")).alias("snapshot"))
            seen = Observation()
            good = rows.where(F.col(CORRUPT_COL).isNull()).drop(CORRUPT_COL).observe(seen, F.count(F.lit(1)).alias("n"))
            write_parquet(good, path, partition_by, mode="append")                      # bad lines are skipped
            counted.append(seen.get["n"])
        try:
            files = list_shards(spark, src_root, keyword)
            if not files:
                raise FileNotFoundError(f"no shard matching {keyword!r} under {src_root!r}")
            _start_over(spark, path)
            failed = _convert(files, job)
            if errors is not None:
                errors.extend((name, f, e) for f, e in failed)
            n = sum(counted)
            if len(failed) == len(files):
                status.append((name, "failed", None, failed[0][1]))
            else:
                status.append((name, "partial" if failed else "ok", n, "; ".join(f"{f}: {e}" for f, e in failed[:3]) or None))
        except Exception as e:  # noqa: BLE001 — reported per table, as data
            status.append((name, "failed", None, f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"))
    return spark.createDataFrame(status, STATUS_SCHEMA)


def _start_over(spark: SparkSession, path: str) -> None:
    """A converted table is written anew, as ``overwrite`` does."""
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


def conversion_file_status(spark: SparkSession, src_root: str, tables: dict[str, tuple[str, T.StructType]],
                           dialect: Dialect = REGISTRY) -> DataFrame:
    """One row per shard file: rows that convert, malformed lines (skipped), and a status
    ``ok``, ``partial`` or ``failed`` (no line fits).  One job per table, grouped by file."""
    out = None
    for name, (keyword, schema) in tables.items():
        df = scan_shards(spark, src_root, keyword, schema, dialect, corrupt=True)
        bad = F.col(CORRUPT_COL).isNotNull()
        own = df.groupBy("snapshot", F.col("source_file").alias("file")).agg(
            F.count(F.when(~bad, F.struct(*[f.name for f in schema.fields]))).alias("n_rows"), F.count(F.when(bad, 1)).alias("n_bad"))
        status = F.when(F.col("n_bad") == 0, "ok").when(F.col("n_rows") > 0, "partial").otherwise("failed")
        own = own.select(F.lit(name).alias("table_name"), "snapshot", "file", "n_rows", "n_bad", status.alias("status"))
        out = own if out is None else out.unionByName(own)
    return out
