"""Registry-layout text and archives derived from the driver tables.

The text-facing queries (scans, converters, archives, incremental pickup) need registry
files.  They are written here by Spark jobs from whole driver tables into a fresh folder
under the shared checkpoint root, so every query's work still grows with the tables.

Layout (``write_shards``): ``<root>/snapshot=<YYYY-MM>/shard_name=<Table><i>/part-*.csv``
with snapshot = parity of a non-key column and shard = that column mod 10.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.schemas import REGISTRY, Dialect
from regspark.session import _hadoop_path, qualified, staging_path
from regspark.sinks.writers import write_shards
from regspark.sources.archives import _ship_by_value

PART_SNAPSHOT_COL = "p_size"


def label_shards(df: DataFrame, table_name: str, col: str) -> DataFrame:
    """Add ``snapshot`` (parity of ``col``) and ``shard_name`` (``<table><col mod 10>``)."""
    return (df.withColumn("snapshot", F.when(F.pmod(F.col(col), F.lit(2)) == 0, F.lit("2023-05"))
                          .otherwise(F.lit("2025-01")))
            .withColumn("shard_name", F.concat(F.lit(table_name), F.pmod(F.col(col), F.lit(10)).cast("string"))))


def stage_text(df: DataFrame, table_name: str, col: str, root: str,
               dialect: Dialect = REGISTRY, one_file_per_shard: bool = True) -> str:
    """Add ``df`` as registry text shards under ``root`` (one job; other tables kept)."""
    labelled = label_shards(df, table_name, col)
    if one_file_per_shard:
        labelled = labelled.repartition("snapshot", "shard_name")
    return write_shards(labelled, root, dialect=dialect, mode="append")


def publish_shards(spark: SparkSession, df: DataFrame, root: str, dialect: Dialect = REGISTRY,
                   order: list[str] | tuple = (), suffix: str = ".csv") -> str:
    """``df`` with ``snapshot`` and ``shard_name`` as ``<root>/<snapshot>/<shard>.csv``, one file for each
    shard; a file of that name is replaced."""
    draft = staging_path(spark, "publish")
    out = df.repartition("snapshot", "shard_name")
    write_shards(out.sortWithinPartitions("snapshot", "shard_name", *order) if order else out, draft, dialect=dialect)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(draft)
             .select("path", F.regexp_extract("path", "snapshot=([^/]*)/", 1).alias("snapshot"),
                     F.regexp_extract("path", "shard_name=([^/]*)/", 1).alias("shard")).collect())
    for f in files:
        move_file(spark, f["path"], f"{root}/{f['snapshot']}/{f['shard']}{suffix}")
    return root


def move_file(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file, replacing what is there."""
    (a, fs), (b, _) = _hadoop_path(spark, source), _hadoop_path(spark, target)
    fs.mkdirs(b.getParent())
    fs.delete(b, False)
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {source} to {target}")


def remove_files(spark: SparkSession, pattern: str) -> None:
    p, fs = _hadoop_path(spark, pattern)
    for found in fs.globStatus(p):
        fs.delete(found.getPath(), True)


_STAGED: dict[tuple, str] = {}


def stage_registry(spark: SparkSession, sf_dir: str, name: str = "registry",
                   dialect: Dialect = REGISTRY, tables: tuple = ("part", "supplier")) -> str:
    """``part`` (shards ``Part0..9``) and ``supplier`` (``Supplier0..9``) as registry text.

    The text is input data, like the Parquet tables it comes from: it is written once per
    session (and per table set / dialect) and shared by the queries that scan it.
    """
    from regspark.plans.analogues import table, table_versions
    key = (spark.sparkContext.applicationId, sf_dir, tuple(tables), dialect, table_versions(spark, sf_dir, tables))
    if key in _STAGED:
        return _STAGED[key]
    root = staging_path(spark, name)
    cols = {"part": ("Part", "p_size"), "supplier": ("Supplier", "s_nationkey"),
            "customer": ("Customer", "c_nationkey"), "nation": ("Nation", "n_nationkey")}
    for t in tables:
        label, col = cols[t]
        stage_text(table(spark, sf_dir, t), label, col, root, dialect)
    _STAGED[key] = root
    return root


def write_lines(lines, path: str, header_line: str | None = None) -> str:
    """Write one pre-formatted text column verbatim, each file starting with ``header_line``.

    The line column is written as a single CSV field with a separator and quote that
    never occur in it, so nothing is quoted or escaped.
    """
    col = lines.columns[0]
    out = lines.select(F.col(col).alias(header_line or col))
    (out.write.option("header", str(header_line is not None).lower()).option("sep", "\t")
     .option("quote", "\u0001").option("escapeQuotes", "false").csv(path))
    return path


# --- archives ------------------------------------------------------------------------------

def _local(path: str) -> str:
    return path[len("file:"):].replace("//", "", 1) if path.startswith("file://") else path[len("file:"):]


def _zipper(out_dir: str, member_rule, corrupt_shards: tuple, readme_shards: tuple):
    """Per staged text file: write ``<shard>-<snapshot>.zip`` holding it as ``<shard>.csv``."""
    def run(batches):
        import pyarrow.fs as pafs
        fs, base = (pafs.LocalFileSystem(), _local(out_dir)) if out_dir.startswith("file:") else \
            pafs.FileSystem.from_uri(out_dir)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                snap = path.split("snapshot=")[1].split("/")[0]
                shard = path.split("shard_name=")[1].split("/")[0]
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                    zf.writestr(member_rule(shard), content)
                    if shard in readme_shards:
                        zf.writestr("README.txt", b"registry shard\n")
                data = buf.getvalue()
                name = f"{shard}-{snap}.zip"
                with fs.open_output_stream(f"{base}/{name}") as f:
                    f.write(data)
                out.append((name, len(data)))
                if shard in corrupt_shards:
                    bad = f"{shard}-{snap}-truncated.zip"
                    with fs.open_output_stream(f"{base}/{bad}") as f:
                        f.write(data[: len(data) // 2])
                    out.append((bad, len(data) // 2))
            yield pd.DataFrame(out, columns=["archive_name", "n_bytes"])
    return run


def stage_archives(spark: SparkSession, text_root: str, out_dir: str | None = None,
                   corrupt_shards: tuple = ("Part9",), readme_shards: tuple = ("Part0",)) -> str:
    """Pack each staged text file into a zip archive (Spark tasks, one per file).

    Shards in ``corrupt_shards`` also get a truncated, unreadable copy; shards in
    ``readme_shards`` get a second, non-CSV member.
    """
    # the file system is Spark's choice, not the task's
    out_dir = qualified(spark, out_dir or staging_path(spark, "archives"))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
             .option("recursiveFileLookup", "true").load(text_root).select("path", "content"))
    fn = _zipper(out_dir, lambda shard: f"{shard}.csv", corrupt_shards, readme_shards)
    schema = T.StructType([T.StructField("archive_name", T.StringType()),
                           T.StructField("n_bytes", T.LongType())])
    files.mapInPandas(fn, schema).write.mode("overwrite").parquet(out_dir + "/_manifest")
    return out_dir


_ship_by_value(__name__)
