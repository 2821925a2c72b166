"""Ingest planning as DataFrame operators over archive manifests.

The wanted list (table types × shards, plus dimensions), what a listing offers and what
is already present are all DataFrames; membership checks are semi / anti joins and the
per-archive action is one projection, so planning a run over thousands of snapshots is
one Spark job rather than a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.functions.names import archive_name
from regspark.schemas import DIMENSION_NAMES, SHARDS_PER_TABLE

MANIFEST_COLUMNS = ["kind", "table_type", "shard", "archive_name"]


def wanted_facts(table_types: DataFrame, type_col: str = "table_type",
                 shards: int = SHARDS_PER_TABLE) -> DataFrame:
    """Every ``<Type><i>.zip`` for ``i`` in ``0..shards-1``; a generator, not a cross join."""
    return (table_types.select(F.col(type_col).alias("table_type")).distinct()
            .select("table_type", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
            .select(F.lit("data").alias("kind"), "table_type", "shard",
                    archive_name("table_type", "shard").alias("archive_name")))


def wanted_dimensions(spark: SparkSession, names: list[str] = DIMENSION_NAMES) -> DataFrame:
    """The dimension archives ``<Name>.zip`` (a fixed, six-row list)."""
    rows = [("dimension", n, None, f"{n}.zip") for n in names]
    return spark.createDataFrame(rows, "kind string, table_type string, shard int, archive_name string")


def wanted_manifest(table_types: DataFrame, type_col: str = "table_type",
                    shards: int = SHARDS_PER_TABLE, dimensions: list[str] | None = None,
                    snapshots: list[str] | None = None, base_url: str | None = None) -> DataFrame:
    """Every wanted archive; with ``snapshots`` (the wanted dated folders, a parameter)
    one copy per snapshot with its local file name (shard kept) and, given ``base_url``,
    its remote URL.
    """
    facts = wanted_facts(table_types, type_col, shards)
    wanted = facts.unionByName(wanted_dimensions(table_types.sparkSession, dimensions)) \
        if dimensions else facts
    if not snapshots:
        return wanted
    # one generator over the (parameter) list: a single scan of the inputs, no cross join
    labels = F.array(*[F.lit(snapshot_label_of(s)) for s in snapshots])
    out = wanted.select("*", F.explode(labels).alias("snapshot"))
    local = F.concat(F.regexp_replace("archive_name", r"\.zip$", ""), F.lit("-"), F.col("snapshot"),
                     F.lit(".zip"))
    out = out.withColumn("local_name", local)
    if base_url:
        out = out.withColumn("url", F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("snapshot"),
                                             F.lit("/"), F.col("archive_name")))
    return out


def snapshot_label_of(folder: str) -> str:
    """``'2025-01/'`` -> ``'2025-01'``."""
    return folder.strip("/")


def snapshots_available(wanted: list[str] | DataFrame, listing: DataFrame,
                        listing_col: str = "href") -> DataFrame:
    """Wanted dated folders with a flag: does the listing offer them (``'20…/'`` links)."""
    spark = listing.sparkSession
    if isinstance(wanted, list):
        wanted = spark.createDataFrame([(snapshot_label_of(w),) for w in wanted], "snapshot string")
    offered = (listing.select(F.btrim(F.col(listing_col), F.lit("/")).alias("snapshot"))
               .where(F.col("snapshot").rlike(r"^20\d{2}-\d{2}$")).distinct()
               .withColumn("listed", F.lit(True)))
    return wanted.join(offered, "snapshot", "left") \
        .select("snapshot", F.coalesce("listed", F.lit(False)).alias("listed"))


def _names(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).alias("archive_name")).where(F.col("archive_name").isNotNull()).distinct()


def manifest_available(wanted: DataFrame, listing: DataFrame, listing_col: str = "archive_name") -> DataFrame:
    """Wanted archives that the listing offers (left semi join)."""
    return wanted.join(_names(listing, listing_col), "archive_name", "left_semi")


def manifest_missing(wanted: DataFrame, listing: DataFrame, listing_col: str = "archive_name") -> DataFrame:
    """Wanted archives the listing does not offer (left anti join)."""
    return wanted.join(_names(listing, listing_col), "archive_name", "left_anti")


def ingest_plan(wanted: DataFrame, listing: DataFrame, present: DataFrame,
                listing_col: str = "archive_name", present_col: str = "archive_name") -> DataFrame:
    """Per wanted archive: ``extract`` if present, ``download_extract`` if listed, else ``missing``."""
    avail = _names(listing, listing_col).withColumn("_listed", F.lit(True))
    local = _names(present, present_col).withColumn("_present", F.lit(True))
    out = wanted.join(avail, "archive_name", "left").join(local, "archive_name", "left")
    action = (F.when(F.col("_present"), F.lit("extract"))
              .when(F.col("_listed"), F.lit("download_extract"))
              .otherwise(F.lit("missing")))
    return out.select(*wanted.columns, action.alias("action"))


def route_archives(df: DataFrame, name_col: str = "archive_name",
                   dimensions: list[str] = DIMENSION_NAMES) -> DataFrame:
    """Tag each archive as ``dimension`` or ``data`` by its base name."""
    dim_files = [f"{d}.zip" for d in dimensions]
    kind = F.when(F.col(name_col).isin(dimensions) | F.col(name_col).isin(dim_files), "dimension") \
        .otherwise("data")
    return df.withColumn("route", kind)
