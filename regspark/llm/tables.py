"""Small DataFrame helpers shared by the text operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.session import _hadoop_path, staging_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def with_fields(df: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    """``df`` plus the fields ``names`` of ``struct``; same-named input columns give way."""
    held = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    got = df.select(*[F.col(f"`{c}`") for c in held], struct.alias("__fields"))
    return got.select(*[F.col(f"`{c}`") for c in held], *[F.col(f"__fields.{n}").alias(n) for n in names])


def text_key(text: Column) -> Column:
    """A second key beside ``doc_id``: tells rows with one id but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage)."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession, *paths: str) -> None:
    """Delete staged folders that nothing reads again, and have the JVM collect, upon which Spark deletes the shuffle
    files of plans that nothing refers to."""
    for path in paths:
        p, fs = _hadoop_path(spark, path)
        fs.delete(p, True)
    gc.collect()
    spark._jvm.java.lang.System.gc()


def sieved(df: DataFrame, keys: DataFrame, names: list[str], bits: int = 1 << 25) -> DataFrame:
    """Rows of ``df`` whose columns ``names`` may be among ``keys`` (same names and types): all that are, and
    few others.  Before an exact join with few keys it spares most rows the shuffle.  That join is an inner
    one with distinct keys: Spark moves a semi join below the bitmap.

    The keys' hashes are marks in a bitmap of ``bits`` bits, 4 MB however large the tables are; with
    more keys than that more rows pass, which the exact join drops."""
    place = F.pmod(F.xxhash64(*names), F.lit(bits))
    bucket, bit = F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place)
    maps = (keys.select(bucket, bit.alias("__bit")).repartition("__bucket")
            .groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map")))
    byte = F.conv(F.hex(F.substring("__map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*held, bucket).join(F.broadcast(maps), "__bucket").where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*held)


def in_fold(doc_id: Column, k: int) -> Column:
    """Whether crc32 of the id's decimal text is ``k`` modulo 5 (a null id: crc32 of '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == k
