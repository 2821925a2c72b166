"""Registry-shaped inputs derived from the driver's test tables.

The test tables hold no registry data, so each registered query maps them onto the
registry's shapes:

* companies      = ``part``     (key, name, capital)
* establishments = ``part``     (key, trade name, activity code)
* partners       = ``supplier`` (key, partner name)

A name is the part's name and its block of ``NAME_BLOCK`` consecutive keys, so a name belongs to
at most that many companies however large the table is (real company names are nearly
unique).  Keys are zero-padded to eight characters, like registry base numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.functions.keys import padded_key
from regspark.session import path_version

KEY_WIDTH = 8
NAME_BLOCK = 16


_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the relation (file listing, footer schema) is resolved once per session
    and again when its files have changed."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path, path_version(spark, path))
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def block_name(name: str, key: str) -> Column:
    return F.concat(F.col(name), F.lit(" "), F.floor(F.col(key) / NAME_BLOCK).cast("string"))


def table_versions(spark: SparkSession, sf_dir: str, names) -> tuple:
    return tuple(path_version(spark, f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names)


def companies(spark: SparkSession, sf_dir: str, snapshot: bool = False) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cols = [padded_key("p_partkey", KEY_WIDTH).alias("cnpj_emp"), block_name("p_name", "p_partkey").alias("razao_emp"),
            F.col("p_retailprice").alias("cap_soc_emp")]
    if snapshot:
        cols.append(snapshot_of_size("p_size"))
    return p.select(*cols)


def establishments(spark: SparkSession, sf_dir: str, snapshot: bool = False) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cols = [padded_key("p_partkey", KEY_WIDTH).alias("cnpj"), block_name("p_name", "p_partkey").alias("fantasia"),
            F.col("p_brand").alias("cnae")]
    if snapshot:
        cols.append(snapshot_of_size("p_size"))
    return p.select(*cols)


def partners(spark: SparkSession, sf_dir: str, snapshot: bool = False) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    cols = [padded_key("s_suppkey", KEY_WIDTH).alias("cnpj_soc"), F.col("s_name").alias("nome_socio")]
    if snapshot:
        cols.append(snapshot_of_size("s_nationkey"))
    return s.select(*cols)


def snapshot_of_size(c: str) -> Column:
    """Two snapshots assigned by the parity of a non-key column (every row kept)."""
    return F.when(F.pmod(F.col(c), F.lit(2)) == 0, F.lit("2023-05")).otherwise(F.lit("2025-01")) \
        .alias("snapshot")
