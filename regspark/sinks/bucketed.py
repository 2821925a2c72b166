"""Monthly tables kept in buckets of a join key, so that joining them again needs no shuffle.

``write_bucketed_pair`` stores the two sides of a join below one folder:

* ``left/`` and ``right/``: bucketed and sorted by the key, one file for each bucket.  Joined, bucket
  meets bucket where it lies; there is no Exchange under the join;
* ``left_hot/`` and ``right_hot/``: the rows of keys with more than ``hot_rows`` rows on a side, and the
  left rows without a key.  A bucket cannot be split when it is read, so these are kept out of the
  buckets and joined by ``equi_join``, which salts hot keys.  A key with a third of all rows thus
  fills no bucket;
* ``buckets/``: the number of buckets, written last.  A pair counts as written once it is there.

Right rows without a key match nothing and are not stored.  The files are plain Parquet under the
folder; the catalog entries that Spark wants for bucketed scans are made anew in a session that
has none.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.operators.joins import equi_join
from regspark.session import _hadoop_path, cut_lineage, qualified

KEY = "bucket_key"


def _table_name(spark: SparkSession, path: str, side: str) -> str:
    return f"bucketed_{md5(qualified(spark, path).encode()).hexdigest()}_{side}"


def _hot_keys(sides: list[DataFrame], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows on a side: at most rows / hot_rows on each."""
    counts = [s.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")) for s in sides]
    return counts[0].unionAll(counts[1]).where(F.col("n") > hot_rows).select(KEY).distinct()


def write_bucketed_pair(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, path: str,
                        buckets: int, hot_rows: int = 1_000_000) -> str:
    """Store both sides of a join by their key; ``read_bucketed_join`` joins them.  The keys must be of one type.

    Choose ``buckets`` so that a bucket of the larger side is some 256 MB; it is the number of tasks of
    the join.  What the folder held is replaced."""
    if KEY in left.columns or KEY in right.columns:
        raise ValueError(f"a column is named {KEY}")
    spark, path = left.sparkSession, path.rstrip("/")
    folder, fs = _hadoop_path(spark, path)
    fs.delete(folder, True)
    sides = [left.withColumn(KEY, left_key), right.withColumn(KEY, right_key).where(F.col(KEY).isNotNull())]
    if sides[0].schema[KEY].dataType != sides[1].schema[KEY].dataType:
        raise ValueError("the keys are not of one type")
    keyed = [s.where(F.col(KEY).isNotNull()) for s in sides]
    hot = cut_lineage(_hot_keys(keyed, hot_rows), spark, "hot-keys")
    for side, rows, with_key in zip(("left", "right"), sides, keyed):
        few = with_key.join(hot, KEY, "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns])
        many = with_key.join(hot, KEY, "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns])
        (few.repartition(buckets, KEY).write.mode("overwrite").format("parquet").option("path", f"{path}/{side}")
         .bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(_table_name(spark, path, side)))
        many.unionAll(rows.where(F.col(KEY).isNull())).write.parquet(f"{path}/{side}_hot")
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(hot_rows).cast("long").alias("hot_rows")).write.parquet(f"{path}/buckets")
    return path


def _bucketed(spark: SparkSession, path: str, side: str, buckets: int) -> DataFrame:
    name = _table_name(spark, path, side)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{side}").schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
                  f"INTO {buckets} BUCKETS LOCATION '{qualified(spark, path)}/{side}'")
    return spark.table(name)


def read_bucketed_join(spark: SparkSession, path: str, how: str = "inner") -> DataFrame:
    """The join (``inner`` or ``left``) of a stored pair: the columns of the left side, then of the right."""
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    path = path.rstrip("/")
    stored = spark.read.parquet(f"{path}/buckets").first()
    l, r = (_bucketed(spark, path, side, stored["buckets"]) for side in ("left", "right"))
    joined = l.join(r, l[KEY] == r[KEY], how).select(*[l[f"`{c}`"] for c in l.columns if c != KEY], *[r[f"`{c}`"] for c in r.columns if c != KEY])
    lh, rh = (spark.read.parquet(f"{path}/{side}_hot") for side in ("left", "right"))
    return joined.unionAll(_hot_join(lh, rh, how, stored["hot_rows"]))


def _hot_join(left: DataFrame, right: DataFrame, how: str, hot_rows: int) -> DataFrame:
    both = equi_join(left, right, F.col(KEY), F.col(KEY), how, hot_rows=hot_rows)
    names = [f"c{i}" for i in range(len(both.columns))]
    keep = [(n, c) for n, c in zip(names, both.columns) if c != KEY]
    return both.toDF(*names).select(*[F.col(n).alias(c) for n, c in keep])
