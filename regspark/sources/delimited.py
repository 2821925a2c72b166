"""Delimited-text scans.

The default is an explicit all-string schema: no inference pass over the data, and keys
keep their zero padding.  The inferring reader exists for parity with files whose
columns really are numeric, and is the slower path (one extra scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.schemas import REGISTRY, Dialect, string_schema
from regspark.session import cut_lineage, staging_path

CORRUPT_COL = "_corrupt_record"


def _reader(spark: SparkSession, dialect: Dialect, options: dict | None):
    r = spark.read.options(**dialect.read_options())
    return r.options(**(options or {}))


def read_delimited(spark: SparkSession, paths, schema: T.StructType | str | None = None,
                   dialect: Dialect = REGISTRY, options: dict | None = None) -> DataFrame:
    """Scan delimited text with a given schema (or Spark's ``_c0.._cN`` strings)."""
    r = _reader(spark, dialect, options)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(paths)


def read_headerless(spark: SparkSession, paths, names: list[str],
                    dialect: Dialect = REGISTRY, options: dict | None = None) -> DataFrame:
    """Headerless scan with positional names, every column a string."""
    return read_delimited(spark, paths, string_schema(names), dialect, options)


def read_inferred(spark: SparkSession, paths, names: list[str] | None = None,
                  dialect: Dialect = REGISTRY, options: dict | None = None) -> DataFrame:
    """Scan with type inference, then rename all columns by position (``toDF``).

    Raises when the inferred column count differs from ``len(names)``.
    """
    df = _reader(spark, dialect, options).option("inferSchema", "true").csv(paths)
    return df.toDF(*names) if names else df


def rename_positional(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename every column by position."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns, {len(names)} names")
    return df.toDF(*names)


def read_positional(spark: SparkSession, paths, dialect: Dialect = REGISTRY,
                    n_cols: int | None = None, options: dict | None = None) -> DataFrame:
    """Positional string columns ``_c0 .. _cN`` (one partitioned scan, no chunking)."""
    schema = string_schema([f"_c{i}" for i in range(n_cols)]) if n_cols else None
    return read_delimited(spark, paths, schema, dialect.with_(header=False), options)


def read_with_header(spark: SparkSession, paths, dialect: Dialect = REGISTRY.with_(header=True),
                     schema: T.StructType | None = None, options: dict | None = None) -> DataFrame:
    """Scan whose first line names the columns."""
    return read_delimited(spark, paths, schema, dialect.with_(header=True), options)


def read_split_malformed(spark: SparkSession, paths, schema: T.StructType,
                         dialect: Dialect = REGISTRY, options: dict | None = None,
                         stage_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan with bad-line separation: ``(good_rows, rejected_lines)``.

    Lines whose field count differs from the schema are flagged PERMISSIVE-ly into
    ``_corrupt_record`` (with CSV column pruning off, so the check does not depend on
    which columns a later query selects).  The parsed scan is written once to the shared
    staging folder and both outputs read that table: a stable split that survives
    executor loss and is not re-parsed per consumer.
    """
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT_COL, T.StringType(), True)])
    opts = {"columnNameOfCorruptRecord": CORRUPT_COL, "columnPruning": "false", "mode": "PERMISSIVE"}
    opts.update(options or {})
    parsed = read_delimited(spark, paths, full, dialect, opts)
    path = stage_dir or staging_path(spark, "malformed-split")
    parsed.write.mode("overwrite").parquet(path)
    staged = spark.read.parquet(path)
    good = staged.where(F.col(CORRUPT_COL).isNull()).drop(CORRUPT_COL)
    bad = staged.where(F.col(CORRUPT_COL).isNotNull()).select(F.col(CORRUPT_COL).alias("line"))
    return good, bad


def read_quoted_records(spark: SparkSession, paths, schema: T.StructType, dialect: Dialect = REGISTRY,
                        keep_corrupt: bool = False) -> DataFrame:
    """Records with line breaks inside quoted fields, from splits of any file: what ``multiLine`` reads
    with a task for each file, read by as many tasks as the text has splits.

    A line break belongs to a field if the quotes before it are odd in number.  Each split counts
    its quotes; a prefix sum over the splits of a file says whether a split starts inside a field;
    a running sum within it says so for each line.  Lines that are whole records go on as they are;
    only those of longer records are brought together, by record.  Parsing is ``from_csv``.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    # the text source keeps bytes as they are: decode them by the dialect
    line = F.decode(F.col("value").cast("binary"), dialect.encoding)
    split = ["__path", "__start"]
    lines = text.select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"),
                        F.monotonically_increasing_id().alias("__at"), line.alias("__line"))
    lines = cut_lineage(lines.withColumn("__quotes", F.length("__line") - F.length(F.replace("__line", F.lit(dialect.quote), F.lit("")))),
                        spark, "quoted-lines")
    counts = lines.groupBy(*split).agg(F.sum("__quotes").alias("__n"))
    parity = counts.select(*split, F.coalesce(F.sum("__n").over(Window.partitionBy("__path").orderBy("__start").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*split).orderBy("__at")
    run = F.col("__before") + F.coalesce(F.sum("__quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(parity, split).withColumn("__run", run).select(
        "*", (F.col("__run") % 2 == 0).alias("__opens"), ((F.col("__run") + F.col("__quotes")) % 2 == 0).alias("__ends"))
    # a record is named by the quotes before it: those of a long record are odd within, so no two share it
    whole = placed.where("__opens and __ends").select("__path", "__start", "__at", F.col("__line").alias("__record"))
    pieces = placed.where("not (__opens and __ends)").withColumn(
        "__no", F.when(F.col("__opens"), F.col("__run")).otherwise(None))
    # the opening line of a record in a split, or else the last one of an earlier split
    opened = pieces.withColumn("__no", F.last("__no", ignorenulls=True).over(inside))
    last = (opened.where("__no is not null").groupBy(*split).agg(F.max("__no").alias("__last")))
    every = counts.select(*split).join(last, split, "left")
    carried = every.withColumn("__carry", F.last("__last", ignorenulls=True).over(
        Window.partitionBy("__path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    named = opened.join(carried, split).withColumn("__no", F.coalesce("__no", "__carry"))
    long = (named.groupBy("__path", "__no").agg(F.array_sort(F.collect_list(F.struct("__start", "__at", "__line"))).alias("__all"))
            .select("__path", F.col("__all")[0]["__start"].alias("__start"), F.col("__all")[0]["__at"].alias("__at"),
                    F.array_join("__all.__line", "\n").alias("__record")))
    records = whole.unionByName(long)
    if dialect.header:
        first = lines.where("__start = 0").groupBy("__path").agg(F.min("__at").alias("__head"))
        records = (records.join(first, "__path").where(~((F.col("__start") == 0) & (F.col("__at") == F.col("__head")))).drop("__head"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"sep": dialect.sep, "quote": dialect.quote, "escape": dialect.escape, "nullValue": dialect.null_value,
               "mode": "PERMISSIVE", "multiLine": "true"}
    if keep_corrupt:
        ddl += f", `{CORRUPT_COL}` string"
        options["columnNameOfCorruptRecord"] = CORRUPT_COL
    record = F.regexp_replace("__record", "\r$", "")
    return records.where(record != "").select(F.from_csv(record, ddl, options).alias("__r")).select("__r.*")
