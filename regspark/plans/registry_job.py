"""The registry job end to end: shards on disk → joined, snapshot-partitioned Parquet.

    companies, establishments, partners   (every shard of every snapshot, one scan each)
      → lines that do not fit and archives that cannot be read go to the rejects
      → cleaning and code descriptions, if asked for
      → full-row dedup per snapshot
      → companies ⋈name establishments ⟕prefix partners   (snapshot equality in both joins)
      → Parquet partitioned by snapshot, then a manifest row per snapshot

Inputs are found by keyword in any case (``EMPRE`` matches ``Empresas0.csv`` and
``K3241.K03200Y0.D50111.EMPRECSV``); text shards or zip archives are both accepted, in dated
folders or (``flat``) with the date in the file name.

Nothing is lost without a word: a table without files in some snapshot raises unless it
is named in ``optional``; every rejected line or archive is a row of ``<out>_rejects``; a
snapshot counts as done only if the manifest lists the very file versions (path, length,
modification time) that are there now, so a late shard, one repaired under its old name, or a
half-written snapshot is done again.

Every run writes to folders of its own, ``<out>/run=<id>/snapshot=<label>`` and the same under
``<out>_rejects``; the manifest says which run is valid for each snapshot.  Appending to it is the
one commit of result and rejects: a rerun without rows leaves none, mended rejects go away, and a
run that dies before it changes nothing.  Read with ``registry_output`` and ``registry_rejects``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.functions.clean import clean_columns
from regspark.operators.dims import resolve_codes, segment_of
from regspark.plans.company_partners import company_partners
from regspark.schemas import EMPRE_SCHEMA, ESTA_SCHEMA, REGISTRY, SOCIOS_SCHEMA, TABLE_KEYWORDS, Dialect
from regspark.session import _hadoop_path, staging_path
from regspark.sources.archives import parse_lines, read_archive_lines, split_rejects
from regspark.sources.delimited import CORRUPT_COL
from regspark.sources.ledger import list_files, new_run
from regspark.sources.shards import list_shards, require_complete, scan_shards, shard_glob, snapshot_from_path, snapshot_label

DEFAULT_SCHEMAS = {"empre": EMPRE_SCHEMA, "esta": ESTA_SCHEMA, "socios": SOCIOS_SCHEMA}
# --- fixed values: columns of the joined table by kind ----------------------------------
MONEY_COLUMNS = ["cap_soc_emp"]
DATE_COLUMNS = ["data_sit_cad", "dat_ini_at", "dat_sit_exp", "dat_ent"]
# ----------------------------------------------------------------------------------------
REJECT_COLUMNS = ["table_name", "snapshot", "source", "error", "line"]
MANIFEST_SCHEMA = ("snapshot string, run string, files array<struct<path:string,length:bigint,modified:bigint>>, "
                   "schema string, written_at timestamp")


def clean_registry(df: DataFrame, keep: list[str] = ("snapshot",)) -> DataFrame:
    """Trimmed text (empty: null), decimal amounts and dates of a registry table."""
    kept = set(keep)
    text = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in kept | set(MONEY_COLUMNS) | set(DATE_COLUMNS)]
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return clean_columns(df, text, [c for c in MONEY_COLUMNS if c in strings], [c for c in DATE_COLUMNS if c in strings])


def categorise(joined: DataFrame, dimensions: dict[str, DataFrame] | None = None, code_col: str = "cnae") -> DataFrame:
    """The joined rows with code descriptions and the ``segment`` of the activity code."""
    out = resolve_codes(joined, dimensions) if dimensions else joined
    return out.withColumn("segment", segment_of(code_col))


def segment_report(categorised: DataFrame, company_col: str = "cnpj_emp") -> DataFrame:
    """Rows and companies per snapshot and segment."""
    return categorised.groupBy("snapshot", "segment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(company_col).alias("n_companies"))


def _staged(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    path = staging_path(spark, name)
    df.write.partitionBy("snapshot").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load_with_rejects(spark: SparkSession, root: str, schemas: dict[str, T.StructType] | None = None,
                      keywords: dict[str, str] | None = None, dialect: Dialect = REGISTRY,
                      archives: bool = False, snapshots: list[str] | None = None,
                      spread_partitions: int | None = None, optional: list[str] | tuple = (),
                      flat: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """``({empre, esta, socios}, rejects)`` over every (or the listed) snapshot.

    Each table is read once, into the shared staging folder partitioned by snapshot; its
    good rows and its rejects are two filters of that table, so later jobs (counts, joins)
    do not parse text or unzip archives again.  A zip archive is one task; its lines are
    spread over ``spread_partitions`` tasks (default: ``spark.sql.shuffle.partitions``)
    before parsing.
    """
    schemas = schemas or DEFAULT_SCHEMAS
    keywords = keywords or TABLE_KEYWORDS
    found = {t: list_shards(spark, root, keywords[t], snapshots or "*", flat) for t in schemas}
    require_complete(found, snapshots, optional)
    out, rejects = {}, None
    for name, schema in schemas.items():
        names = [f.name for f in schema.fields]
        if not found[name]:
            out[name] = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("snapshot", T.StringType())]))
            continue
        if archives:
            spread = spread_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
            lines = read_archive_lines(spark, shard_glob(root, keywords[name], snapshots or "*", flat),
                                       encoding=dialect.encoding,
                                       multi_line_quote=dialect.quote if dialect.multi_line else None)
            path = staging_path(spark, f"lines-{name}")
            lines.write.parquet(path)                       # unzipped once
            good, bad = split_rejects(spark.read.schema(lines.schema).parquet(path))
            # label first, so the spread shuffle carries the short snapshot, not the path
            good = good.select(snapshot_from_path(F.col("archive")).alias("snapshot"), "line_no", "line",
                               F.element_at(F.split("archive", "/"), -1).alias("source"))
            rows = parse_lines(good, schema, dialect, dialect.header, keep=["snapshot", "source"],
                               spread_partitions=spread, corrupt=True)
            broken = bad.select(snapshot_from_path(F.col("archive")).alias("snapshot"),
                                F.element_at(F.split("archive", "/"), -1).alias("source"), "error",
                                F.lit(None).cast("string").alias("line"))
        else:
            rows = (scan_shards(spark, root, keywords[name], schema, dialect, snapshot=snapshots or "*",
                                corrupt=True, flat=flat)
                    .withColumn("source", F.element_at(F.split("source_file", "/"), -1)))
            broken = None
        staged = _staged(rows.select(*names, CORRUPT_COL, "source", "snapshot"), spark, f"rows-{name}")
        out[name] = staged.where(F.col(CORRUPT_COL).isNull()).select(*names, "snapshot")
        own = staged.where(F.col(CORRUPT_COL).isNotNull()).select(
            "snapshot", "source", F.lit("MalformedLine").alias("error"), F.col(CORRUPT_COL).alias("line"))
        own = own.unionByName(broken) if broken is not None else own
        own = own.select(F.lit(name).alias("table_name"), *REJECT_COLUMNS[1:])
        rejects = own if rejects is None else rejects.unionByName(own)
    return out, rejects


def load_tables(spark: SparkSession, root: str, *args, **kw) -> dict[str, DataFrame]:
    """The good rows of :func:`load_with_rejects`."""
    return load_with_rejects(spark, root, *args, **kw)[0]


def _manifest(spark: SparkSession, out_path: str) -> DataFrame:
    """Latest manifest row of every snapshot."""
    from pyspark.errors import AnalysisException
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(out_path.rstrip("/") + "_manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    last = F.max_by(F.struct("run", "files", "schema"), F.struct("written_at", "run")).alias("last")
    return rows.groupBy("snapshot").agg(last).select("snapshot", "last.*")


def _valid(spark: SparkSession, out_path: str) -> list:
    """Manifest rows of the snapshots that an output holds (one row each, no data)."""
    return _manifest(spark, out_path).where("run is not null").collect()


def done_snapshots(spark: SparkSession, out_path: str) -> dict[str, list[tuple]]:
    """Snapshots committed to an output, with the versions (path, length, modified in
    microseconds) of the input files of each."""
    return {r["snapshot"]: sorted(map(tuple, r["files"])) for r in _valid(spark, out_path)}


def _read_valid(spark: SparkSession, path: str, rows: list, schema: T.StructType) -> DataFrame:
    """The folders of valid (run, snapshot) pairs; a pair without rows has none."""
    full = T.StructType([*[f for f in schema.fields if f.name != "snapshot"], T.StructField("run", T.StringType()),
                         T.StructField("snapshot", T.StringType())])
    folders = [f"{path}/run={r['run']}/snapshot={r['snapshot']}" for r in rows]
    folders = [f for f in folders for p, fs in [_hadoop_path(spark, f)] if fs.exists(p)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(full).option("basePath", path).parquet(*folders).select(*schema.fieldNames())


def registry_output(spark: SparkSession, out_path: str) -> DataFrame:
    """The joined rows that the manifest of an output names."""
    rows = _valid(spark, out_path)
    if not rows:
        raise FileNotFoundError(f"no committed snapshot in {out_path}")
    # the columns of the newest run; a column that an older one lacks is null there
    schema = T.StructType.fromJson(json.loads(max(rows, key=lambda r: r["run"])["schema"]))
    return _read_valid(spark, out_path.rstrip("/"), rows, schema)


def drop_superseded(spark: SparkSession, out_path: str) -> int:
    """Delete folders of runs older than the newest that the manifest does not name; returns how
    many.  A query that is still reading one of them fails."""
    rows = _valid(spark, out_path)
    valid, newest = {(f"run={r['run']}", f"snapshot={r['snapshot']}") for r in rows}, max((r["run"] for r in rows), default="")
    gone = 0
    for path in (out_path.rstrip("/"), out_path.rstrip("/") + "_rejects"):
        p, fs = _hadoop_path(spark, path)
        runs = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        for run in (r for r in runs if r.getName().startswith("run=") and r.getName() <= f"run={newest}"):
            parts = [s.getPath() for s in fs.listStatus(run) if s.getPath().getName().startswith("snapshot=")]
            old = [x for x in parts if (run.getName(), x.getName()) not in valid]
            for x in [run] if len(old) == len(parts) else old:
                fs.delete(x, True)
                gone += 1
    return gone


def run_registry_job(spark: SparkSession, root: str, out_path: str | None = None, *,
                     schemas: dict[str, T.StructType] | None = None,
                     keywords: dict[str, str] | None = None, dialect: Dialect = REGISTRY,
                     archives: bool = False, hot_rows: int | None = 1_000_000,
                     snapshots: list[str] | None = None, incremental: bool = False,
                     optional: list[str] | tuple = (), flat: bool = False, clean: bool = False,
                     dimensions: dict[str, DataFrame] | None = None, with_segment: bool = False,
                     keep_superseded: bool = False, **join_kw) -> DataFrame:
    """Build the joined table per snapshot; write it when ``out_path`` is given.

    ``snapshots`` (the wanted dated folders) restricts what is read, and when written only
    these are replaced; without it the output afterwards holds the snapshots found now and no
    others.  With ``incremental=True`` wanted snapshots whose file versions are those of the
    manifest are skipped; new ones, and ones with other files, are done.
    ``clean`` trims text and types amounts and dates; ``dimensions`` (see ``load_dimensions``)
    adds descriptions of codes; ``with_segment`` adds the segment of the activity code.
    Written runs also write ``<out>_rejects`` and ``<out>_manifest``, and delete what no longer
    counts unless ``keep_superseded`` (then ``drop_superseded`` does it).  Returns the joined
    DataFrame (the whole output, read back, when written).
    """
    schemas, keywords = schemas or DEFAULT_SCHEMAS, keywords or TABLE_KEYWORDS
    snapshots = [s.strip("/") for s in snapshots] if snapshots else None
    if incremental and (out_path is None or not snapshots):
        raise ValueError("incremental runs need out_path and the wanted snapshots")
    files: dict[str, set[tuple]] = {}
    if out_path is not None:                                # the versions from before anything is read
        for t in schemas:
            listed = list_files(spark, shard_glob(root, keywords[t], snapshots or "*", flat))
            for r in listed.select("path", "length", F.unix_micros("modified").alias("modified")).collect():
                files.setdefault(snapshot_label(r["path"]), set()).add(tuple(r))
    have = done_snapshots(spark, out_path) if out_path is not None else {}
    if incremental:
        snapshots = [s for s in snapshots if s not in have or have[s] != sorted(files.get(s, ()))]
        if not snapshots:
            return registry_output(spark, out_path)
    t, rejects = load_with_rejects(spark, root, schemas, keywords, dialect, archives, snapshots,
                                   optional=optional, flat=flat)
    if clean:
        t = {name: clean_registry(df) for name, df in t.items()}
    joined = company_partners(t["empre"], t["esta"], t["socios"], snapshot_col="snapshot",
                              hot_rows=hot_rows, **join_kw)
    if dimensions or with_segment:
        joined = categorise(joined, dimensions) if with_segment else resolve_codes(joined, dimensions)
    if out_path is None:
        return joined
    run = new_run()
    for df, path in ((joined, out_path.rstrip("/")), (rejects, out_path.rstrip("/") + "_rejects")):
        df.write.partitionBy("snapshot").parquet(f"{path}/run={run}")
    schema = joined.schema.json()
    rows = [(s, run, sorted(files.get(s, ())), schema) for s in (snapshots or sorted(files))]
    if not snapshots:                                       # what is no longer there
        rows += [(s, None, [], schema) for s in sorted(set(have) - set(files))]
    (spark.createDataFrame(rows, MANIFEST_SCHEMA.rsplit(",", 1)[0]).coalesce(1)
     .withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(out_path.rstrip("/") + "_manifest"))
    if not keep_superseded:
        drop_superseded(spark, out_path)
    return registry_output(spark, out_path)


def registry_rejects(spark: SparkSession, out_path: str) -> DataFrame:
    """Every rejected line and archive of the valid runs of an output."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in REJECT_COLUMNS])
    return _read_valid(spark, out_path.rstrip("/") + "_rejects", _valid(spark, out_path), schema)
