"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads whole driver tables (or text / archives Spark writes from them into
the shared staging folder) so its work grows with the data.  The matching DuckDB SQL
lives in :mod:`regspark.plans.oracles`; column names are aliased identically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.functions import clean as C
from regspark.functions import links as L
from regspark.functions import names as N
from regspark.functions.keys import padded_key, prefix_key
from regspark.operators.counts import indexed_union, row_counts, union_shards
from regspark.operators.dedup import dedup_effect, dedup_full_row
from regspark.operators.dims import (
    load_dimensions, lookup, lookup_list, section_rules, segment_counts, segment_level_counts, segment_of,
)
from regspark.operators.incremental_dedup import distinct_rows
from regspark.operators.joins import equi_join, name_join, prefix_left_join
from regspark.operators.manifest import (
    ingest_plan, manifest_available, manifest_missing, route_archives, wanted_manifest,
)
from regspark.plans.analogues import companies, establishments, partners, snapshot_of_size, table, table_versions
from regspark.plans.company_partners import company_partner_counts, company_partners
from regspark.plans.registry_job import clean_registry, registry_output, registry_rejects, run_registry_job
from regspark.plans.staging import (
    PART_SNAPSHOT_COL, label_shards, move_file, publish_shards, remove_files, stage_archives, stage_registry,
    stage_text, write_lines,
)
from regspark.schemas import COMMA_HEADERLESS, COMMA_WITH_HEADER, DIMENSION_NAMES, REGISTRY, SEMICOLON_WITH_HEADER
from regspark.session import cut_lineage, staging_path
from regspark.sinks.bucketed import read_bucketed_join, write_bucketed_pair
from regspark.sinks.reports import preview, schema_report
from regspark.sinks.writers import EXPORT_DIALECT, FILE_ERROR_SCHEMA, conversion_file_status, csv_to_parquet, export_csv, write_parquet, write_shards
from regspark.sources.archives import first_member_per_archive, read_archive_members, read_archives
from regspark.sources.delimited import (
    read_delimited, read_inferred, read_positional, read_quoted_records, read_split_malformed,
    read_with_header, rename_positional,
)
from regspark.sources.footers import footer_column_counts, footer_row_counts
from regspark.sources.shards import scan_shards, scan_snapshots
from regspark.operators.dims import load_dimension
from regspark.streaming.incremental import (
    follow_shards, followed_shards, ingest_new_archives, ingest_distinct_shards, ingest_new_shards, ingested_archives,
)

TEST_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

# right-side keys with more rows than this are salted in left joins (see operators.joins)
HOT_ROWS = 1_000_000


# --- joins ------------------------------------------------------------------------------

def q_company_partner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: dedup ×3 → name join → left join on the 7-char key prefix."""
    return company_partners(companies(spark, sf_dir), establishments(spark, sf_dir),
                            partners(spark, sf_dir), hot_rows=HOT_ROWS)


def q_joined_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count of the flagship result, computed without materialising pairs."""
    return company_partner_counts(companies(spark, sf_dir), establishments(spark, sf_dir),
                                  partners(spark, sf_dir)).select(F.col("n").alias("n_rows"))


def q_joined_counts_by_cnae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship rows and rows with a partner, per establishment activity code."""
    return company_partner_counts(companies(spark, sf_dir), establishments(spark, sf_dir),
                                  partners(spark, sf_dir), group_by=["cnae"])


def q_joined_counts_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship rows per snapshot and activity code, without materialising pairs."""
    return company_partner_counts(companies(spark, sf_dir, True), establishments(spark, sf_dir, True),
                                  partners(spark, sf_dir, True), group_by=["cnae"], snapshot_col="snapshot")


def q_padded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of 7 to 10 digits: short ones are padded to 8, long ones kept whole."""
    key = (F.col("o_orderkey") + F.pow(F.lit(10), 6 + F.col("o_orderkey") % 4)).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", padded_key(key, 8).alias("padded"),
                                                 prefix_key(key, 7, 8).alias("prefix"))


def q_join_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship over two snapshots in one run (snapshot equality in both joins)."""
    return company_partners(companies(spark, sf_dir, True), establishments(spark, sf_dir, True),
                            partners(spark, sf_dir, True), snapshot_col="snapshot",
                            hot_rows=HOT_ROWS)


# partners of a third of all suppliers share one key prefix; far above this threshold
SKEW_HOT_ROWS = 16
BUCKETS, BUCKET_HOT_ROWS = 16, 100


def q_skewed_partner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship with one partner-key prefix owning about a third of all partners.

    Suppliers of nations 0-7 all get key ``00000001``, so prefix ``0000000`` is hot and
    the left join takes the salted path (the result must not change).
    """
    s = table(spark, sf_dir, "supplier")
    skewed = s.select(F.when(F.col("s_nationkey") < 8, F.lit("00000001"))
                      .otherwise(padded_key("s_suppkey", 8)).alias("cnpj_soc"),
                      F.col("s_name").alias("nome_socio"))
    return company_partners(companies(spark, sf_dir), establishments(spark, sf_dir), skewed,
                            hot_rows=SKEW_HOT_ROWS)


def q_name_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_join(dedup_full_row(companies(spark, sf_dir)),
                     dedup_full_row(establishments(spark, sf_dir)))


def q_prefix_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer ⟕ orders on the 7-char prefix of 8-wide zero-padded keys (N:M rows)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return prefix_left_join(c, o, "c_custkey", "o_custkey", 7, width=8, hot_rows=HOT_ROWS)


def q_prefix_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches per customer of the prefix left join, pre-aggregated per prefix."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    per_prefix = (table(spark, sf_dir, "orders")
                  .groupBy(prefix_key("o_custkey", 7, 8).alias("__p"))
                  .agg(F.count("o_orderkey").alias("__n")))
    j = equi_join(c, per_prefix, prefix_key("c_custkey", 7, 8), F.col("__p"), "left")
    return j.select("c_custkey", F.coalesce("__n", F.lit(0)).alias("n"))


def q_prefix_left_join_int_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier ⟕ nation on the 1-char prefix of unpadded integer keys (implicit cast)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    per_prefix = n.groupBy(prefix_key("n_nationkey", 1).alias("__p")).agg(F.count(F.lit(1)).alias("__m"))
    j = equi_join(s, per_prefix, prefix_key("s_suppkey", 1), F.col("__p"), "left")
    return j.agg(F.sum(F.greatest(F.coalesce("__m", F.lit(0)), F.lit(1))).cast("bigint").alias("n"))


# --- dedup / counts / union / preview ----------------------------------------------------

def q_dedup_full_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of lineitem, every row present twice."""
    lines = table(spark, sf_dir, "lineitem")
    return dedup_full_row(union_shards([lines, lines]))


def q_dedup_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return dedup_effect(union_shards([lines, lines]))


def q_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts({t: table(spark, sf_dir, t) for t in TEST_TABLES})


def q_preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(table(spark, sf_dir, "orders"), 10, order_by=["o_orderkey"])


def q_schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_report({t: table(spark, sf_dir, t) for t in TEST_TABLES})


# --- links, predicates, names -------------------------------------------------------------

def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.extract_links(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def q_extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("page_id", "href")


def q_filter_prefix_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where(L.starts_with_any("href", ["/de", "/th", "/Th"])) \
        .select("page_id", "href")


def q_filter_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    return links.where(L.ends_with("href", "ion") & L.ends_with("href", "tion", negate=True)) \
        .select("page_id", "href")


def q_filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    return links.select("page_id", "href",
                        L.contains_keyword("href", "The").alias("has_kw"),
                        L.contains_keyword("href", "The", case_sensitive=False).alias("has_kw_ci")) \
        .where(F.col("has_kw_ci"))


def q_filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["Brand#1", "Brand#7", "Brand#13", "Brand#22"]
    return table(spark, sf_dir, "part").where(F.col("p_brand").isin(wanted)) \
        .select("p_partkey", "p_name", "p_brand")


def q_resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    return links.select("page_id", "href", L.resolve_link("url", "href").alias("resolved"))


def q_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", L.url_host("url").alias("host"), L.base_name("url", url=True).alias("base_name"),
                    L.stem("url", url=True).alias("stem"), L.extension("url", url=True).alias("extension"))


def q_archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive / output naming built column-wise from ``part`` (type, size as shard)."""
    p = table(spark, sf_dir, "part")
    snap = F.lit("2025-01/")
    shard = F.pmod(F.col("p_size"), F.lit(10))
    return p.select(
        "p_partkey",
        N.archive_name("p_type", shard).alias("archive_name"),
        N.local_archive_name("p_type", shard, snap).alias("local_name"),
        N.output_prefix(snap, "p_type").alias("out_prefix"),
        N.parquet_name(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".csv")))
        .alias("parquet_name"),
        N.strip_char("p_brand", "#").alias("brand_trim"),
    )


# --- ingest planning ------------------------------------------------------------------------

def _event_archives(events: DataFrame) -> DataFrame:
    """Archive names of events: ``<Type><user_id mod 10>.zip`` (shard = user hash bucket)."""
    return events.select(N.archive_name(N.capitalized("event_type"), F.pmod("user_id", F.lit(10)))
                         .alias("archive_name"))


def _manifest_inputs(spark: SparkSession, sf_dir: str):
    ev = table(spark, sf_dir, "events")
    wanted = wanted_manifest(ev.select(N.capitalized("event_type").alias("table_type")))
    # every event counts: an archive is listed or present by its number of events
    counted = _event_archives(ev).groupBy("archive_name").agg(F.count(F.lit(1)).alias("n_events"))
    listing = counted.where(F.col("n_events") % 2 == 1)
    present = counted.where(F.col("n_events") % 3 == 0)
    return wanted, listing, present


def q_wanted_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    from regspark.schemas import DIMENSION_NAMES
    return wanted_manifest(ev.select(N.capitalized("event_type").alias("table_type")),
                           dimensions=DIMENSION_NAMES)


def q_wanted_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted archives per wanted snapshot folder, with local names and URLs."""
    ev = table(spark, sf_dir, "events")
    return wanted_manifest(ev.select(N.capitalized("event_type").alias("table_type")),
                           snapshots=["2023-05/", "2025-01/"], base_url="https://host/dados/")


def q_manifest_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, listing, _ = _manifest_inputs(spark, sf_dir)
    return manifest_available(wanted, listing)


def q_manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, listing, _ = _manifest_inputs(spark, sf_dir)
    return manifest_missing(wanted, listing)


def q_ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, listing, present = _manifest_inputs(spark, sf_dir)
    return ingest_plan(wanted, listing, present)


def q_route_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_archives(q_wanted_manifest(spark, sf_dir)).select("archive_name", "route")


# --- dimensions, segments, cleaning --------------------------------------------------------

def q_lookup_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer codes resolved through two small dimensions, each read once.

    Region is first resolved into nation (a dimension of a dimension), then customer
    looks up both names in one bounded-broadcast join.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    region = table(spark, sf_dir, "region")
    nation = lookup(table(spark, sf_dir, "nation"), region, "n_regionkey", dim_code="r_regionkey",
                    columns={"r_name": "region_name"})
    out = lookup(c, nation, "c_nationkey", dim_code="n_nationkey",
                 columns={"n_name": "nation_name", "region_name": "region_name"})
    return out.select("c_custkey", "nation_name", "region_name")


def q_segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"])
    return segment_counts(j, ["r_name", "c_mktsegment"], distinct_col="c_nationkey")


def q_clean_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render order amounts / dates / text the registry way, then clean them back."""
    o = table(spark, sf_dir, "orders")
    raw = o.select("o_orderkey",
                   C.format_money("o_totalprice").alias("total_txt"),
                   C.format_compact_date("o_orderdate").alias("date_txt"),
                   F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("prio_txt"))
    return raw.select("o_orderkey",
                      C.parse_money("total_txt").alias("total"),
                      C.parse_compact_date("date_txt").alias("order_date"),
                      C.blank_to_null("prio_txt").alias("priority"))


# --- text scans (registry text written from the tables by Spark) --------------------------

def _part_schema(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "part").schema


def q_scan_headerless_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``;`` separated, headerless, latin1 shards read with an explicit schema."""
    root = stage_registry(spark, sf_dir, "headerless", tables=("part",))
    return read_delimited(spark, f"{root}/*/*", _part_schema(spark, sf_dir))


def q_scan_inferred_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless shards read the way the registry scripts do: inferred types, then toDF.

    Inference turns the key into an ``int`` (zero padding would be lost); kept for
    parity, while every other reader uses explicit schemas.
    """
    root = stage_registry(spark, sf_dir, "headerless", tables=("part",))
    names = [f.name for f in _part_schema(spark, sf_dir).fields]
    return read_inferred(spark, f"{root}/*/*", names)


def q_scan_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shard whose name contains the keyword, in any case, across snapshots."""
    root = stage_registry(spark, sf_dir, "shards")
    return scan_shards(spark, root, "part", _part_schema(spark, sf_dir), with_source=False)


def q_scan_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All snapshots in one scan; the snapshot label comes from the path."""
    root = stage_registry(spark, sf_dir, "snapshots")
    tables = scan_snapshots(spark, root, {"part": ("Part", _part_schema(spark, sf_dir))})
    return tables["part"].drop("source_file")


def q_scan_optional_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table absent from the folder yields an empty frame of its schema, not an error."""
    root = stage_registry(spark, sf_dir, "optional")
    schema = table(spark, sf_dir, "supplier").schema
    present = scan_shards(spark, root, "Supplier", schema, optional=True, with_source=False)
    absent = scan_shards(spark, root, "Socios", schema, optional=True, with_source=False)
    return union_shards([present, absent])


def q_union_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot read as its own frame, concatenated by column name."""
    root = stage_registry(spark, sf_dir, "union", tables=("part",))
    schema = _part_schema(spark, sf_dir)
    frames = [scan_shards(spark, root, "Part", schema, snapshot=s).drop("source_file")
              for s in ("2023-05", "2025-01")]
    return union_shards(frames)


def q_rename_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional ``_c0..`` columns renamed to the table's names, then typed."""
    root = stage_registry(spark, sf_dir, "positional", tables=("part",))
    schema = _part_schema(spark, sf_dir)
    raw = read_positional(spark, f"{root}/*/*", n_cols=len(schema.fields))
    named = rename_positional(raw, [f.name for f in schema.fields])
    return named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def q_scan_positional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless ``,`` text read as positional string columns (one partitioned scan)."""
    root = staging_path(spark, "comma")
    stage_text(table(spark, sf_dir, "customer"), "Customer", "c_nationkey", root, COMMA_HEADERLESS)
    return read_positional(spark, f"{root}/*/*", COMMA_HEADERLESS, n_cols=5)


def q_scan_latin1_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``;`` latin1 text with a header row and quoted line breaks (multiLine)."""
    docs = table(spark, sf_dir, "documents")
    dialect = SEMICOLON_WITH_HEADER.with_(multi_line=True)
    root = staging_path(spark, "latin1")
    # a multi-line file is one task: as many files as the data needs
    docs.write.option("maxRecordsPerFile", "5000").options(**dialect.write_options()).csv(root)
    return read_with_header(spark, root, dialect, schema=docs.schema)


def _malformed_customer(spark: SparkSession, sf_dir: str):
    """Customer as ``,`` text with a header row; BUILDING rows carry one field too many."""
    c = table(spark, sf_dir, "customer")
    fields = [F.concat(F.lit('"'), F.col(x).cast("string"), F.lit('"')) for x in c.columns]
    line = F.concat_ws(",", *fields)
    line = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(line, F.lit(',"extra"'))).otherwise(line)
    root = write_lines(c.select(line.alias("line")), staging_path(spark, "malformed"), ",".join(c.columns))
    return read_split_malformed(spark, root, c.schema, COMMA_WITH_HEADER)


def q_scan_skip_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _malformed_customer(spark, sf_dir)[0]


def q_bad_row_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _malformed_customer(spark, sf_dir)[1].agg(F.count(F.lit(1)).alias("n_rejected"))


def q_load_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coded dimension (nation) as headerless ``code;description`` text."""
    n = table(spark, sf_dir, "nation")
    root = staging_path(spark, "dimension")
    n.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("description")) \
        .write.options(**REGISTRY.write_options()).csv(root)
    return load_dimension(spark, root)


# --- sinks ------------------------------------------------------------------------------------

def q_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer with a snapshot label, written partitioned by snapshot and read back."""
    c = label_shards(table(spark, sf_dir, "customer"), "Customer", "c_nationkey").drop("shard_name")
    path = write_parquet(c, staging_path(spark, "parquet"))
    return spark.read.parquet(path).select(*c.columns)


def _convert(spark: SparkSession, sf_dir: str):
    root = stage_registry(spark, sf_dir, "convert-src")
    out = staging_path(spark, "convert-out")
    tables = {"part": ("Part", _part_schema(spark, sf_dir)),
              "supplier": ("Supplier", table(spark, sf_dir, "supplier").schema),
              "socios": ("Socios", table(spark, sf_dir, "supplier").schema)}
    return csv_to_parquet(spark, root, out, tables), out


def q_csv_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = _convert(spark, sf_dir)
    cols = [f.name for f in _part_schema(spark, sf_dir).fields] + ["snapshot"]
    return spark.read.parquet(f"{out}/part").select(*cols)


def q_conversion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, _ = _convert(spark, sf_dir)
    return status.select("table_name", "status", "n_rows")


def q_export_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship result exported as CSV with a header (distributed), read back."""
    joined = q_company_partner_join(spark, sf_dir)
    path = export_csv(joined, staging_path(spark, "export"))
    return read_with_header(spark, path, EXPORT_DIALECT, schema=joined.schema)


# --- archives ---------------------------------------------------------------------------------

_ARCHIVES: dict[tuple, str] = {}


def _archives(spark: SparkSession, sf_dir: str) -> str:
    """Part shards packed as zips (plus one truncated archive); written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, table_versions(spark, sf_dir, ["part"]))
    if key not in _ARCHIVES:
        root = stage_registry(spark, sf_dir, "zip-src", tables=("part",))
        _ARCHIVES[key] = stage_archives(spark, root)
    return _ARCHIVES[key]


def q_scan_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every CSV member of every readable archive (corrupt ones set aside)."""
    good, _ = read_archives(spark, _archives(spark, sf_dir), _part_schema(spark, sf_dir),
                            member_suffix=".csv")
    return good.drop("archive", "member")


def q_zip_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = read_archives(spark, _archives(spark, sf_dir), _part_schema(spark, sf_dir),
                           member_suffix=".csv")
    return bad.select(L.base_name("archive").alias("archive_name"),
                      F.regexp_extract("error", r"^(\w+)", 1).alias("error_class"))


def q_first_member_per_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read_archive_members(spark, _archives(spark, sf_dir))
    return first_member_per_archive(members).select(L.base_name("archive").alias("archive_name"), "member")


# --- streaming ----------------------------------------------------------------------------------

def q_incremental_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards landing in two batches, picked up by an availableNow stream, run three times."""
    part = table(spark, sf_dir, "part")
    landing, sink, ckpt = (staging_path(spark, n) for n in ("landing", "sink", "stream-ckpt"))
    labelled = label_shards(part, "Part", PART_SNAPSHOT_COL)
    for snap in ("2023-05", "2025-01"):
        write_shards(labelled.where(F.col("snapshot") == snap), landing, mode="append")
        ingest_new_shards(spark, f"{landing}/*/*/*.csv", part.schema, sink, ckpt)
    ingest_new_shards(spark, f"{landing}/*/*/*.csv", part.schema, sink, ckpt)  # nothing new
    return spark.read.parquet(sink).select(*part.columns, "snapshot")


def q_incremental_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives landing in two batches, unpacked once each by an availableNow stream."""
    part = table(spark, sf_dir, "part")
    landing = staging_path(spark, "zip-landing")
    sink, ckpt = staging_path(spark, "zip-sink"), staging_path(spark, "zip-ckpt")
    for snap in ("2023-05", "2025-01"):
        text = staging_path(spark, f"zip-text-{snap}")
        stage_text(part.where(snapshot_of_size(PART_SNAPSHOT_COL) == snap), "Part", PART_SNAPSHOT_COL, text)
        stage_archives(spark, text, landing)
        ingest_new_archives(spark, landing, part.schema, sink, ckpt)
    ingest_new_archives(spark, landing, part.schema, sink, ckpt)  # nothing new
    return spark.read.parquet(f"{sink}/good").select(*part.columns)


_REGISTRY_TEXT: dict[tuple, str] = {}


def _registry_text(spark: SparkSession, sf_dir: str, inputs: dict[str, DataFrame]) -> str:
    """The three registry-shaped tables as shards of snapshot 2025-01 (written once per session)."""
    key = (spark.sparkContext.applicationId, sf_dir, table_versions(spark, sf_dir, ["part", "supplier"]))
    if key not in _REGISTRY_TEXT:
        root = staging_path(spark, "registry-job")
        for label, df in inputs.items():
            shard = F.pmod(F.xxhash64(*df.columns), F.lit(10)).cast("string")
            write_shards(df.withColumn("snapshot", F.lit("2025-01"))
                         .withColumn("shard_name", F.concat(F.lit(label), shard)), root, mode="append")
        _REGISTRY_TEXT[key] = root
    return _REGISTRY_TEXT[key]


def q_registry_job_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole registry job from text shards found by keyword: scan → dedup → joins → Parquet.

    Companies, establishments and partners are staged as ``Empresas<i>`` /
    ``Estabelecimentos<i>`` / ``Socios<i>`` shards of snapshot 2025-01; the job finds them
    with the keywords ``EMPRE`` / ``ESTA`` / ``SOC`` (any case) and writes its result
    partitioned by snapshot.
    """
    inputs = {"Empresas": companies(spark, sf_dir), "Estabelecimentos": establishments(spark, sf_dir),
              "Socios": partners(spark, sf_dir)}
    root = _registry_text(spark, sf_dir, inputs)
    schemas = {name: df.schema for name, df in
               zip(("empre", "esta", "socios"), inputs.values())}
    out = run_registry_job(spark, root, staging_path(spark, "registry-job-out"), schemas=schemas,
                           hot_rows=HOT_ROWS)
    cols = [c for df in inputs.values() for c in df.columns] + ["snapshot"]
    return out.select(*cols)


# --- the job's guarantees and goal -------------------------------------------------------------

def _job_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Both snapshots of the three registry-shaped tables (every row in its own snapshot)."""
    return {"Empresas": companies(spark, sf_dir, True), "Estabelecimentos": establishments(spark, sf_dir, True),
            "Socios": partners(spark, sf_dir, True)}


def _job_schemas(inputs: dict[str, DataFrame]) -> dict:
    return {name: df.drop("snapshot").schema for name, df in zip(("empre", "esta", "socios"), inputs.values())}


def _job_text(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, dict]:
    inputs = _job_inputs(spark, sf_dir)
    root = staging_path(spark, name)
    for label, df in inputs.items():
        shard = F.pmod(F.xxhash64(*df.columns), F.lit(4)).cast("string")
        write_shards(df.withColumn("shard_name", F.concat(F.lit(label), shard))
                     .repartition("snapshot", "shard_name"), root, mode="append")
    return root, _job_schemas(inputs)


JOB_COLUMNS = ["cnpj_emp", "razao_emp", "cap_soc_emp", "cnpj", "fantasia", "cnae", "cnpj_soc", "nome_socio", "snapshot"]


def _job_archives(spark: SparkSession, sf_dir: str) -> str:
    """The job over flat zip archives, of which the last company shard also has a truncated copy."""
    root, schemas = _job_text(spark, sf_dir, "job-zip-src")
    zips = stage_archives(spark, root, corrupt_shards=("Empresas3",), readme_shards=())
    out = staging_path(spark, "job-zip-out")
    run_registry_job(spark, zips, out, schemas=schemas, archives=True, flat=True)
    return out


def q_registry_job_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job from zip archives in one folder; a truncated archive does not lose a snapshot."""
    return registry_output(spark, _job_archives(spark, sf_dir)).select(*JOB_COLUMNS)


def q_registry_job_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the job set aside: the truncated archives, and lines with a field too many."""
    out = _job_archives(spark, sf_dir)
    inputs = _job_inputs(spark, sf_dir)
    root, schemas = _job_text(spark, sf_dir, "job-bad-src")
    extra = inputs["Socios"].select("snapshot", F.concat_ws(";", "cnpj_soc", "nome_socio", F.lit("too many")).alias("line"))
    for snap in ("2023-05", "2025-01"):
        write_lines(extra.where(F.col("snapshot") == snap).select("line"), f"{root}/snapshot={snap}/shard_name=Socios9")
    bad = staging_path(spark, "job-bad-out")
    run_registry_job(spark, root, bad, schemas=schemas)
    both = registry_rejects(spark, out).unionByName(registry_rejects(spark, bad))
    return both.groupBy("table_name", "snapshot", F.regexp_extract("error", r"^(\w+)", 1).alias("error_class")) \
        .agg(F.count(F.lit(1)).alias("n"))


def q_registry_job_rerun_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot is run again: its rows are replaced, the other snapshot stays."""
    root, schemas = _job_text(spark, sf_dir, "job-rerun-src")
    out = staging_path(spark, "job-rerun-out")
    run_registry_job(spark, root, out, schemas=schemas)
    return run_registry_job(spark, root, out, schemas=schemas, snapshots=["2025-01"]).select(*JOB_COLUMNS)


def q_conversion_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and malformed lines of every converted text file, from one job per table."""
    root = stage_registry(spark, sf_dir, "convert-src")
    got = conversion_file_status(spark, root, {"part": ("Part", _part_schema(spark, sf_dir))})
    shard = F.regexp_extract("file", "shard_name=([^/]*)/", 1)
    return got.groupBy("table_name", "snapshot", shard.alias("shard_name"), "status") \
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"))


def q_segment_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section of a seven-digit activity code; the code is made from the whole key."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.format_string("%07d", F.col("p_partkey") * 7919 % 10000000).alias("code"))
    return p.select("p_partkey", "code", segment_of("code").alias("segment"))


def _raw_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part as raw registry text: padded text, decimal-comma amounts, compact dates."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit(" "), F.col("p_name"), F.lit("  ")).alias("razao_emp"),
                    padded_key("p_partkey", 8).alias("cnpj_emp"), C.format_money("p_retailprice").alias("cap_soc_emp"),
                    F.when(F.col("p_size") % 5 == 0, "0").otherwise(
                        C.format_compact_date(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size").cast("int")))).alias("dat_ini_at"),
                    F.when(F.col("p_type") == "PROMO", " ").otherwise(F.col("p_type")).alias("port_emp"))


def q_clean_registry_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_registry(_raw_registry(spark, sf_dir))


def q_categorised_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated goal: the job cleans, joins, describes codes, and companies are counted per
    snapshot, segment and activity description."""
    p = table(spark, sf_dir, "part")
    code = F.format_string("%02d00000", F.col("p_size") * 2 - 1)
    inputs = _job_inputs(spark, sf_dir)
    inputs["Estabelecimentos"] = (establishments(spark, sf_dir, True).drop("cnae")
                                  .join(p.select(padded_key("p_partkey", 8).alias("cnpj"), code.alias("cnae")), "cnpj")
                                  .select("cnpj", "fantasia", "cnae", "snapshot"))
    root = staging_path(spark, "job-goal-src")
    for label, df in inputs.items():
        write_shards(df.withColumn("shard_name", F.lit(label + "0")), root, mode="append")
    for name in DIMENSION_NAMES:
        dim = p.select(code.alias("code"), F.concat(F.lit(name + " "), F.col("p_size").cast("string")).alias("description")).distinct()
        write_shards(dim.withColumns({"snapshot": F.lit("2025-01"), "shard_name": F.lit(name)}), root, mode="append")
    dims = load_dimensions(spark, root)
    out = run_registry_job(spark, root, staging_path(spark, "job-goal-out"), schemas=_job_schemas(inputs), clean=True,
                           dimensions=dims, with_segment=True)
    return out.groupBy("snapshot", "segment", "cnae_desc").agg(F.count(F.lit(1)).alias("n_rows"),
                                                              F.count_distinct("cnpj_emp").alias("n_companies"))


def q_listing_to_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the links of the pages to the ingest plan: links that look like ``/xx.../`` words are
    listed archives; what the events want is matched with them."""
    links = _links(spark, sf_dir).where(L.starts_with_any("href", ["/", "http"]))
    names = links.select(F.concat(N.capitalized(F.regexp_extract("href", "([A-Za-z]+)[^A-Za-z]*$", 1)), F.lit("0.zip")).alias("archive_name"))
    wanted = wanted_manifest(names.select(F.regexp_replace("archive_name", "0[.]zip$", "").alias("table_type")))
    present = names.groupBy("archive_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return ingest_plan(wanted, names, present)


# --- inputs that change, or that cannot be read ------------------------------------------------

BOTH_SNAPSHOTS = ["2023-05", "2025-01"]


def q_changed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards whose rows follow their files: a broken one is repaired under its name, one comes
    late, one is removed between two runs; a third run finds nothing to do."""
    part = table(spark, sf_dir, "part")
    landing, held = staging_path(spark, "shard-landing"), staging_path(spark, "shard-table")
    labelled, shard = label_shards(part, "Part", PART_SNAPSHOT_COL), F.pmod(F.col(PART_SNAPSHOT_COL), F.lit(10))
    broken = F.when(shard == 3, F.lit(0.0)).otherwise(F.col("p_retailprice"))
    publish_shards(spark, labelled.where(shard != 5).withColumn("p_retailprice", broken), landing)
    follow_shards(spark, f"{landing}/*/*.csv", part.schema, held)
    publish_shards(spark, labelled.where(shard.isin(3, 5)), landing)
    remove_files(spark, f"{landing}/*/Part9.csv")
    for _ in range(2):
        follow_shards(spark, f"{landing}/*/*.csv", part.schema, held)
    return followed_shards(spark, held, part.schema).select(*part.columns, "snapshot")


def q_republished_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of archives: truncated ones are rejected, then replaced under their names by whole
    ones, which carry an older modification time; another is removed."""
    part = table(spark, sf_dir, "part")
    landing, sink, ckpt = (staging_path(spark, n) for n in ("zip-landing", "zip-sink", "zip-ckpt"))
    text = staging_path(spark, "zip-again")
    stage_text(part, "Part", PART_SNAPSHOT_COL, text)
    own = stage_archives(spark, text, landing, corrupt_shards=("Part7", "Part9"))
    for shard in ("Part7", "Part9"):
        move_file(spark, f"{own}/{shard}-2025-01.zip", f"{text}/{shard}.zip")
        move_file(spark, f"{own}/{shard}-2025-01-truncated.zip", f"{own}/{shard}-2025-01.zip")
    ingest_new_archives(spark, landing, part.schema, sink, ckpt)
    move_file(spark, f"{text}/Part9.zip", f"{own}/Part9-2025-01.zip")
    remove_files(spark, f"{own}/Part1-*.zip")
    for _ in range(2):
        ingest_new_archives(spark, landing, part.schema, sink, ckpt)
    return ingested_archives(spark, sink, part.schema).select(*part.columns)


def _job_files(spark: SparkSession, inputs: dict[str, DataFrame], root: str) -> None:
    """Job inputs as one file for each of four shards, dealt by the first column."""
    for label, df in inputs.items():
        shard = F.pmod(F.xxhash64(df.columns[0]), F.lit(4)).cast("string")
        publish_shards(spark, df.withColumn("shard_name", F.concat(F.lit(label), shard)), root)


def q_registry_job_repaired_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partner shards with broken names are repaired under their file names; the incremental run
    finds their versions changed and does the snapshots again."""
    inputs, root, out = _job_inputs(spark, sf_dir), staging_path(spark, "job-repair-src"), staging_path(spark, "job-repair-out")
    schemas = _job_schemas(inputs)
    _job_files(spark, {**inputs, "Socios": inputs["Socios"].withColumn("nome_socio", F.lit("broken"))}, root)
    run = lambda: run_registry_job(spark, root, out, schemas=schemas, snapshots=BOTH_SNAPSHOTS, incremental=True)
    run()
    _job_files(spark, {"Socios": inputs["Socios"]}, root)
    run()
    return run().select(*JOB_COLUMNS)


def q_registry_job_emptied_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot is run again after its establishments changed so that none joins: its old rows go."""
    inputs, root, out = _job_inputs(spark, sf_dir), staging_path(spark, "job-empty-src"), staging_path(spark, "job-empty-out")
    schemas = _job_schemas(inputs)
    _job_files(spark, inputs, root)
    run_registry_job(spark, root, out, schemas=schemas)
    nobody = inputs["Estabelecimentos"].where("snapshot = '2025-01'").withColumn("fantasia", F.lit("nobody"))
    _job_files(spark, {"Estabelecimentos": nobody}, root)
    return run_registry_job(spark, root, out, schemas=schemas, snapshots=["2025-01"]).select(*JOB_COLUMNS)


def q_registry_job_mended_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected lines before and after the file that held them was mended."""
    inputs, root, out = _job_inputs(spark, sf_dir), staging_path(spark, "job-mend-src"), staging_path(spark, "job-mend-out")
    schemas = _job_schemas(inputs)
    _job_files(spark, inputs, root)
    counts = []
    for phase in ("before", "after"):
        again = inputs["Socios"].withColumn("shard_name", F.lit("Socios9"))
        publish_shards(spark, again.withColumn("extra", F.lit("too many")) if phase == "before" else again, root)
        run_registry_job(spark, root, out, schemas=schemas, snapshots=BOTH_SNAPSHOTS, incremental=True)
        n = registry_rejects(spark, out).groupBy().agg(F.count(F.lit(1)).alias("n"))
        counts.append(cut_lineage(n.select(F.lit(phase).alias("phase"), "n"), spark, "rejects"))
    return counts[0].unionByName(counts[1])


def q_indexed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shard of every snapshot concatenated, rows numbered anew in (path, offset) order."""
    part, root = table(spark, sf_dir, "part"), staging_path(spark, "index-src")
    publish_shards(spark, label_shards(part, "Part", PART_SNAPSHOT_COL), root, order=["p_partkey"])
    frames = [read_delimited(spark, f"{root}/{snap}/*.csv", part.schema) for snap in BOTH_SNAPSHOTS]
    return indexed_union(frames).select("index", *part.columns)


def q_scan_quoted_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text as ``scan_latin1_csv``, its quoted line breaks found by quote parity instead
    of ``multiLine``, so that its files are split."""
    d = table(spark, sf_dir, "documents")
    dialect = SEMICOLON_WITH_HEADER.with_(multi_line=True)
    root = staging_path(spark, "quoted")
    d.write.options(**dialect.write_options()).csv(root)
    return read_quoted_records(spark, root, d.schema, dialect)


def q_conversion_unreadable_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a file that cannot be read (named as gzip, but it is not): the others are converted."""
    part, root = table(spark, sf_dir, "part"), staging_path(spark, "unreadable-src")
    labelled = label_shards(part, "Part", PART_SNAPSHOT_COL)
    publish_shards(spark, labelled.where("shard_name <> 'Part7'"), root)
    publish_shards(spark, labelled.where("shard_name = 'Part7'"), root, suffix=".csv.gz")
    errors: list = []
    out = staging_path(spark, "unreadable-out")
    status = csv_to_parquet(spark, root, out, {"part": ("Part", part.schema)}, errors=errors)
    failed = spark.createDataFrame(errors, FILE_ERROR_SCHEMA).groupBy("table_name").agg(F.count(F.lit(1)).alias("n_failed"))
    folder = F.regexp_extract("_metadata.file_path", "/([^/]*)/snapshot=", 1)
    stored = spark.read.parquet(f"{out}/part").groupBy(folder.alias("table_name")).agg(F.count(F.lit(1)).alias("n_stored"))
    return status.select("table_name", "status", "n_rows").join(failed, "table_name").join(stored, "table_name")


def q_code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of codes resolved by a dimension, in order; codes that it lacks are marked."""
    p = table(spark, sf_dir, "part")
    lists = p.select("p_partkey", F.concat_ws(",", F.col("p_size") % 25, F.col("p_size") * 7 % 30).alias("codes"))
    dim = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("description"))
    named = lookup_list(lists, dim, "codes", "names")
    return named.withColumn("names", F.array_join("names", "|", "?"))


def q_segment_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity codes by a rule table with two levels (sections, and three-digit exceptions made
    from the suppliers): rows per level that decided."""
    p = table(spark, sf_dir, "part").select(F.format_string("%07d", F.col("p_partkey") * 7919 % 10000000).alias("code"))
    deep = table(spark, sf_dir, "supplier").select(
        F.format_string("%03d", F.col("s_suppkey") * 37 % 1000).alias("prefix"), F.format_string("S%02d", F.col("s_nationkey")).alias("segment"))
    return segment_level_counts(p, section_rules(spark).unionByName(deep), "code")


def q_incremental_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all of lineitem, landing in two folders, deduplicated file by file against what earlier files held;
    both land once more under other names, which adds nothing."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    root, out, ckpt = (staging_path(spark, n) for n in ("distinct-src", "distinct", "distinct-ckpt"))
    for i in (1, 2):
        for flagged, status in ((F.col("l_returnflag") == "R", "returned"), (~F.col("l_returnflag").eqNullSafe("R"), "other")):
            lines.where(flagged).repartition(2).write.options(**REGISTRY.write_options()).csv(f"{root}/{status}-{i}")
            ingest_distinct_shards(spark, f"{root}/*/*.csv", lines.schema, out, ckpt, max_files_per_trigger=1)
    return distinct_rows(spark, out, lines.schema)


def q_bucketed_partner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix left join of ``prefix_left_join`` from stored buckets; prefixes with more than a hundred
    orders are hot and kept out of the buckets."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = write_bucketed_pair(c, o, prefix_key("c_custkey", 7, 8), prefix_key("o_custkey", 7, 8),
                               staging_path(spark, "bucketed"), BUCKETS, BUCKET_HOT_ROWS)
    return read_bucketed_join(spark, path, "left")


def q_footer_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts as ``row_counts``, from Parquet footers."""
    return footer_row_counts(spark, {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TEST_TABLES})


def q_footer_snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each snapshot of a written table, from the footers below its folders."""
    part = table(spark, sf_dir, "part")
    out = write_parquet(part.select("*", snapshot_of_size("p_size")), staging_path(spark, "by-snapshot"))
    return footer_row_counts(spark, {"part": out}, by="snapshot")


def q_footer_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and values of every column of every table, from Parquet footers where they can tell."""
    return footer_column_counts(spark, {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TEST_TABLES})


QUERIES = {
    "incremental_distinct": q_incremental_distinct,
    "bucketed_partner_join": q_bucketed_partner_join,
    "footer_row_counts": q_footer_row_counts,
    "footer_snapshot_counts": q_footer_snapshot_counts,
    "footer_column_counts": q_footer_column_counts,
    "changed_shards": q_changed_shards,
    "republished_archives": q_republished_archives,
    "registry_job_repaired_shard": q_registry_job_repaired_shard,
    "registry_job_emptied_snapshot": q_registry_job_emptied_snapshot,
    "registry_job_mended_rejects": q_registry_job_mended_rejects,
    "indexed_union": q_indexed_union,
    "scan_quoted_breaks": q_scan_quoted_breaks,
    "conversion_unreadable_file": q_conversion_unreadable_file,
    "code_lists": q_code_lists,
    "segment_levels": q_segment_levels,
    "registry_job_archives": q_registry_job_archives,
    "registry_job_rejects": q_registry_job_rejects,
    "registry_job_rerun_snapshot": q_registry_job_rerun_snapshot,
    "conversion_file_status": q_conversion_file_status,
    "segment_of_code": q_segment_of_code,
    "clean_registry_columns": q_clean_registry_columns,
    "categorised_companies": q_categorised_companies,
    "listing_to_plan": q_listing_to_plan,
    "company_partner_join": q_company_partner_join,
    "registry_job_csv": q_registry_job_csv,
    "joined_row_count": q_joined_row_count,
    "joined_counts_by_cnae": q_joined_counts_by_cnae,
    "joined_counts_by_snapshot": q_joined_counts_by_snapshot,
    "padded_keys": q_padded_keys,
    "join_by_snapshot": q_join_by_snapshot,
    "skewed_partner_join": q_skewed_partner_join,
    "name_inner_join": q_name_inner_join,
    "prefix_left_join": q_prefix_left_join,
    "prefix_match_counts": q_prefix_match_counts,
    "prefix_left_join_int_keys": q_prefix_left_join_int_keys,
    "dedup_full_row": q_dedup_full_row,
    "dedup_effect": q_dedup_effect,
    "row_counts": q_row_counts,
    "preview_rows": q_preview_rows,
    "schema_report": q_schema_report,
    "extract_links": q_extract_links,
    "filter_prefix_any": q_filter_prefix_any,
    "filter_suffix": q_filter_suffix,
    "filter_contains": q_filter_contains,
    "filter_in_list": q_filter_in_list,
    "resolve_links": q_resolve_links,
    "path_parts": q_path_parts,
    "archive_names": q_archive_names,
    "wanted_manifest": q_wanted_manifest,
    "wanted_by_snapshot": q_wanted_by_snapshot,
    "manifest_available": q_manifest_available,
    "manifest_missing": q_manifest_missing,
    "ingest_plan": q_ingest_plan,
    "route_archives": q_route_archives,
    "lookup_dimensions": q_lookup_dimensions,
    "segment_counts": q_segment_counts,
    "clean_fields": q_clean_fields,
    "scan_headerless_csv": q_scan_headerless_csv,
    "scan_inferred_csv": q_scan_inferred_csv,
    "scan_shards": q_scan_shards,
    "scan_snapshots": q_scan_snapshots,
    "scan_optional_input": q_scan_optional_input,
    "union_shards": q_union_shards,
    "rename_positional": q_rename_positional,
    "scan_positional_columns": q_scan_positional_columns,
    "scan_latin1_csv": q_scan_latin1_csv,
    "scan_skip_bad_rows": q_scan_skip_bad_rows,
    "bad_row_rejects": q_bad_row_rejects,
    "load_dimension": q_load_dimension,
    "parquet_roundtrip": q_parquet_roundtrip,
    "csv_to_parquet": q_csv_to_parquet,
    "conversion_status": q_conversion_status,
    "export_joined": q_export_joined,
    "scan_zip_archives": q_scan_zip_archives,
    "zip_rejects": q_zip_rejects,
    "first_member_per_archive": q_first_member_per_archive,
    "incremental_shards": q_incremental_shards,
    "incremental_archives": q_incremental_archives,
}
