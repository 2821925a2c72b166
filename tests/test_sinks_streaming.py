import os

from pyspark.sql import functions as F

from conftest import plan, rows
from regspark.schemas import EMPRE_COLUMNS, REGISTRY, string_schema
from regspark.sinks.reports import preview, schema_report
from regspark.sinks.writers import csv_to_parquet, export_csv, unique_names, write_parquet, write_shards
from regspark.sources.delimited import read_with_header
from regspark.streaming.incremental import ingest_new_shards


def _empre(spark):
    data = [(f"{i:08d}", f"EMP {i}", "2062", "49", "0,00", "01", None, "2023-05" if i % 2 else "2025-01")
            for i in range(20)]
    return spark.createDataFrame(data, string_schema(EMPRE_COLUMNS + ["snapshot"]))


def test_parquet_partitioned_roundtrip_prunes_and_pushes_down(spark, tmp_path):
    df = _empre(spark)
    path = write_parquet(df, str(tmp_path / "pq"))
    back = spark.read.parquet(path)
    assert rows(back, df.columns) == rows(df)
    q = back.where((F.col("snapshot") == "2023-05") & (F.col("cnpj_emp") == "00000003"))
    p = plan(q)
    assert "PartitionFilters: [isnotnull(snapshot" in p and "PushedFilters: [IsNotNull(cnpj_emp), EqualTo(cnpj_emp,00000003)]" in p
    assert q.count() == 1


def test_export_renames_duplicate_columns(spark, tmp_path):
    a = spark.createDataFrame([("BR", "US")], "pais string, x string").toDF("pais", "pais")
    assert unique_names(a).columns == ["pais", "pais_2"]
    path = export_csv(a, str(tmp_path / "out"))
    back = read_with_header(spark, path, REGISTRY.with_(sep=",", encoding="UTF-8"))
    assert back.columns == ["pais", "pais_2"] and back.first() == ("BR", "US")


def test_csv_to_parquet_reports_status_per_table(spark, tmp_path):
    src = str(tmp_path / "src")
    df = _empre(spark).withColumn("shard_name", F.lit("Empresas0"))
    write_shards(df, src)
    status = csv_to_parquet(spark, src, str(tmp_path / "out"),
                            {"empre": ("EMPRE", string_schema(EMPRE_COLUMNS)),
                             "socios": ("SOCIOS", string_schema(["a"]))})
    got = {r["table_name"]: (r["status"], r["n_rows"]) for r in status.collect()}
    assert got == {"empre": ("ok", 20), "socios": ("failed", None)}
    assert os.path.isdir(tmp_path / "out" / "empre" / "snapshot=2023-05")


def test_incremental_ingest_is_idempotent(spark, tmp_path):
    landing, sink, ckpt = (str(tmp_path / n) for n in ("landing", "sink", "ckpt"))
    df = _empre(spark).withColumn("shard_name", F.lit("Empresas0"))
    schema = string_schema(EMPRE_COLUMNS)
    glob = f"{landing}/*/*/*.csv"
    write_shards(df.where(F.col("snapshot") == "2023-05"), landing, mode="append")
    ingest_new_shards(spark, glob, schema, sink, ckpt)
    assert spark.read.parquet(sink).count() == 10
    write_shards(df.where(F.col("snapshot") == "2025-01"), landing, mode="append")
    ingest_new_shards(spark, glob, schema, sink, ckpt)
    ingest_new_shards(spark, glob, schema, sink, ckpt)  # nothing new: no duplicate rows
    back = spark.read.parquet(sink)
    assert back.count() == 20
    assert {r[0] for r in back.select("snapshot").distinct().collect()} == {"2023-05", "2025-01"}


def test_preview_and_schema_report(spark):
    df = _empre(spark)
    assert [r[0] for r in preview(df, 3, ["cnpj_emp"]).collect()] == ["00000000", "00000001", "00000002"]
    rep = schema_report({"empre": df})
    r = rep.where(F.col("column_name") == "ent_fed_resp").first()
    assert (r["position"], r["data_type"], r["n_rows"], r["n_non_null"]) == (7, "string", 20, 0)


def test_read_pages_then_links(spark, tmp_path):
    from regspark.functions.links import extract_links, resolve_link
    from regspark.sources.pages import read_pages
    d = tmp_path / "pages"
    d.mkdir()
    (d / "index.html").write_text('<a href="2023-05/">a</a>\n<a href="2025-01/">b</a><a href="../">up</a>')
    (d / "skip.txt").write_text('<a href="nope/">x</a>')
    links = extract_links(read_pages(spark, str(d)))
    hrefs = sorted(r["href"] for r in links.where(F.col("href").startswith("20")).collect())
    assert hrefs == ["2023-05/", "2025-01/"]
    base = "https://host/dados/"
    got = links.select(resolve_link(F.lit(base), "href").alias("u")).where(F.col("u").endswith("2025-01/"))
    assert got.first()["u"] == "https://host/dados/2025-01/"


def test_staging_lives_under_the_session_checkpoint_root(spark):
    from regspark.session import checkpoint_root, cut_lineage, staging_path
    root = checkpoint_root(spark)
    p1, p2 = staging_path(spark, "x"), staging_path(spark, "x")
    assert p1.startswith(root) and p2.startswith(root) and p1 != p2
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    cut = cut_lineage(df, name="t")
    assert sorted(r["v"] for r in cut.collect()) == [0, 2, 4, 6, 8]
    assert "Range" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_incremental_archive_ingest_is_idempotent(spark, tmp_path):
    import io
    import zipfile
    from regspark.streaming.incremental import ingest_new_archives

    def zbytes(text):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as zf:
            zf.writestr("x.csv", text)
        return buf.getvalue()

    landing = tmp_path / "landing"
    landing.mkdir()
    sink, ckpt = str(tmp_path / "sink"), str(tmp_path / "ckpt")
    schema = string_schema(["id", "v"])
    (landing / "A0.zip").write_bytes(zbytes('"1";"a"\n"2";"b"\n'))
    (landing / "Bad0.zip").write_bytes(b"not a zip")
    ingest_new_archives(spark, str(landing), schema, sink, ckpt)
    (landing / "A1.zip").write_bytes(zbytes('"3";"c"\n'))
    ingest_new_archives(spark, str(landing), schema, sink, ckpt)
    ingest_new_archives(spark, str(landing), schema, sink, ckpt)  # nothing new
    good = spark.read.parquet(f"{sink}/good")
    assert sorted(r["id"] for r in good.collect()) == ["1", "2", "3"]
    rejects = spark.read.parquet(f"{sink}/rejects")
    assert [r["archive"].split("/")[-1] for r in rejects.collect()] == ["Bad0.zip"]


def test_session_defaults_and_scale_conf(spark):
    from regspark.session import scale_conf
    assert spark.conf.get("spark.ui.enabled") == "false"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    big = scale_conf(100 * 2**40, 1000, 8)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 << 20)
    small = scale_conf(10 * 2**30, 4, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 64              # two waves of 32 cores
    mid = scale_conf(1 * 2**40, 100, 8)
    assert int(mid["spark.sql.shuffle.partitions"]) == 4096              # ~256 MB each


def test_incremental_ingest_in_small_batches(spark, tmp_path):
    landing, sink, ckpt = (str(tmp_path / n) for n in ("landing", "sink", "ckpt"))
    df = _empre(spark).withColumn("shard_name", F.concat(F.lit("Empresas"), (F.col("cnpj_emp") % 3).cast("string")))
    write_shards(df.repartition(6), landing)
    progress = ingest_new_shards(spark, f"{landing}/*/*/*.csv", string_schema(EMPRE_COLUMNS), sink, ckpt,
                                 max_files_per_trigger=1)
    back = spark.read.parquet(sink)
    assert back.count() == 20 and back.distinct().count() == 20
    assert progress.get("batchId", 0) >= 1  # availableNow ran several micro-batches
