"""Inputs that change between runs or cannot be read; row numbers, rule tables, quoted breaks."""

import csv
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from regspark.schemas import REGISTRY, string_schema

SCHEMA = string_schema(["id", "v"])


def _zip(path, members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, text in members.items():
            zf.writestr(name, text)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(buf.getvalue())
    return buf.getvalue()


# --- rows that follow their files ---------------------------------------------------------------

def test_followed_shards(spark, tmp_path):
    from regspark.sources.ledger import drop_superseded_runs, pending_files
    from regspark.streaming.incremental import follow_shards, followed_shards
    root, table = tmp_path / "in" / "2025-01", str(tmp_path / "table")
    root.mkdir(parents=True)
    glob = f"{tmp_path}/in/*/*.csv"
    have = lambda: rows(followed_shards(spark, table, SCHEMA), ["id", "v", "snapshot"])
    assert follow_shards(spark, glob, SCHEMA, table) == {} and have() == []
    (root / "A 0+é.csv").write_text('"1";"a"\n"1";"a"\n')
    (root / "B.csv").write_text('"2";"b"\n')
    assert follow_shards(spark, glob, SCHEMA, table) == {"new": 2}
    assert have() == [("1", "a", "2025-01")] * 2 + [("2", "b", "2025-01")]
    assert follow_shards(spark, glob, SCHEMA, table) == {"same": 2} and len(have()) == 3
    (root / "A 0+é.csv").write_text('"1";"repaired"\n')
    (root / "C.csv").write_text('"3";"c"\n')
    os.remove(root / "B.csv")
    assert {(r.path.rsplit("/", 1)[-1], r.change) for r in pending_files(spark, table, glob).collect()} == \
        {("A 0+é.csv", "changed"), ("B.csv", "removed"), ("C.csv", "new")}
    assert follow_shards(spark, glob, SCHEMA, table) == {"changed": 1, "removed": 1, "new": 1}
    assert have() == [("1", "repaired", "2025-01"), ("3", "c", "2025-01")]
    assert drop_superseded_runs(spark, table) == 2          # an old ledger and the rows of the first run
    assert have() == [("1", "repaired", "2025-01"), ("3", "c", "2025-01")]
    os.remove(root / "A 0+é.csv")
    os.remove(root / "C.csv")
    assert follow_shards(spark, glob, SCHEMA, table) == {"removed": 2} and have() == []


def test_a_run_that_dies_before_its_ledger_changes_nothing(spark, tmp_path):
    from regspark.sources.ledger import read_shard_files, read_synced, sync_files
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.csv").write_text('"1";"a"\n')
    glob, table = f"{tmp_path}/in/*.csv", str(tmp_path / "table")
    read = read_shard_files(spark, SCHEMA)
    sync_files(spark, glob, table, read)
    (tmp_path / "in" / "A.csv").write_text('"1";"new"\n')

    def dies(paths):
        read(paths).write.parquet(f"{table}/rows/run=99999999999999999999-dead")    # rows of a run without a ledger
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        sync_files(spark, glob, table, dies)
    assert [r.v for r in read_synced(spark, table, SCHEMA).collect()] == ["a"]
    sync_files(spark, glob, table, read)
    assert [r.v for r in read_synced(spark, table, SCHEMA).collect()] == ["new"]
    with pytest.raises(ValueError, match="more than 0"):
        (tmp_path / "in" / "B.csv").write_text('"2";"b"\n')
        sync_files(spark, glob, table, read, max_files=0)


# --- the job run again --------------------------------------------------------------------------

def test_job_sees_repaired_emptied_and_mended_files(spark, tmp_path):
    from regspark.plans.registry_job import done_snapshots, registry_output, registry_rejects, run_registry_job
    from test_registry_job import _line, _tables, _text
    root, out, both = tmp_path / "a", str(tmp_path / "out"), ["2023-05", "2025-01"]
    _text(root)
    good = (root / "2025-01" / "Empresas0.csv").read_bytes()
    (root / "2025-01" / "Empresas0.csv").write_bytes(good.split(b"\n")[0] + b"\n" + b'"broken";"line"\n')
    run = lambda **kw: run_registry_job(spark, str(root), out, **{"snapshots": both, "incremental": True, **kw})
    per = lambda df: {r["snapshot"]: r["count"] for r in df.groupBy("snapshot").count().collect()}
    assert per(run()) == {"2023-05": 5, "2025-01": 2}
    assert [(r.snapshot, r.source) for r in registry_rejects(spark, out).collect()] == [("2025-01", "Empresas0.csv")]
    # repaired under its old name
    (root / "2025-01" / "Empresas0.csv").write_bytes(good)
    assert per(run()) == {"2023-05": 5, "2025-01": 5}
    assert registry_rejects(spark, out).count() == 0
    # a rerun without rows leaves none
    row = _tables()["Estabelecimentos0.csv"][0]
    row[4] = "NOBODY"
    (root / "2025-01" / "Estabelecimentos0.csv").write_text(_line(row) + "\n")
    assert per(run()) == {"2023-05": 5}
    assert set(done_snapshots(spark, out)) == set(both) and per(run()) == {"2023-05": 5}
    # only the folders of valid runs are left, so a plain read gives the same rows
    assert spark.read.parquet(out).count() == 5
    # a run over all that is there forgets what is not
    import shutil
    shutil.move(root / "2023-05", tmp_path / "gone")
    _text(root, ["2025-01"])
    assert per(run_registry_job(spark, str(root), out)) == {"2025-01": 5}
    assert set(done_snapshots(spark, out)) == {"2025-01"}
    # one that dies before the manifest changes nothing
    joined = registry_output(spark, out)
    joined.drop("snapshot").withColumn("snapshot", F.lit("2025-01")).write.partitionBy("snapshot").parquet(f"{out}/run=9-dead")
    assert per(registry_output(spark, out)) == {"2025-01": 5}
    with pytest.raises(FileNotFoundError):
        registry_output(spark, str(tmp_path / "nothing"))


# --- archives ------------------------------------------------------------------------------------

def test_zip_source_reads_members_apart_and_rejects_whole_archives(spark, tmp_path):
    from regspark.sources.archives import read_archive_lines, read_archives
    many = {f"m{i}.csv": "".join(f'"{i}{j}";"é"\n' for j in range(50)).encode("latin-1") for i in range(6)}
    _zip(tmp_path / "z" / "Many.zip", many)
    data = bytearray(_zip(tmp_path / "z" / "Bad.zip", {"a.csv": b'"1";"x"\n', "b.csv": os.urandom(4000).hex().encode()}))
    at = data.index(b"b.csv") + 200
    data[at] ^= 0xFF                                        # the second member's data, not the directory
    (tmp_path / "z" / "Bad.zip").write_bytes(bytes(data))
    (tmp_path / "z" / "No.zip").write_bytes(b"no zip")
    lines = read_archive_lines(spark, str(tmp_path / "z"))
    assert {r[0].rsplit("/", 1)[-1] for r in lines.where("error is not null").select("archive").collect()} == {"Bad.zip", "No.zip"}
    good, bad = read_archives(spark, str(tmp_path / "z"), SCHEMA)
    assert good.count() == 300 and {r.v for r in good.collect()} == {"é"}
    assert sorted(r.archive.rsplit("/", 1)[-1] for r in bad.collect()) == ["Bad.zip", "No.zip"]
    from regspark.sources.zip_source import zip_lines
    files = [[f"file:{tmp_path}/z/Many.zip", 1]]
    assert zip_lines(spark, files, partitionBytes="100").rdd.getNumPartitions() == 6
    assert zip_lines(spark, files).rdd.getNumPartitions() == 1
    assert [r.member for r in zip_lines(spark, files, firstMemberOnly="true").select("member").distinct().collect()] == ["m0.csv"]
    assert zip_lines(spark, []).count() == 0


def test_archive_stream_takes_republished_and_removed_archives(spark, tmp_path):
    from regspark.streaming.incremental import ingest_new_archives, ingested_archives
    land, sink, ckpt = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "ckpt")
    _zip(land / "A.zip", {"x.csv": '"1";"a"\n'})
    _zip(land / "B.zip", {"x.csv": '"2";"b"\n'})
    whole = _zip(land / "C.zip", {"x.csv": '"3";"c"\n'})
    old = os.stat(land / "C.zip").st_mtime_ns - 10**12
    (land / "C.zip").write_bytes(whole[:30])
    ingest = lambda: ingest_new_archives(spark, str(land), SCHEMA, sink, ckpt)
    have = lambda: rows(ingested_archives(spark, sink, SCHEMA), ["id", "v"])
    ingest()
    assert have() == [("1", "a"), ("2", "b")]
    _zip(land / "A.zip", {"x.csv": '"1";"again"\n'})
    os.remove(land / "B.zip")
    (land / "C.zip").write_bytes(whole)
    os.utime(land / "C.zip", ns=(old, old))                 # moved into place with an older time
    ingest()
    assert have() == [("1", "again"), ("3", "c")]
    ingest()
    assert have() == [("1", "again"), ("3", "c")]
    (land / "A.zip").write_bytes(b"broken")
    ingest()
    assert have() == [("3", "c")]


# --- conversion, numbers, rules ------------------------------------------------------------------

def test_conversion_goes_on_per_file(spark, tmp_path):
    from regspark.sinks.writers import csv_to_parquet
    src = tmp_path / "in" / "2025-01"
    src.mkdir(parents=True)
    for i in range(5):
        (src / f"T{i}.csv").write_text(f'"{i}";"v"\n"bad line"\n')
    (src / "T5.csv.gz").write_bytes(b"not gzip at all")
    (src / "U0.csv.gz").write_bytes(b"not gzip at all")
    errors = []
    got = {r.table_name: r for r in csv_to_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"),
                                                   {"t": ("T", SCHEMA), "u": ("U0", SCHEMA), "w": ("W", SCHEMA)}, errors=errors).collect()}
    assert (got["t"].status, got["t"].n_rows) == ("partial", 5) and "T5.csv.gz" in got["t"].error
    assert (got["u"].status, got["u"].n_rows, got["w"].status) == ("failed", None, "failed")
    assert sorted((t, f.rsplit("/", 1)[-1]) for t, f, _ in errors) == [("t", "T5.csv.gz"), ("u", "U0.csv.gz")]
    assert spark.read.parquet(str(tmp_path / "out" / "t")).count() == 5


def test_indexed_union_is_gapless_in_file_order(spark, tmp_path):
    from regspark.operators.counts import indexed_union
    frames, want = [], []
    for k, folder in enumerate(("b", "a")):
        os.makedirs(tmp_path / folder)
        for name in ("z.csv", "y.csv", "empty.csv", "x.csv"):
            lines = [f'"{folder}{name}{i}";"{i}"' for i in range({"z.csv": 900, "y.csv": 3, "empty.csv": 0, "x.csv": 41}[name])]
            (tmp_path / folder / name).write_text("".join(x + "\n" for x in lines))
        frames.append(spark.read.schema(SCHEMA).options(**REGISTRY.read_options()).csv(str(tmp_path / folder)))
        want += [f"{folder}{n}{i}" for n, c in (("x.csv", 41), ("y.csv", 3), ("z.csv", 900)) for i in range(c)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = indexed_union(frames).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.id for r in sorted(got, key=lambda r: r["index"])] == want
    assert [r["index"] for r in sorted(got, key=lambda r: r["index"])] == list(range(len(want)))
    made = indexed_union([spark.range(10).repartition(3), spark.range(5)], "n").collect()
    assert sorted(r.n for r in made) == list(range(15)) and {r.n for r in made if r.n >= 10} == set(range(10, 15))
    assert indexed_union([spark.range(0)]).count() == 0


def test_rule_table_takes_the_longest_prefix(spark):
    from regspark.operators.dims import section_rules, segment_by_rules, segment_of
    rules = spark.createDataFrame([("01", "A"), ("0111", "A-deep"), ("0111", "B"), ("011130", "A-deeper"), (None, "x")], "prefix string, segment string")
    codes = spark.createDataFrame([("0111301",), ("0111399",), ("0119900",), ("01",), ("0",), ("99",), (None,)], "code string")
    got = {r.code: (r.segment, r.level) for r in segment_by_rules(codes, rules, "code", level_col="level").collect()}
    assert got == {"0111301": ("A-deeper", 6), "0111399": ("A-deep", 4), "0119900": ("A", 2), "01": ("A", 2),
                   "0": (None, None), "99": (None, None), None: (None, None)}
    default = rules.where("prefix is not null").union(spark.createDataFrame([("", "other")], "prefix string, segment string"))
    assert {r.segment for r in segment_by_rules(codes, default, "code").where("code in ('0', '99')").collect()} == {"other"}
    assert segment_by_rules(codes, rules.limit(0), "code").where("segment is null").count() == 7
    both = spark.range(100).select(F.format_string("%02d00000", "id").alias("code"))
    named = segment_by_rules(both, section_rules(spark), "code").withColumn("case_chain", segment_of("code"))
    assert named.where("not (segment <=> case_chain)").count() == 0


def test_code_lists_and_every_coded_column(spark):
    from regspark.operators.dims import lookup_list, resolve_codes
    dim = spark.createDataFrame([("1", "one"), ("2", "two")], "code string, description string")
    df = spark.createDataFrame([(1, "1,2,1"), (2, " 2 ,9"), (3, ""), (4, None), (5, "1,2,1")], "id int, l string")
    got = {r.id: r.d for r in lookup_list(df, dim, "l", "d").collect()}
    assert got == {1: ["one", "two", "one"], 2: ["two", None], 3: None, 4: None, 5: ["one", "two", "one"]}
    joined = spark.createDataFrame([("1", "2", "1", "1,2")], "pais string, pais_soc string, qual_rep string, cnae_2 string")
    out = resolve_codes(joined, {"Paises": dim, "Qualificacoes": dim, "Cnaes": dim}).first()
    assert (out.pais_desc, out.pais_soc_desc, out.qual_rep_desc, out.cnae_2_desc) == ("one", "two", "one", ["one", "two"])


@pytest.mark.parametrize("header", [False, True])
def test_quoted_breaks_are_read_by_many_tasks(spark, tmp_path, header):
    from regspark.sources.delimited import read_delimited, read_quoted_records
    values = ["plain", "two\nlines", 'quote " and\nbreak', "é;sep", "a\n\nb", "x" * 700 + "\n" + "y" * 700, "\n", "end\n"]
    want = []
    (tmp_path / "in").mkdir()
    for f in range(3):
        buf = io.StringIO()
        w = csv.writer(buf, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator="\n")
        if header:
            w.writerow(["i\nd", "v"])
        for i in range(200):
            row = (f"{f}-{i}", values[(i * 7 + f) % len(values)])
            w.writerow(row)
            want.append(row)
        (tmp_path / "in" / f"f{f}.csv").write_bytes(buf.getvalue().encode("latin-1"))
    dialect = REGISTRY.with_(header=header)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = rows(read_quoted_records(spark, str(tmp_path / "in"), SCHEMA, dialect))
        splits = spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits > 10 and got == sorted(want, key=repr)
    assert got == rows(read_delimited(spark, str(tmp_path / "in"), SCHEMA, dialect.with_(multi_line=True)))
