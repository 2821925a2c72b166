import io
import zipfile

import pytest

from conftest import plan, rows
from regspark.schemas import EMPRE_COLUMNS, REGISTRY, string_schema
from regspark.sources.archives import first_member_per_archive, read_archive_lines, read_archives
from regspark.sources.delimited import (
    read_headerless, read_inferred, read_positional, read_split_malformed, read_with_header,
)
from regspark.sources.shards import ci_glob, scan_shards

EMPRE_LINES = [
    '"01234567";"PADARIA SÃO JOÃO";"2062";"49";"1.234,50";"01";""',
    '"12345678";"A;B ""Q""";"2062";"49";"0,00";"05";""',
    '"12345678";"A;B ""Q""";"2062";"49";"0,00";"05";""',
]


def _write(path, lines, encoding="latin-1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))


@pytest.fixture()
def registry(tmp_path):
    """<root>/<YYYY-MM>/<Table><i>: two snapshots, mixed-case names, a missing table."""
    root = tmp_path / "reg"
    _write(root / "2023-05" / "Empresas0.csv", EMPRE_LINES[:1])
    _write(root / "2023-05" / "Empresas1.csv", EMPRE_LINES[1:])
    _write(root / "2025-01" / "K3241.K03200Y0.D50111.EMPRECSV", EMPRE_LINES[:2])
    _write(root / "2025-01" / "Socios0.csv", ['"01234567";"2";"FULANO"'])
    return str(root)


def test_latin1_quotes_and_separators(spark, registry):
    df = read_headerless(spark, f"{registry}/2023-05/Empresas0.csv", EMPRE_COLUMNS)
    r = df.first()
    assert r["cnpj_emp"] == "01234567"          # H1: zero padding kept (string schema)
    assert r["razao_emp"] == "PADARIA SÃO JOÃO"  # H6: latin1 decoded
    assert r["ent_fed_resp"] is None             # empty field -> null
    q = read_headerless(spark, f"{registry}/2023-05/Empresas1.csv", EMPRE_COLUMNS).first()
    assert q["razao_emp"] == 'A;B "Q"'            # H8: separator and doubled quotes inside a field


def test_inferred_reader_loses_padding_and_checks_arity(spark, registry):
    df = read_inferred(spark, f"{registry}/2023-05/Empresas0.csv", EMPRE_COLUMNS)
    assert df.first()["cnpj_emp"] == 1234567
    with pytest.raises(Exception):
        read_inferred(spark, f"{registry}/2023-05/Empresas0.csv", EMPRE_COLUMNS[:3])


def test_scan_shards_all_files_any_case_with_snapshot(spark, registry):
    df = scan_shards(spark, registry, "EMPRE", EMPRE_COLUMNS)
    per = {r["snapshot"]: r["count"] for r in df.groupBy("snapshot").count().collect()}
    assert per == {"2023-05": 3, "2025-01": 2}  # H9 (every shard) + H16 (any case) + H11
    assert ci_glob("Soc") == "[Ss][Oo][Cc]"
    first = scan_shards(spark, registry, "EMPRE", EMPRE_COLUMNS, first=True)
    assert {r["source_file"].split("/")[-1] for r in first.collect()} == {
        "Empresas0.csv", "K3241.K03200Y0.D50111.EMPRECSV"}


def test_missing_table_raises_or_is_empty(spark, registry):
    with pytest.raises(FileNotFoundError):
        scan_shards(spark, registry + "/2023-05/..", "Estabelecimentos", ["a"])
    empty = scan_shards(spark, registry, "Estabelecimentos", ["a", "b"], optional=True)
    assert empty.count() == 0 and empty.columns == ["a", "b", "snapshot", "source_file"]


def test_positional_and_header_readers(spark, tmp_path):
    _write(tmp_path / "c.csv", ['"a","1"', '"b","2"'])
    df = read_positional(spark, str(tmp_path / "c.csv"), REGISTRY.with_(sep=","))
    assert df.columns == ["_c0", "_c1"] and rows(df) == [("a", "1"), ("b", "2")]
    _write(tmp_path / "h.csv", ['"id";"txt"', '"1";"linha ⏎"'.replace("⏎", "um\ndois")])
    h = read_with_header(spark, str(tmp_path / "h.csv"), REGISTRY.with_(header=True, multi_line=True))
    assert h.columns == ["id", "txt"] and h.first()["txt"] == "linha um\ndois"  # H18


def test_malformed_lines_split_stably(spark, tmp_path):
    _write(tmp_path / "m.csv", ['"1";"a"', '"2";"b";"extra"', '"3"', '"4";"d"'])
    schema = string_schema(["id", "v"])
    good, bad = read_split_malformed(spark, str(tmp_path / "m.csv"), schema)
    # H17: the split does not depend on which columns are selected afterwards
    assert sorted(r[0] for r in good.select("id").collect()) == ["1", "4"]
    assert good.count() == 2 and bad.count() == 2


def _zip_bytes(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        for name, text in members:
            zf.writestr(name, text.encode("latin-1"))
    return buf.getvalue()


def test_zip_archives_members_and_rejects(spark, tmp_path):
    d = tmp_path / "zips"
    d.mkdir()
    (d / "Empresas0.zip").write_bytes(_zip_bytes([("K.EMPRECSV.csv", "\n".join(EMPRE_LINES[:2]))]))
    (d / "Empresas1.zip").write_bytes(_zip_bytes([("b.csv", EMPRE_LINES[2]), ("a.txt", "note")]))
    (d / "Bad9.zip").write_bytes(b"this is not a zip archive")
    good, bad = read_archives(spark, str(d), string_schema(EMPRE_COLUMNS), member_suffix=".csv")
    assert good.count() == 3
    assert "PADARIA SÃO JOÃO" in [r["razao_emp"] for r in good.collect()]
    assert [r["archive"].split("/")[-1] for r in bad.collect()] == ["Bad9.zip"]
    assert bad.first()["error"].startswith("BadZipFile")
    lines = read_archive_lines(spark, str(d))
    firsts = {r["archive"].split("/")[-1]: r["member"] for r in first_member_per_archive(lines).collect()}
    assert firsts == {"Empresas0.zip": "K.EMPRECSV.csv", "Empresas1.zip": "a.txt"}
    # the unzip is the one Python stage; parsing stays JVM-side (from_csv)
    # unpacked once, by the zip data source: nothing later runs Python
    assert "MapInPandas" not in plan(good) and "BatchEvalPython" not in plan(good)


def test_archives_larger_than_a_cell_are_read_whole(spark, tmp_path, monkeypatch):
    from regspark.sources import archives
    d = tmp_path / "large # ã"
    d.mkdir()
    text = "\n".join(EMPRE_LINES)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as zf:
        zf.writestr("b.csv", (text + "\n") * 50)
        zf.writestr("a.txt", "note")
    damaged = bytearray(buf.getvalue())
    damaged[200:264] = b"\x00" * 64
    (d / "Empresas0.zip").write_bytes(buf.getvalue())
    (d / "Empresas1.zip").write_bytes(_zip_bytes([("c.csv", text)]))
    (d / "Half9.zip").write_bytes(bytes(damaged))
    (d / "Bad9.zip").write_bytes(b"this is not a zip archive" * 200)

    def all_of():
        lines = [tuple(r) for r in read_archive_lines(spark, str(d)).collect()]
        members = [tuple(r) for r in archives.read_archive_members(spark, str(d)).collect()]
        return sorted(lines, key=repr), sorted(members, key=repr)
    want = all_of()
    monkeypatch.setattr(archives, "MAX_ARCHIVE_BYTES", (d / "Empresas1.zip").stat().st_size)
    assert all_of() == want
    assert sum(r[0].endswith("Empresas0.zip") and r[4] is None for r in want[0]) == 50 * len(EMPRE_LINES) + 1
    assert {r[0].split("/")[-1] for r in want[0] if r[4]} == {"Half9.zip", "Bad9.zip"}
    lines = read_archive_lines(spark, str(d))
    (d / "Empresas0.zip").unlink()
    with pytest.raises(Exception, match="Empresas0.zip"):    # an archive that no task can open is no reject
        lines.collect()


def test_zip_members_with_quoted_line_breaks(spark, tmp_path):
    d = tmp_path / "mz"
    d.mkdir()
    text = '"1";"linha um\ndois";"x ""q"""\n"2";"simples";""\n'
    (d / "Docs0.zip").write_bytes(_zip_bytes([("docs.csv", text)]))
    schema = string_schema(["id", "txt", "extra"])
    good, _ = read_archives(spark, str(d), schema, REGISTRY.with_(multi_line=True))
    got = sorted((r["id"], r["txt"], r["extra"]) for r in good.collect())
    assert got == [("1", "linha um\ndois", 'x "q"'), ("2", "simples", None)]
    flat, _ = read_archives(spark, str(d), schema)  # physical lines: the record splits
    assert flat.count() == 3


def test_archive_failing_midway_is_rejected_whole(spark, tmp_path):
    d = tmp_path / "half"
    d.mkdir()
    big = "\n".join(f'"{i:08d}";"NOME {i}"' for i in range(20000))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("a.csv", big)
        zf.writestr("b.csv", big)
    data = bytearray(buf.getvalue())
    # damage the middle of the second member's compressed stream, keep the directory intact
    info = zipfile.ZipFile(io.BytesIO(bytes(data))).getinfo("b.csv")
    mid = info.header_offset + 60 + info.compress_size // 2
    data[mid:mid + 64] = b"\x00" * 64
    (d / "Half0.zip").write_bytes(bytes(data))
    (d / "Good0.zip").write_bytes(_zip_bytes([("g.csv", '"1";"x"')]))
    good, bad = read_archives(spark, str(d), string_schema(["id", "nome"]))
    assert [r["archive"].split("/")[-1] for r in bad.collect()] == ["Half0.zip"]
    assert {r["archive"].split("/")[-1] for r in good.collect()} == {"Good0.zip"}
