"""The end-to-end registry job on full-width registry files, from text and from zips."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from regspark.plans.registry_job import done_snapshots, registry_rejects, run_registry_job, segment_report
from regspark.schemas import EMPRE_COLUMNS, ESTA_COLUMNS, SOCIOS_COLUMNS


def _line(values):
    return ";".join(f'"{v}"' for v in values)


def _tables():
    empre = [["00000001", "ALFA", "2062", "49", "1.000,00", "01", ""],
             ["00000001", "ALFA", "2062", "49", "1.000,00", "01", ""],   # duplicate
             ["00000002", "BETA", "2062", "49", "0,00", "05", ""]]
    esta = []
    for cnpj, name in [("12345670", "ALFA"), ("12345678", "BETA"), ("55555550", "BETA")]:
        row = ["x"] * len(ESTA_COLUMNS)
        row[0], row[4], row[9] = cnpj, name, "105"
        esta.append(row)
    socios = []
    for cnpj, nome in [("1234567A", "P1"), ("1234567B", "P2")]:
        row = ["y"] * len(SOCIOS_COLUMNS)
        row[0], row[2], row[6] = cnpj, nome, "249"
        socios.append(row)
    assert len(empre[0]) == len(EMPRE_COLUMNS)
    return {"Empresas0.csv": empre, "Estabelecimentos0.csv": esta, "K.SOCIOCSV": socios}


def _write_text(root):
    for snap in ("2023-05", "2025-01"):
        for name, rows in _tables().items():
            p = root / snap / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(("\n".join(_line(r) for r in rows) + "\n").encode("latin-1"))


def test_registry_job_from_text_and_zip(spark, tmp_path):
    text_root = tmp_path / "text"
    _write_text(text_root)
    out = run_registry_job(spark, str(text_root), str(tmp_path / "out"))
    per = {r["snapshot"]: r["count"] for r in out.groupBy("snapshot").count().collect()}
    # ALFA: 1 x 1 x 2 partners; BETA: 1 x (12345678 -> 2 partners, 55555550 -> none)
    assert per == {"2023-05": 5, "2025-01": 5}
    assert "pais_soc" in out.columns and len(out.columns) == 7 + 30 + 11 + 1  # + snapshot
    assert out.where(F.col("cnpj_soc").isNull()).count() == 2

    zip_root = tmp_path / "zips"
    for snap in ("2023-05", "2025-01"):
        for name, rows in _tables().items():
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                zf.writestr(name, "\n".join(_line(r) for r in rows).encode("latin-1"))
            p = zip_root / snap / (name.replace(".csv", "") + ".zip")
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(buf.getvalue())
    from_zip = run_registry_job(spark, str(zip_root), archives=True)
    assert sorted(map(tuple, from_zip.select(*out.columns).collect())) == \
        sorted(map(tuple, out.select(*out.columns).collect()))


def test_registry_job_incremental_by_snapshot(spark, tmp_path):
    text_root = tmp_path / "text"
    _write_text(text_root)
    out = str(tmp_path / "inc")
    first = run_registry_job(spark, str(text_root), out, snapshots=["2023-05/"], incremental=True)
    assert {r[0] for r in first.select("snapshot").distinct().collect()} == {"2023-05"}
    both = run_registry_job(spark, str(text_root), out, snapshots=["2023-05/", "2025-01/"],
                            incremental=True)
    per = {r["snapshot"]: r["count"] for r in both.groupBy("snapshot").count().collect()}
    assert per == {"2023-05": 5, "2025-01": 5}
    again = run_registry_job(spark, str(text_root), out, snapshots=["2023-05/", "2025-01/"],
                             incremental=True)
    assert again.count() == 10  # nothing new: nothing appended


def _text(root, snapshots=("2023-05", "2025-01"), tables=None):
    for snap in snapshots:
        for name, rows in _tables().items():
            if tables is None or name in tables:
                p = root / snap / name
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_bytes(("\n".join(_line(r) for r in rows) + "\n").encode("latin-1"))


def test_missing_snapshot_or_table_raises_unless_optional(spark, tmp_path):
    _text(tmp_path / "a", ["2023-05"])
    _text(tmp_path / "a", ["2025-01"], ["Empresas0.csv", "Estabelecimentos0.csv"])
    with pytest.raises(FileNotFoundError, match="socios in 2025-01"):
        run_registry_job(spark, str(tmp_path / "a"))
    with pytest.raises(FileNotFoundError, match="2099-01"):
        run_registry_job(spark, str(tmp_path / "a"), snapshots=["2023-05", "2099-01"])
    out = run_registry_job(spark, str(tmp_path / "a"), optional=["socios"])
    assert {r["snapshot"]: r["count"] for r in out.groupBy("snapshot").count().collect()} == {"2023-05": 5, "2025-01": 3}


def test_rejected_lines_and_archives_are_kept(spark, tmp_path):
    _text(tmp_path / "a")
    (tmp_path / "a" / "2025-01" / "Socios1.csv").write_text('"1";"2"\n' + _line(["z"] * 12) + "\n")
    out = str(tmp_path / "out")
    assert run_registry_job(spark, str(tmp_path / "a"), out).count() == 10
    got = [(r.table_name, r.snapshot, r.source, r.error) for r in registry_rejects(spark, out).collect()]
    assert got == [("socios", "2025-01", "Socios1.csv", "MalformedLine")] * 2

    zips = tmp_path / "zips"
    zips.mkdir()
    for snap in ("2023-05", "2025-01"):
        for name, rows in _tables().items():
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                zf.writestr(name, "\n".join(_line(r) for r in rows).encode("latin-1"))
            (zips / f"{name.split('.csv')[0]}-{snap}.zip").write_bytes(buf.getvalue())
    (zips / "Empresas7-2025-01.zip").write_bytes(buf.getvalue()[:40])
    out = str(tmp_path / "zip-out")
    per = run_registry_job(spark, str(zips), out, archives=True, flat=True).groupBy("snapshot").count().collect()
    assert {r["snapshot"]: r["count"] for r in per} == {"2023-05": 5, "2025-01": 5}
    assert [(r.table_name, r.snapshot, r.source) for r in registry_rejects(spark, out).collect()] == \
        [("empre", "2025-01", "Empresas7-2025-01.zip")]


def test_rerun_keeps_other_snapshots_and_late_shards_are_picked_up(spark, tmp_path):
    root, out = tmp_path / "a", str(tmp_path / "out")
    _text(root)
    run_registry_job(spark, str(root), out)
    again = run_registry_job(spark, str(root), out, snapshots=["2025-01"])
    assert {r["snapshot"]: r["count"] for r in again.groupBy("snapshot").count().collect()} == {"2023-05": 5, "2025-01": 5}
    both = ["2023-05", "2025-01"]
    assert done_snapshots(spark, out).keys() == set(both)
    (root / "2025-01" / "Socios2.csv").write_text(_line(["12345679"] + ["late"] * 10) + "\n")
    late = run_registry_job(spark, str(root), out, snapshots=both, incremental=True)
    # one more partner for both establishments with prefix 1234567
    assert {r["snapshot"]: r["count"] for r in late.groupBy("snapshot").count().collect()} == {"2023-05": 5, "2025-01": 7}
    assert run_registry_job(spark, str(root), out, snapshots=both, incremental=True).count() == 12


def test_clean_job_with_segments(spark, tmp_path):
    _text(tmp_path / "a")
    out = run_registry_job(spark, str(tmp_path / "a"), clean=True, with_segment=True)
    row = out.where("razao_emp = 'ALFA'").first()
    assert str(row.cap_soc_emp) == "1000.00" and row.dat_ini_at is None and row.segment is None
    report = segment_report(out).collect()
    assert sorted((r.snapshot, r.n_rows, r.n_companies) for r in report) == [("2023-05", 5, 2), ("2025-01", 5, 2)]
