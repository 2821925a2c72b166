"""Python tasks must run on executors that do not have the package on their path."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_archive_tasks_run_from_a_foreign_working_directory(tmp_path):
    script = textwrap.dedent(f"""
        import io, sys, zipfile
        sys.path.insert(0, {ROOT!r})          # the driver alone sees the package
        from regspark.session import build_session
        from regspark.schemas import string_schema
        from regspark.sources.archives import read_archives
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as zf:
            zf.writestr("a.csv", '"1";"x"\\n"2";"y"\\n')
        open("A0.zip", "wb").write(buf.getvalue())
        spark = build_session("local[2]", shuffle_partitions=2)
        good, bad = read_archives(spark, ".", string_schema(["id", "v"]))
        print("ROWS", good.count(), bad.count())
        spark.stop()
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS 2 0" in out.stdout, out.stdout[-2000:] + out.stderr[-4000:]
