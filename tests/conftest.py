import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from regspark.session import build_session
    s = build_session("local[4]", app="regspark-tests", shuffle_partitions=8)
    # tests set their own checkpoint folder only when the session names none
    if not (s.sparkContext.getConf().get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL


def rows(df, cols=None):
    """Sorted list of tuples (order-insensitive comparison helper)."""
    src = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in src.collect()), key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
