"""Plan audits: what every registered query must (not) compile to."""

import pytest

import __spark_entry__ as E
from regspark.plans.catalog import QUERIES
from conftest import plan

PYTHON_NODES = ("MapInPandas", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                "PythonMapInArrow")
# queries that unpack or pack zip archives
ARCHIVE_QUERIES = {"scan_zip_archives", "zip_rejects", "first_member_per_archive", "incremental_archives",
                   "registry_job_archives", "registry_job_rejects", "republished_archives"}


@pytest.fixture
def inner_plans(monkeypatch):
    """Plans of everything that is written while a query is built."""
    from pyspark.sql.readwriter import DataFrameWriter
    seen = []
    for name in ("parquet", "csv", "save"):
        original = getattr(DataFrameWriter, name)
        monkeypatch.setattr(DataFrameWriter, name, lambda self, *a, _f=original, **k: (seen.append(plan(self._df)), _f(self, *a, **k))[1])
    return seen


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_and_python_only_for_archives(spark, sf_dir, name, inner_plans):
    inner_plans.append(plan(E.queries()[name](spark, sf_dir)))
    for p in inner_plans:
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
        if name not in ARCHIVE_QUERIES:
            assert not any(n in p for n in PYTHON_NODES), p
    if name in ("registry_job_csv", "export_joined", "csv_to_parquet"):
        assert any("FileScan" in p and len(p.splitlines()) > 3 for p in inner_plans[:-1])


def test_flagship_prunes_columns_and_pushes_filters(spark, sf_dir):
    p = plan(E.queries()["company_partner_join"](spark, sf_dir))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_retailprice:double>" in p
    members = plan(E.queries()["filter_in_list"](spark, sf_dir))
    assert "PushedFilters: [In(p_brand" in members and "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string>" in members
    # the partner-prefix join is an equi-join keyed on the prefix expression
    assert "substring(" in p and ("SortMergeJoin" in p or "BroadcastHashJoin" in p or "ShuffledHashJoin" in p)


def test_pair_free_counts_never_join_partners_row_by_row(spark, sf_dir):
    p = plan(E.queries()["joined_row_count"](spark, sf_dir))
    # partners reach the join only as one aggregated row per prefix
    assert p.count("HashAggregate") >= 6 and "Generate" not in p


def test_row_numbers_and_quoted_records_need_no_single_task(spark, sf_dir, inner_plans):
    for name in ("indexed_union", "scan_quoted_breaks"):
        inner_plans.append(plan(E.queries()[name](spark, sf_dir)))
    assert not any("SinglePartition" in p for p in inner_plans)
