"""Every query of the catalogue against its SQL in DuckDB, or run for its rows."""

import pytest

from quillspark.plans import catalogue
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).limit(3).collect()


def test_top_k_is_no_full_sort(spark, sf_dir):
    plan = catalogue.dense_topk(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_scan_reads_needed_columns_and_pushes_the_workspace(spark, sf_dir):
    plan = catalogue.filter_doctype(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src0)" in plan and "EqualTo(lang,fr)" in plan
