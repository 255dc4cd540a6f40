"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from jobloom.plans.catalog import QUERIES
from tests.compare import differences, duck
from tests.test_operators import plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def no_cross_join_and_no_row_udf(found):
    shown = plan(found)
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown
    assert "BatchEvalPython" not in shown


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert differences(spark, SF, name, con, no_cross_join_and_no_row_udf) == []


def test_plan_without_twin(spark):
    no_cross_join_and_no_row_udf(QUERIES["page_parse"](spark, SF))


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
