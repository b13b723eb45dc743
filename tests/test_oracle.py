"""Every report against its SQL twin, and the driver's entry points."""

import pytest

import __spark_entry__
from checks.compare import difference, oracle_connection
from checks.registry import REPORTS, queries


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report_equals_sql(spark, sf_dir, connection, name):
    wrong, _ = difference(spark, connection, name, sf_dir)
    assert wrong is None


def test_entry_points():
    assert set(REPORTS) <= set(__spark_entry__.queries())
    assert set(REPORTS) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_has_rows(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns[0] == "lane"
    assert frame.count() == 241


def test_every_rule_has_rows(spark):
    """A report over rules proves nothing about a rule that no row reaches."""
    reports = queries()
    reached = lambda name, column: {r[0] for r in reports[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()}
    assert reached("smart_revenue", "revenue_rule") == {1, 2, 3, 4, 5}
    assert reached("smart_cost_duplicate_test", "cost_rule") == {"1", "2", "3a", "3b", "4", "5"}
    assert reached("ftl_structures", "structure") == {"direct", "multidrop", "multistop", "other"}
