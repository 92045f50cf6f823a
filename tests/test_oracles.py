"""Every registered query against its SQL on the smallest tables."""

import oracle
import pytest

from gradewright.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert name in ORACLES, "every query has an oracle"
    assert oracle.compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["instance_id", "phase", "base_test", "status"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
