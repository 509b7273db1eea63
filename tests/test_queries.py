"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import checks
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(checks.SQL))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, checks.QUERIES[name], checks.SQL[name]) == ""


def test_every_query_has_a_twin():
    assert set(checks.QUERIES) == set(checks.SQL)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["scene_id", "r", "c", "b08", "b04", "b03", "b02"]
    assert set(checks.QUERIES) <= set(entry.queries()) and set(checks.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
