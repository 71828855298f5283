"""Every registered query against its SQL twin on the smallest test data."""

import os

import pytest
from compare import differences, duck

import __spark_entry__ as entry_points
from engram.catalog.queries import QUERIES
from engram.catalog.twins import TWINS

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_only_known_queries_lack_a_twin():
    assert set(QUERIES) == set(TWINS)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_twin(spark, con, name):
    twin = entry_points.oracle_sql().get(name)
    found = differences(spark, con, SF_DIR, name, entry_points.queries()[name], twin)
    if name == "trigram_search":  # the smallest data may have no match at all
        found = [d for d in found if d != "no rows"]
    assert found == []


def test_comparison_notices_differences(spark, con):
    query = entry_points.queries()["filter_source"]
    twin = entry_points.oracle_sql()["filter_source"]
    assert not differences(spark, con, SF_DIR, "filter_source", query, twin)
    for wrong in (
        f"SELECT id + 1 AS id, source FROM ({twin})",
        f"SELECT * FROM ({twin}) LIMIT 1",
        f"SELECT id, source AS other FROM ({twin})",
        f"SELECT id::INTEGER AS id, source FROM ({twin})",
    ):
        assert differences(spark, con, SF_DIR, "filter_source", query, wrong)
