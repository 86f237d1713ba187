import __spark_entry__ as entry
import oracle
import pytest
from paths import SMALL, TINY

from lakewright.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert oracle.compare(catalog.queries()[name](spark, TINY), oracle.connect(TINY), catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["f6_hybrid_search", "e3_chunks", "c16_as_of"])
def test_headline_queries_at_the_next_scale(spark, name):
    assert oracle.compare(catalog.queries()[name](spark, SMALL), oracle.connect(SMALL), catalog.oracle_sql()[name]) == ""


def test_entry(spark):
    found = entry.entry(spark).groupBy("q").count().collect()
    assert len(found) >= 10 and all(0 < r["count"] <= 6 for r in found)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
