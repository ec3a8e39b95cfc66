"""Every registered query against its SQL on DuckDB, on whole tables."""

import pytest

from catalog.registry import ORACLE, QUERIES
from tools.check_catalog import compare


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    verdict, rows = compare(spark, duck, name, sf_dir)
    assert verdict == "ok"
    assert rows > 0


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def test_entry_point(spark):
    import __spark_entry__ as entry_point

    assert entry_point.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLE) <= set(entry_point.oracle_sql())
