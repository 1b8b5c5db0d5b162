"""Every registered query that has SQL gives the rows that DuckDB gives."""

import pytest

from attestlake.plans import registry
from tests.compare import difference

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert difference(spark, name, registry.queries()[name], SQL[name], SF) is None


def test_sql_only_for_queries():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0
