"""Every core query with oracle SQL gives the rows that DuckDB gives on the same tables."""

import pytest
from helpers import same_as_duckdb

from lorekiln.plans import registry

ORACLE = registry.oracle_sql()


def test_names_match():
    assert set(ORACLE) <= set(registry.queries())
    assert set(registry.queries()) - set(ORACLE) == {"lineage_tree", "chunk_notes"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same(spark, sf, duck, name):
    same_as_duckdb(spark, sf, duck, registry.queries()[name], ORACLE[name])


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
