"""Queries with oracle SQL give the rows that DuckDB gives; the others run and have a stable schema."""

import pytest
from helpers import same_as_duckdb

from lorekiln.llm import oracle, queries

ORACLE = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same(spark, sf, duck, name):
    same_as_duckdb(spark, sf, duck, queries.queries()[name], ORACLE[name])


COLUMNS = {
    "p4_pieces": ["chunk_id", "file_id", "heading_path", "chunk_index", "piece", "content"],
    "p6_cleaned": ["doc_id", "text", "removed_words", "dropped"],
    "p7_mixture": ["recipe", "doc_id", "source", "n_tokens", "repeats"],
    "p7_shares": ["recipe", "source", "target_share", "target_tokens", "actual_tokens", "actual_share", "n_documents"],
    "p7_exact_shares": ["recipe", "source", "target_share", "target_tokens", "actual_tokens", "actual_share", "n_documents", "binding"],
    "p8_found": ["doc_id"],
}


def test_every_query_is_covered():
    assert set(queries.queries()) == set(ORACLE) | set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_runs(spark, sf, name):
    frame = queries.queries()[name](spark, sf)
    assert frame.columns == COLUMNS[name] and frame.count() > 0
