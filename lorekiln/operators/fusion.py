"""Reciprocal-rank fusion, hybrid search and context assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions.text import token_estimate, trimmed
from lorekiln.operators.lexical import POOL, keyword_search
from lorekiln.operators.vectors import hash_search

K_RRF = 60


def rrf(lists: list[DataFrame], k: int = 8, k_rrf: int = K_RRF) -> DataFrame:
    """(query_id, id, score, rank) from ranked lists (query_id, id, rank), rank from 1.

    Every place of every list adds 1 / (k_rrf + rank), repeats of an id inside one list too. Ties keep the order of
    first sight, earlier lists before later ones.
    """
    merged = None
    for i, ranked in enumerate(lists):
        rows = ranked.select("query_id", "id", (1.0 / (F.lit(k_rrf) + F.col("rank"))).alias("gain"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("place")).alias("seen"))
        merged = rows if merged is None else merged.unionByName(rows)
    summed = merged.groupBy("query_id", "id").agg(F.sum("gain").alias("score"), F.min("seen").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "seen"))
    return summed.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def hybrid_search(docs: DataFrame, queries: DataFrame, id_column: str, columns: list[str], query_id: str, text: str, order: str, k: int = 8) -> DataFrame:
    """(query_id, id, score, rank): the best 30 by keywords and the best 30 by vectors, fused."""
    keyword = keyword_search(docs, queries, id_column, columns, query_id, text, order, POOL)
    vector = hash_search(docs, queries, id_column, columns[0], query_id, text, order, POOL)
    return rrf([keyword, vector], k)


def context_blocks(ranked: DataFrame, docs: DataFrame, max_tokens: int = 2_000) -> DataFrame:
    """(query_id, chunks_count, estimated_tokens, sources, context): each query's best chunks under a token budget.

    ``ranked`` is (query_id, id, rank) and, if known, score, ``docs`` (id, path, heading_path, content). The first block is always
    taken; blocks end at the first that would overflow. ``sources`` lists path, heading path and score of the blocks
    that were taken.
    """
    score = F.round("score", 4) if "score" in ranked.columns else F.lit(None).cast("double")
    heading = F.when(F.coalesce("heading_path", F.lit("")) == "", "").otherwise(F.concat(F.lit(" > "), "heading_path"))
    head = F.concat(F.lit("### ["), F.coalesce("path", F.lit("")), F.lit("]"), heading, F.lit("\n"))
    block = F.concat(head, F.coalesce("content", F.lit("")), F.lit("\n\n---\n\n"))
    rows = ranked.join(docs, "id").select("query_id", "rank", F.struct("path", "heading_path", score.alias("score")).alias("source"), block.alias("block")).withColumn("est", token_estimate(F.col("block")))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("total", F.sum("est").over(upto)).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    kept = kept.filter((F.col("nth") == 1) | (F.col("total") <= max_tokens))
    listed = F.sort_array(F.collect_list(F.struct("rank", "block", "source")))
    return kept.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("chunks_count"),
        F.sum("est").alias("estimated_tokens"),
        F.transform(listed, lambda s: s["source"]).alias("sources"),
        trimmed(F.array_join(F.transform(listed, lambda s: s["block"]), "")).alias("context"),
    )
