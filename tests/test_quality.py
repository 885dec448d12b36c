"""Metrics by hand."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lorekiln.operators import evaluation, vectors


def frames(spark, retrieved, truth):
    r = spark.createDataFrame([(q, i, n) for q, ids in retrieved.items() for n, i in enumerate(ids, 1)], "query_id string, id string, rank int")
    t = spark.createDataFrame([(q, i) for q, ids in truth.items() for i in ids], "query_id string, id string")
    return r, t, spark.createDataFrame([(q,) for q in {*retrieved, *truth}], "query_id string")


def test_ranking(spark):
    rows = evaluation.ranking_metrics(*frames(spark, {"a": ["x", " Y", "y", "z"], "b": ["x"], "c": ["q"]}, {"a": ["y", "w"], "b": ["n"], "d": ["k"]}))
    got = {r["query_id"]: r.asDict() for r in rows.collect()}
    assert (got["a"]["hit_rate_1"], got["a"]["hit_rate_3"], got["a"]["recall_3"], got["a"]["mrr"]) == (0.0, 1.0, 1.0, 0.5)
    assert got["a"]["ndcg_5"] == pytest.approx((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3)))
    assert got["b"]["mrr"] == got["b"]["ndcg_5"] == 0.0 and got["d"]["recall_10"] == 0.0
    assert all(v == 1.0 for k, v in got["c"].items() if k != "query_id")


def test_sets(spark):
    rows = evaluation.set_metrics(*frames(spark, {"a": ["x", "y", "y"], "c": ["q"], "e": []}, {"a": ["Y", "z"], "d": ["k"]}))
    got = {r["query_id"]: tuple(r)[1:] for r in rows.collect()}
    assert got["a"] == (0.5, 0.5, 0.5) and got["c"] == (0.0, 1.0, 0.0) and got["d"] == (0.0, 0.0, 0.0) and got["e"] == (1.0, 1.0, 1.0)


def test_latency_uses_nearest_rank(spark):
    values = [5.0, 1.0, 1.0, 9.25, 3.0, None]
    row = evaluation.latency_stats(spark.createDataFrame([("g", v) for v in values], "k string, v double"), "k", "v").first()
    ordered = sorted(v for v in values if v is not None)
    assert (row["n"], row["min"], row["max"], row["mean"]) == (5, 1.0, 9.25, 3.85)
    assert [row[f"p{p}"] for p in (50, 95, 99)] == [ordered[min(4, int(p / 100 * 5))] for p in (50, 95, 99)]


def test_cosine_and_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [3.0, 3.0]), (5, None), (6, [1.0]), (7, [2.0, 0.0])], "id int, v array<float>")
    pairs = rows.alias("a").crossJoin(rows.alias("b")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), vectors.cosine(F.col("a.v"), F.col("b.v")).alias("c"))
    got = {(r["i"], r["j"]): r["c"] for r in pairs.collect()}
    assert got[1, 7] == 1 and got[1, 2] == 0 and got[3, 3] == 0 and got[6, 1] == 0 and got[5, 1] == 0 and got[1, 4] == pytest.approx(0.5**0.5)
    found = vectors.vector_search(rows.filter("id = 1").withColumnRenamed("id", "q"), rows, "q", "id", "v", 4)
    assert [(r["id"], round(r["score"], 6)) for r in found.orderBy("rank").collect()] == [(1, 1.0), (7, 1.0), (4, 0.707107), (2, 0.0)]


@pytest.mark.parametrize(("mode", "want"), [("zero_token", (0, 0.0)), ("openai_embedding_only", (250_001, 0.005)), ("llm_graph_extract", (1_000_004, 0.3))])
def test_cost(spark, mode, want):
    assert tuple(spark.range(1).select(*evaluation.token_cost(F.lit(1_000_001), mode)).first()) == want


def test_latency_sorts_no_group_in_one_task(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), (F.col("id") * 0.5).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        stats = evaluation.latency_stats(rows, "g", "v")
        got = {x["g"]: (x["n"], x["p50"], x["p95"], x["p99"]) for x in stats.collect()}
        plan = stats._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in ("hot", None):
        values = [i * 0.5 for i in range(3_000) if (i % 3 > 0) == (g == "hot")]
        want[g] = (len(values), *(values[min(len(values) - 1, p * len(values) // 100)] for p in (50, 95, 99)))
    assert got == want and re.search(r"windowspecdefinition\(g#\d+, part#\d+, v#\d+", plan)
