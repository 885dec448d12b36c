"""Retrieval and graph quality, latency and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.session import durable


def _key(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def ranking_metrics(retrieved: DataFrame, truth: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Hit rate and recall at each k, reciprocal rank and NDCG@5 of every query.

    ``retrieved`` (query_id, id, rank from 1), ``truth`` (query_id, id), ``queries`` (query_id). Ids compare
    without case and blanks. Repeats in either list count as they stand, so NDCG can exceed 1. A query without
    truth scores 1 everywhere.
    """
    wanted = truth.select("query_id", _key(F.col("id")).alias("key"))
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("truths"))
    hits = retrieved.select("query_id", _key(F.col("id")).alias("key"), "rank").join(wanted.distinct(), ["query_id", "key"])

    def within(k: int) -> Column:
        return F.sum(F.when(F.col("rank") <= k, 1).otherwise(0))

    gains = F.sum(F.when(F.col("rank") <= 5, 1.0 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0))
    found = hits.groupBy("query_id").agg(*[within(k).alias(f"h{k}") for k in ks], F.min("rank").alias("first"), gains.alias("dcg"))
    rows = queries.select("query_id").distinct().join(sizes, "query_id", "left").join(found, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("truths"), F.lit(5)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + F.lit(1.0)))

    def scored(value: Column) -> Column:
        return F.when(F.col("truths").isNull(), 1.0).otherwise(F.coalesce(value, F.lit(0.0)))

    out = [scored(F.least(F.lit(1.0), F.coalesce(f"h{k}", F.lit(0)).cast("double"))).alias(f"hit_rate_{k}") for k in ks]
    out += [scored(F.least(F.lit(1.0), F.coalesce(f"h{k}", F.lit(0)) / F.col("truths"))).alias(f"recall_{k}") for k in ks]
    return rows.select("query_id", *out, scored(1.0 / F.col("first")).alias("mrr"), scored(F.col("dcg") / ideal).alias("ndcg_5"))


def set_metrics(retrieved: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, precision, recall, f1) of sets; without truth, precision and f1 are 1 only if nothing was found."""
    r = retrieved.select("query_id", _key(F.col("id")).alias("key")).distinct().withColumn("r", F.lit(1))
    t = truth.select("query_id", _key(F.col("id")).alias("key")).distinct().withColumn("t", F.lit(1))
    both = r.join(t, ["query_id", "key"], "full_outer").groupBy("query_id").agg(F.sum("r").alias("r"), F.sum("t").alias("t"), F.sum(F.col("r") * F.col("t")).alias("tp"))
    rows = queries.select("query_id").distinct().join(both, "query_id", "left").fillna(0, ["r", "t", "tp"])
    none = F.col("t") == 0
    empty = F.when(F.col("r") == 0, 1.0).otherwise(0.0)
    precision = F.when(none, empty).when(F.col("r") == 0, 0.0).otherwise(F.try_divide("tp", "r"))
    recall = F.when(none, 1.0).otherwise(F.try_divide("tp", "t"))
    rows = rows.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(none, empty).otherwise(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return rows.select("query_id", "precision", "recall", f1.alias("f1"))


def any_hit(retrieved: DataFrame, truth: DataFrame, queries: DataFrame, empty_agrees: bool = True) -> DataFrame:
    """(query_id, hit): whether any true id was retrieved, ids compared without case and blanks.

    A query without truth is a hit if nothing was retrieved either, unless ``empty_agrees`` is off.
    """
    r = retrieved.select("query_id", _key(F.col("id")).alias("key")).distinct().withColumn("r", F.lit(1))
    t = truth.select("query_id", _key(F.col("id")).alias("key")).distinct().withColumn("t", F.lit(1))
    both = r.join(t, ["query_id", "key"], "full_outer").groupBy("query_id").agg(F.max(F.col("r") * F.col("t")).alias("met"))
    rows = queries.select("query_id").distinct().join(both.withColumn("any", F.lit(True)), "query_id", "left")
    return rows.select("query_id", (F.col("met").isNotNull() | (F.col("any").isNull() & F.lit(empty_agrees))).alias("hit"))


def hit_rate(hits: DataFrame, metric: str) -> DataFrame:
    """(metric, items, hits, score): share of hits to 3 places, 1 without items."""
    n = F.count(F.lit(1))
    return hits.agg(F.lit(metric).alias("metric"), n.alias("items"), F.count_if("hit").alias("hits"), F.coalesce(F.round(F.avg(F.col("hit").cast("double")), 3), F.lit(1.0)).alias("score"))


def macro_average(sets: DataFrame) -> DataFrame:
    """(items, precision, recall, f1): plain means over queries to 3 places, 1 without queries."""
    return sets.agg(F.count(F.lit(1)).alias("items"), *[F.coalesce(F.round(F.avg(c), 3), F.lit(1.0)).alias(c) for c in ("precision", "recall", "f1")])


def path_accuracy(retrieved: Column, truth: Column) -> Column:
    """struct(overlap, exact): share of the truth's elements that occur among the retrieved; exact if all do."""
    r, t = F.transform(retrieved, _key), F.transform(truth, _key)
    hits = F.size(F.filter(t, lambda x: F.array_contains(r, x)))
    overlap = F.when(F.size(t) == 0, 1.0).otherwise(F.try_divide(hits, F.size(t)))
    return F.struct(overlap.alias("overlap"), (overlap >= 1.0).alias("exact"))


def by_category(metrics: DataFrame, category: str, columns: list[str]) -> DataFrame:
    """Mean of each metric by category and, with category null, over all, to 3 places."""
    return metrics.rollup(category).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in columns])


def latency_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Count, extremes, mean and nearest-rank percentiles of each group, to 2 places.

    The place of a percentile p is min(n - 1, floor(p * n)) from 0. A group may be of any size: values are counted
    by distinct value first and percentiles found on running counts, inside range partitions of (group, value) and
    then over these.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    counts = durable(counts.repartitionByRange(group, value).withColumn("part", F.spark_partition_id()))
    # a row a group and partition
    sums = counts.groupBy(group, "part").agg(F.sum("c").alias("held"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("of_group"), F.col("part").alias("of_part"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"), F.sum("held").over(Window.partitionBy(group)).alias("n"))
    upto = Window.partitionBy(group, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("inner", F.sum("c").over(upto)).join(sums, (F.col("part") == F.col("of_part")) & F.col(group).eqNullSafe(F.col("of_group")))
    placed = placed.withColumn("upto", F.col("base") + F.col("inner"))

    def percentile(p: int) -> Column:
        place = F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n") / 100))
        return F.round(F.min(F.when(F.col("upto") > place, F.col(value))), 2).alias(f"p{p}")

    mean = F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 2).alias("mean")
    return placed.groupBy(group).agg(F.sum("c").alias("n"), F.round(F.min(value), 2).alias("min"), F.round(F.max(value), 2).alias("max"), mean, percentile(50), percentile(95), percentile(99))


# US dollars for a million tokens, and tokens used for each token of text.
COSTS = {"zero_token": (0.0, 0, 0), "openai_embedding_only": (0.02, 1, 5), "llm_graph_extract": (0.30, 4, 4)}


def token_cost(chars: Column, mode: str) -> tuple[Column, Column]:
    """(tokens, cost) of so many characters."""
    price, times, places = COSTS[mode]
    tokens = F.ceil(chars / 4).cast("bigint") * times
    return tokens, F.round(tokens / F.lit(1_000_000.0) * price, places)
