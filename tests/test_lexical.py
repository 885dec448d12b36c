"""The index against SQLite's full-text search, which defines its results."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lorekiln.functions.tokens import match_expression
from lorekiln.operators import fusion, lexical
from lorekiln.session import durable


def fts(rows, expression, limit=30):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content, ctx)")
    db.executemany("INSERT INTO t(rowid, content, ctx) VALUES (?, ?, ?)", rows)
    return db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY 2, 1 LIMIT ?", (expression, limit)).fetchall()


@pytest.fixture(scope="module")
def docs(spark, sf):
    table = spark.read.parquet(f"{sf}/chunks.parquet").select("ord", "content", "contextualized_content")
    return table, [tuple(r) for r in table.collect()]


@pytest.mark.parametrize(
    "query",
    ["the gateway", "passerelle équipe", "bộ nhớ đệm", "gateway gateway snapshot", "INC-86992 or so", "see_above", "no_content_yet", "Prüfung für", "zzz_not_there", "a the of 5"],
)
def test_bm25_equals_fts5(spark, docs, query):
    table, rows = docs
    asked = spark.createDataFrame([(1, query)], "query_id int, text string")
    expression = asked.select(match_expression(F.col("text"))).first()[0]
    want = fts(rows, expression)
    found = lexical.keyword_search(table, asked, "ord", ["content", "contextualized_content"], "query_id", "text", "ord", 30).orderBy("rank").collect()
    assert len(found) == len(want)
    assert {r["id"]: round(r["score"], 9) for r in found if r["score"] < want[-1][1] - 1e-9} == {i: round(s, 9) for i, s in want if s < want[-1][1] - 1e-9}
    assert [round(r["score"], 9) for r in found] == [round(s, 9) for _, s in want]


def test_empty_query_and_empty_table(spark, docs):
    table, _ = docs
    asked = spark.createDataFrame([(1, " ?! "), (2, None)], "query_id int, text string")
    assert lexical.keyword_search(table, asked, "ord", ["content"], "query_id", "text", "ord").count() == 0
    asked = spark.createDataFrame([(1, "gateway")], "query_id int, text string")
    assert lexical.keyword_search(table.limit(0), asked, "ord", ["content"], "query_id", "text", "ord").count() == 0


def ranked(spark, ids):
    return spark.createDataFrame([(0, i, r) for r, i in enumerate(ids, 1)], "query_id int, id string, rank int")


def fused(spark, a, b, k):
    return [(r["id"], r["score"]) for r in fusion.rrf([ranked(spark, a), ranked(spark, b)], k).orderBy("rank").collect()]


def test_rrf_cases(spark):
    first = fused(spark, ["A", "B"], ["A", "C"], 5)
    assert first[0] == ("A", pytest.approx(2 / 61)) and [i for i, _ in first] == ["A", "B", "C"]
    apart = fused(spark, ["k1", "k2"], ["v1", "v2"], 10)
    assert [i for i, _ in apart] == ["k1", "v1", "k2", "v2"] and apart[1][1] == pytest.approx(1 / 61)
    assert len(fused(spark, list("abcde"), ["f"], 10)) == 6
    assert len(fused(spark, [f"k{i}" for i in range(20)], [f"v{i}" for i in range(20)], 7)) == 7
    assert len(fused(spark, ["a"], ["b"], 50)) == 2
    assert fused(spark, [], [], 10) == []
    a, b = [str(random.Random(1).randrange(5)) for _ in range(10)], [f"{i % 7}" for i in range(14)]
    scores = [s for _, s in fused(spark, a, b, 20)]
    assert scores == sorted(scores, reverse=True)
    want = {}
    for ids in (a, b):
        for r, i in enumerate(ids, 1):
            want[i] = want.get(i, 0) + 1 / (60 + r)
    assert dict(fused(spark, a, b, 20)) == pytest.approx(want)


def test_context_stops_at_first_overflow(spark):
    docs = spark.createDataFrame([("a", "p", "h", "x" * 400), ("b", "p", "", "y" * 4000), ("c", "p", None, "z")], "id string, path string, heading_path string, content string")
    row = fusion.context_blocks(ranked(spark, ["a", "b", "c"]), docs, 200).first()
    assert row["chunks_count"] == 1 and row["context"].startswith("### [p] > h\nxxx") and row["context"].endswith("---")
    assert fusion.context_blocks(ranked(spark, ["b"]), docs, 10).first()["context"].startswith("### [p]\nyyy")


def written(spark):
    """Bytes that the session's tasks have written for shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def test_equal_queries_are_searched_once(spark):
    docs = spark.range(2000).select(F.col("id").alias("ord"), F.concat(F.lit("common number_"), "id").alias("content"))
    asked = spark.range(1000).select(F.col("id").alias("query_id"), F.lit("common").alias("text"))
    before = written(spark)
    found = lexical.keyword_search(docs, asked, "ord", ["content"], "query_id", "text", "ord", 3).collect()
    assert written(spark) - before < 2_000_000
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found) == [(q, i + 1, i) for q in range(1000) for i in range(3)]


def test_many_queries_equal_fts5(spark):
    rng = random.Random(5)
    some = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, some("abcdefgh", rng.randrange(0, 9)), some("abcxyz", rng.randrange(0, 4))) for i in range(300)]
    texts = [some(["a", "b", "c", "a_b", "b_c_a", "x", "h", "h_g", "nowhere"], rng.randrange(1, 5)) for _ in range(60)]
    docs = spark.createDataFrame(rows, "ord int, content string, ctx string")
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    columns, order = ["content", "ctx"], docs.select(F.col("ord").alias("id"), F.col("ord").alias("tie"))
    direct = lexical.keyword_search(docs, asked, "ord", columns, "query_id", "text", "ord", 4).collect()
    stored = lexical.index_search(lexical.postings(docs, "ord", columns), lexical.doc_lengths(docs, "ord", columns), asked, "query_id", "text", order, 4).collect()
    for found in (direct, stored):
        got = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in found)
        want = []
        for q, text in enumerate(texts):
            hits = fts(rows, " OR ".join(f'"{t}"' for t in text.split()), 1000)
            hits = sorted((round(s, 9), i) for i, s in hits)[:4]
            want += [(q, place, i, round(s, 8)) for place, (s, i) in enumerate(hits, 1)]
        assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-7)


def test_postings_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(5, "b a b"), (5, "b only"), (6, None)], "ord int, content string")
    found = lexical.postings(docs, "ord", ["content"]).collect()
    assert sorted((r["term"], r["id"], r["tf"], r["positions"]) for r in found) == [("a", 5, 1, [1]), ("b", 5, 3, [0, 0, 2]), ("only", 5, 1, [1])]


def test_index_and_its_phrases_shuffle_little(spark, docs):
    table, rows = docs
    text = ["content", "contextualized_content"]
    before = written(spark)
    index = durable(lexical.postings(table, "ord", text))
    built = written(spark) - before
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("the_gateway_"), "id").alias("text"))
    order, before = table.select(F.col("ord").alias("id"), F.col("ord").alias("tie")), written(spark)
    lexical.index_search(index, lexical.doc_lengths(table, "ord", text), asked, "query_id", "text", order).collect()
    assert built < 250_000 and written(spark) - before < 300_000
