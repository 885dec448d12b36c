from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekiln.llm import mixing as mx

pytestmark = pytest.mark.skipif(not Path(mx.TOKENIZER).exists(), reason="no tokenizer file")


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=8), st.integers(0, 500), st.sampled_from([8, 64, 65_536]))
def test_fit_takes_what_there_is(counts, budget, room):
    lengths, held = np.array(list(counts)), np.array(list(counts.values()))
    taken = mx.fitted(lengths, held, budget, room)
    total = int((lengths * taken).sum())
    assert (taken >= 0).all() and (taken <= held).all() and total <= budget
    if room > 500:
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        assert total == max(s for s in sums if s <= budget)


def test_fit_of_a_large_source():
    lengths = np.arange(20, 3_000)
    held = np.full(len(lengths), 1_000)
    taken = mx.fitted(lengths, held, 1_234_567_891)
    assert int((lengths * taken).sum()) == 1_234_567_891 and (taken <= held).all()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"id": F.lit("clash"), "listed": F.lit("x"), "n_tokens": F.lit(1), "repeats": F.lit(2)})


def targets(spark, rows):
    return spark.createDataFrame(rows, "recipe string, source string, target_share double, max_repeats int").withColumn("there", F.lit(0))


def test_shares_repeats_and_odd_rows(spark):
    rows = [(i, "word " * (i % 7 + 1), "Big" if i % 3 else " big ") for i in range(300)] + [(1000 + i, "tiny note", "small") for i in range(3)]
    rows += [(2000, None, "big"), (2001, " \n", "big"), (2002, "x", None), (2003, "x", "other"), (0, "word " * 1, " big ")]
    want = targets(spark, [("r", "big", 0.5, 2), ("r", "SMALL", 0.5, 4), ("r", "none", 0.1, 3), ("q", "big", None, 2), ("q", "small", 1.0, 0), ("r", "big", 0.5, 2), (None, "big", 1.0, 1)])
    chosen, shares = mx.mixture(docs(spark, rows), want)
    got = chosen.collect()
    table = {(r["recipe"], r["source"]): r for r in shares.collect()}
    assert set(table) == {("r", "big"), ("r", "small"), ("r", "none"), ("q", "big"), ("q", "small")}
    for key, row in table.items():
        mine = [g for g in got if (g["recipe"], g["source"]) == key]
        assert sum(g["n_tokens"] * g["repeats"] for g in mine) == row["actual_tokens"] and len(mine) == row["n_documents"]
    assert table["r", "big"]["actual_tokens"] == table["r", "big"]["target_tokens"]
    assert {g["repeats"] for g in got if g["source"] == "small"} == {4} and table["r", "none"]["actual_share"] == 0
    assert all(table["q", s]["actual_tokens"] == 0 for s in ("big", "small"))
    again, _ = mx.mixture(docs(spark, rows).repartition(5), want)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_empty_tables(spark):
    some, goal = docs(spark, [(1, "a b", "s")]), targets(spark, [("r", "s", 1.0, 1)])
    assert mx.mixture(some.limit(0), goal)[0].count() == mx.mixture(some, goal.limit(0))[0].count() == 0
    assert [r["actual_tokens"] for r in mx.mixture(some.limit(0), goal)[1].collect()] == [0]


def test_total_tokens_is_met(spark):
    rows = [(i, "alpha beta gamma " * (i % 11 + 1), "ab"[i % 2]) for i in range(400)]
    _, shares = mx.mixture(docs(spark, rows), targets(spark, [("r", "a", 0.75, 3), ("r", "b", 0.25, 3)]), total_tokens=5_000)
    got = {r["source"]: r["actual_tokens"] for r in shares.collect()}
    assert abs(got["a"] - 3_750) <= 3 and abs(got["b"] - 1_250) <= 3


def test_tokens_are_exact(spark):
    texts = ["Hello world", "đệm 123  x\n\n", "<|endoftext|>", "a" * 5000]
    encode = mx._encoder(mx.TOKENIZER)
    got = mx.token_counts(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), "doc_id", "text", F.col("source")).collect()
    assert {int(r["id"]): r["n_tokens"] for r in got} == {i: len(encode.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(encode.decode(encode.encode_ordinary(t)) == t for t in texts)


def test_the_largest_total_keeps_every_share(spark):
    rows = [(i, "word " * 50, "small" if i < 4 else "large") for i in range(400)]
    wanted = targets(spark, [("r", "small", 0.25, 3), ("r", "large", 0.5, 2), ("r", "absent", 0.25, 5)])
    chosen, shares = mx.mixture(docs(spark, rows), wanted, keep_shares=True)
    got = {r["source"]: r for r in shares.collect()}
    assert got["small"]["binding"] and not got["large"]["binding"] and got["absent"]["actual_tokens"] == 0
    assert {r["repeats"] for r in chosen.filter("source = 'small'").collect()} == {3}
    assert got["small"]["actual_share"] == pytest.approx(1 / 3, abs=0.02) and got["large"]["actual_share"] == pytest.approx(2 / 3, abs=0.02)
