import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekiln.llm import splitting as sp


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\t!", max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_pieces_fit_overlap_and_give_the_text_back(text, limit, overlap):
    found = sp.spans(text, limit, overlap)
    assert all(0 < e - s <= limit or not text for s, e, _ in found)
    assert all(b[0] == a[1] - overlap for a, b in zip(found, found[1:], strict=False))
    assert text[found[0][0] : found[0][1]] + "".join(text[s + overlap : e] for s, e, _ in found[1:]) == text


def test_cuts_prefer_strong_boundaries():
    block = "x" * 30
    assert sp.spans(f"{block}\n\n{block}\n{block}", 50, 5)[0] == (0, 32, 0)
    assert sp.spans(f"{block}\n{block} {block}", 50, 5)[0] == (0, 31, 1)
    assert sp.spans("One two. Three four five. Six seven eight nine", 30, 5)[0] == (0, 26, 2)
    assert sp.spans("word " * 20, 32, 5)[0] == (0, 30, 3)
    assert sp.spans("y" * 100, 40, 10) == [(0, 40, 4), (30, 70, 4), (60, 100, -1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, file_id string, chunk_index int, heading_path string, content string, ord long").withColumns({"id": F.lit(1), "carry": F.lit(2), "piece": F.lit(3), "kind": F.lit("k")})


ROWS = [
    ("a", "f", 5, "H", "p" * 2000 + "\n \n" + "q" * 2000, 1), ("b", "f", 0, None, "short", 2), ("c", "f", 5, "H", " \n" + "z" * 2800 + "\t", 3), ("d", "g", 1, "", None, 4), ("e", None, 1, "x", "", 5),
    ("l", "f", 9, "L", "long word " * 40_000, 6), ("b", "f", 0, None, "short", 2), ("i", "g", 0, "I", "![pic](data:image/png;base64," + "A" * 5000 + ") text", 7), (None, None, None, None, "o" * 3000, None),
]


def test_oversized(spark):
    rows = sp.oversized_pieces(frame(spark, ROWS), "chunk_id", "content").collect()
    kinds = {r["id"]: r["kind"] for r in rows}
    assert kinds == {"a": "blocks", "l": "inside", None: "inside"}
    assert all(len(r["content"]) == r["stop"] - r["start"] <= 2800 for r in rows)
    text = "".join(r["content"][400 * (r["piece"] > 0) :] for r in sorted((r for r in rows if r["id"] == "l"), key=lambda r: r["piece"]))
    assert text == ("long word " * 40_000).strip()


@pytest.mark.parametrize("parts", [1, 7])
def test_renumbering(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = random.Random(1)
        rows = ROWS + [(f"m{i}", "hot", r.randrange(20), "h", f"text {i}", 100 + i) for i in range(500)]
        got = sp.resplit_chunks(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by_file = {}
    for x in got:
        by_file.setdefault(x["file_id"], []).append(x)
    assert all(sorted(x["chunk_index"] for x in xs) == list(range(len(xs))) for xs in by_file.values())
    hot = [x["chunk_id"] for x in sorted(by_file["hot"], key=lambda x: x["chunk_index"])]
    assert hot == [x[0] for x in sorted((x for x in rows if x[1] == "hot"), key=lambda x: (x[2], x[5]))]
    f = [(x["chunk_id"], x["piece"]) for x in sorted(by_file["f"], key=lambda x: x["chunk_index"])]
    assert f[:5] == [("b", 0), ("b", 0), ("a", 0), ("a", 1), ("c", 0)] and {x["heading_path"] for x in by_file["f"] if x["chunk_id"] == "l"} == {"L"}


def test_empty(spark):
    assert sp.oversized_pieces(frame(spark, []), "chunk_id", "content").count() == sp.resplit_chunks(frame(spark, [])).count() == 0
