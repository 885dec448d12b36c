import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lorekiln.llm import near_duplicates as nd
from lorekiln.llm.words import words_of


def texts(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["đường", "Ünïcode", "x_y"]
    out = {}
    for i in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randrange(15, 120))]
        out[f"{i:03d}a"] = " ".join(base)
        for j in range(r.randrange(4)):
            edited = list(base)
            for _ in range(r.randrange(1, 5)):
                edited[r.randrange(len(edited))] = r.choice(vocabulary)
            out[f"{i:03d}{'bcde'[j]}"] = ", ".join(edited).upper() if j % 2 else "  ".join(edited)
    return out


def truth(rows, threshold, width, min_words=20):
    sets = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for i, t in rows.items() if t and len(w := words_of(t)) >= min_words}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}, sets


def frame(spark, rows):
    return spark.createDataFrame(list(rows), "cid string, body string").withColumns({"id": F.lit("clash"), "text": F.lit(1), "n": F.lit(0), "rep": F.lit("r"), "bands": F.lit(2)})


@pytest.mark.parametrize(("threshold", "width"), [(0.7, 3), (0.8, 5)])
def test_pairs_equal_brute_force(spark, threshold, width):
    rows = texts()
    members, links = nd.near_duplicates(frame(spark, rows.items()), "cid", "body", threshold, width)
    got = {tuple(r) for r in nd.expanded_pairs(members, links).collect()}
    want, _ = truth(rows, threshold, width)
    assert got == want and len(want) > 20


def test_copies_ties_nulls_short_and_long(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    base = " ".join(f"q{i}" for i in range(40))
    rows = [("a", base), ("b", base), ("c", base.upper() + "!"), ("a", base), ("d", None), (None, base), ("e", ""), ("f", "too short"), ("g", long), ("h", long + " end"), ("i", "word " * 30), ("j", "word " * 50)]
    members, links = nd.near_duplicates(frame(spark, rows), "cid", "body", 0.7, 3)
    assert {tuple(r) for r in nd.expanded_pairs(members, links).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("g", "h"), ("i", "j")}
    assert {tuple(r) for r in nd.expanded_pairs(members, links, max_copies=2).collect()} == {("a", "b"), ("a", "c"), ("g", "h"), ("i", "j")}
    groups = {r["id"]: tuple(r)[1:] for r in nd.duplicate_groups(members, links).collect()}
    assert groups == {"a": ("a", "a", 0), "b": ("a", "a", 0), "c": ("a", "a", 0), "g": ("g", "g", 1), "h": ("h", "g", 1), "i": ("i", "i", 0), "j": ("i", "i", 0)}


def test_empty_table(spark):
    members, links = nd.near_duplicates(frame(spark, []), "cid", "body")
    assert members.count() == links.count() == nd.expanded_pairs(members, links).count() == nd.duplicate_groups(members, links).count() == 0


def test_hot_bands_are_salted_without_loss(spark, monkeypatch):
    rows = texts(2)
    base = " ".join(f"q{i}" for i in range(60))
    rows |= {f"hot{i}": base.replace(f"q{i} ", "z ") for i in range(50)}
    real, seen = nd.hot_keys, []

    def eager(frame, key, by):
        found = real(frame, key, by, limit=20, sample=1)
        seen.append(found is not None)
        return found

    monkeypatch.setattr(nd, "hot_keys", eager)
    members, links = nd.near_duplicates(frame(spark, rows.items()), "cid", "body", 0.7, 3)
    assert {tuple(r) for r in nd.expanded_pairs(members, links).collect()} == truth(rows, 0.7, 3)[0] and seen == [True]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    links = [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(45)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(100)] + [("x", "x"), ("x", None)]
    near = defaultdict(set)
    for a, b in links:
        if b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in near:
        seen, stack = {start}, [start]
        while stack:
            for n in near[stack.pop()] - seen:
                seen.add(n)
                stack.append(n)
        want[start] = min(seen)
    got = nd.components(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()
    assert {tuple(x) for x in got} == set(want.items()) and len(got) == len(want)


def test_large_classes_keep_every_pair(spark, monkeypatch):
    members = [(f"a{i:04d}", "a0000") for i in range(1_001)] + [("b", "b"), ("c0", "c0"), ("c1", "c0")]
    frame = spark.createDataFrame(members, "id string, rep string")
    links = spark.createDataFrame([("a0000", "b", 0.8), ("a0000", "c0", 0.75)], "rep_a string, rep_b string, similarity double")
    a = [f"a{i:04d}" for i in range(1_001)]
    want = 1_001 * 1_000 // 2 + 3 * 1_001 + 1
    for rows in (2_048, 300):
        monkeypatch.setattr(nd, "PART_ROWS", rows)
        found = nd.expanded_pairs(frame, links)
        assert found.count() == found.distinct().count() == want and found.filter("chunk_a >= chunk_b").count() == 0
        assert {x[0] for x in found.filter("chunk_b = 'c1'").collect()} == {*a, "c0"}


def test_groups_have_every_chunk(spark, sf):
    from lorekiln.llm import queries

    chunks = spark.read.parquet(f"{sf}/chunks.parquet").select("chunk_id")
    found = queries.queries()["p1_groups"](spark, sf)
    assert found.count() == chunks.count() == found.join(chunks, "chunk_id").filter("group_id is not null").count()


@pytest.mark.parametrize("turn", [False, True])
def test_an_id_of_two_texts_keeps_the_links_of_both(spark, turn):
    base, other = " ".join(f"q{i}" for i in range(40)), " ".join(f"z{i}" for i in range(40))
    rows = [("a", base), ("a", other), ("b", base.replace("q39", "end")), ("c", other), ("d", other + " more")]
    rows = [rows[1], rows[0], *rows[2:]] if turn else rows
    members, links = nd.near_duplicates(frame(spark, rows), "cid", "body", 0.7, 3)
    assert sorted(map(tuple, nd.expanded_pairs(members, links).collect())) == [("a", "b"), ("a", "c"), ("a", "d"), ("c", "d")]
    groups = {r["id"]: r["group_id"] for r in nd.duplicate_groups(members, links).collect()}
    assert sorted(groups) == ["a", "b", "c", "d"] and groups["a"] == "a"
