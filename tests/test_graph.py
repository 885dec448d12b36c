"""Traversal, lineage, hierarchies and references against plain models."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lorekiln.operators import graph, hierarchy, references, upsert

EDGES = "edge_id string, source_id string, target_id string, edge_type string, weight double, confidence double, source_type string, created_ms long"


def edges_of(spark, rows):
    return spark.createDataFrame([(str(i), s, t, k, w, c, "x", i) for i, (s, t, k, w, c) in enumerate(rows)], EDGES)


def paths(links, start, direction, k, gamma, threshold):
    step = defaultdict(list)
    for s, t, f in links:
        if direction != "incoming":
            step[s].append((t, f))
        if direction != "outgoing":
            step[t].append((s, f))
    best = {}

    def walk(node, path, score, depth):
        for nxt, f in step[node]:
            if depth == 0 or nxt not in path:
                now = score * (f * gamma) if depth else f * gamma
                b = best.setdefault(nxt, [0, 99])
                b[0], b[1] = max(b[0], now), min(b[1], depth + 1)
                if depth + 1 < k:
                    walk(nxt, [*path, nxt], now, depth + 1)

    walk(start, [start], 1, 0)
    return {n: (round(s, 9), d) for n, (s, d) in best.items() if s >= threshold and not (direction == "both" and n == start)}


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "both"])
@pytest.mark.parametrize("top", [1.0, 2.5])
def test_khop_equals_path_enumeration(spark, direction, top):
    r = random.Random(3)
    rows = [(r.choice("abcdefg"), r.choice("abcdefg"), "DEPENDS_ON", r.uniform(0.3, top), 1.0) for _ in range(14)] + [("a", None, "DEPENDS_ON", 1.0, 1.0), ("a", "b", "OTHER", 1.0, 1.0)]
    found = graph.khop(edges_of(spark, rows), spark.createDataFrame([("a",), ("c",), ("c",), ("zz",)], "s string"), direction, max_k=3, threshold=0.02).collect()
    links = [(s, t, w * c) for s, t, k, w, c in rows if k == "DEPENDS_ON"]
    for start in "ac":
        got = {x["node_id"]: (round(x["influence"], 9), x["depth"]) for x in found if x["start_id"] == start and x["node_id"]}
        assert got == {n: v for n, v in paths(links, start, direction, 3, 0.6, 0.02).items() if n}


def test_lineage_is_preorder_with_one_visited_set(spark):
    rows = [("r", "a", "DEPENDS_ON", 0.9, 1.0), ("r", "b", "DEPENDS_ON", 0.8, 1.0), ("a", "b", "REFERENCES", 0.5, 1.0), ("b", "c", "IMPLEMENTS", 0.5, 1.0), ("c", "r", "DEPENDS_ON", 1.0, 1.0), ("a", "gone", "DEPENDS_ON", 1.0, 1.0)]
    entities = spark.createDataFrame([(x,) for x in "rabc"], "entity_id string")
    tree = graph.lineage_trees(graph.top_children(edges_of(spark, rows), entities), spark.createDataFrame([("r",), ("q",)], "n string"), 4)
    got = [(x["node_id"], x["parent_id"], x["depth"]) for x in tree.filter("root_id = 'r'").orderBy("position").collect()]
    assert got == [("r", None, 0), ("a", "r", 1), ("b", "a", 2), ("c", "b", 3)]
    assert [x["node_id"] for x in tree.filter("root_id = 'q'").collect()] == ["q"]


def model_tree(links):
    up = {}
    for p, c in sorted({x for x in links if None not in x}, reverse=True):
        up[c] = p
    nodes = {n for p, c in links if p is not None and c is not None for n in (p, c)}
    out = {}
    for n in nodes:
        path, at = [n], n
        while at in up and up[at] not in path:
            at = up[at]
            path.append(at)
        if at in up:
            ring = path[path.index(up[at]) :]
            out[n] = (min(ring), -1, None)
        else:
            out[n] = (at, len(path) - 1, path[::-1])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hierarchy_follows_the_model(spark, seed):
    r = random.Random(seed)
    links = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(36)]
    links += [(f"c{i}", f"c{i + 1}") for i in range(70)] + [("x", "x"), ("x", "y"), (None, "z"), ("z", None), links[0]] + [("hub", f"leaf{i}") for i in range(60)]
    frame = spark.createDataFrame(links, "p string, c string").withColumn("node", F.lit("clash")).withColumn("up", F.lit(1))
    rows = hierarchy.hierarchy(frame, "p", "c").collect()
    want = model_tree(links)
    assert {x["node_id"]: (x["root_id"], x["depth"], x["path"]) for x in rows} == want and len(rows) == len(want)
    below = defaultdict(set)
    for n, (_, _, path) in want.items():
        for a in (path or [])[:-1]:
            below[a].add(n)
    placed = {x["node_id"]: x for x in rows if x["depth"] >= 0}
    for n, x in placed.items():
        assert x["n_descendants"] == len(below[n])
        inside = {m for m, y in placed.items() if y["root_id"] == x["root_id"] and x["pre"] < y["pre"] <= x["pre"] + x["n_descendants"]}
        assert inside == below[n]
    pairs = hierarchy.descendants(hierarchy.hierarchy(frame, "p", "c"), spark.createDataFrame([("c68",), ("hub",), ("hub",), ("none",)], "i string"), "i")
    assert {tuple(x) for x in pairs.collect()} == {("c68", "c69"), ("c68", "c70")} | {("hub", f"leaf{i}") for i in range(60)}


def test_hierarchy_of_nothing(spark):
    empty = spark.createDataFrame([], "p string, c string")
    assert hierarchy.hierarchy(empty, "p", "c").count() == 0


def reference_tables(spark):
    month = 86_400_000 * 31
    children = spark.createDataFrame(
        [("1", "a", month), ("1", "a", month), ("2", "b", 0), ("3", "c", None), ("4", None, 5), ("5", " ", 5), ("6", "d", 9), ("7", "late", 10), ("8", "late", 90), ("9", "late", None)], "rid string, k string, at long"
    ).withColumn("key", F.lit("clash")).withColumn("present", F.lit(7))
    parents = spark.createDataFrame([("d", 1), ("late", 50), ("late", 60), (None, 3)], "k string, since long")
    gone = spark.createDataFrame([("b",), ("d",), (None,)], "k string")
    c = F.col
    return [references.Children("t", children, c("rid"), c("k"), "p", c("at"))], [references.Parents("p", parents, c("k"), c("since")), references.Parents("p", gone, c("k"), deleted=True)]


def test_broken_references(spark):
    got = {tuple(x) for x in references.broken_references(*reference_tables(spark)).collect()}
    assert got == {("t", "1", "missing", "1970-02"), ("t", "2", "deleted", "1970-01"), ("t", "3", "missing", None), ("t", "7", "late", "1970-01")}


def test_broken_references_with_many_failing_keys(spark, monkeypatch):
    want = {tuple(x) for x in references.broken_references(*reference_tables(spark)).collect()}
    monkeypatch.setattr(references, "HOT_BROADCAST_ROWS", 1)
    monkeypatch.setattr(references, "HOT_ROWS", 1)
    assert {tuple(x) for x in references.broken_references(*reference_tables(spark)).collect()} == want


def test_references_of_empty_tables(spark):
    children, parents = reference_tables(spark)
    none = [references.Children("t", children[0].rows.limit(0), children[0].ref_id, children[0].key, "p", children[0].at_ms)]
    assert references.broken_references(none, parents).count() == 0
    assert references.broken_references(children, []).count() == 7


def test_upserts(spark):
    rows = spark.createDataFrame(
        [("1", "Ab", "service", "f1", "m", None, 1), ("2", "aB", "document", None, "auto", "{}", 2), ("3", "é", "x", None, "s", None, 1), ("4", "É", "y", None, "s", None, 2), ("5", None, "z", None, "s", None, 3)],
        "entity_id string, name string, type string, file_id string, source string, metadata string, created_ms long",
    )
    got = {x["name_key"]: tuple(x)[1:] for x in upsert.upsert_entities(rows, ["created_ms", "entity_id"]).collect()}
    assert got["ab"] == ("1", "Ab", 1, "document", "auto", "f1", "{}", 2)
    assert set(got) == {"ab", "é", "É"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_descendants_follow_the_links(spark, seed):
    r = random.Random(seed)
    links = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(36)]
    links += [("x", "x"), ("x", "y"), ("y", "z"), (None, "z"), ("u", "v"), ("v", "w"), ("w", "u"), ("w", "t"), ("hub", "mid")] + [("mid", f"leaf{i}") for i in range(150)]
    up = {}
    for p, c in links:
        if p is not None:
            up[c] = min(up.get(c, p), p)
    want = set()
    for node in up:
        at, seen = up[node], set()
        while at is not None and at not in seen:
            seen.add(at)
            at = up.get(at)
        want |= {(a, node) for a in seen - {node}}
    frame = spark.createDataFrame(links, "p string, c string")
    got = [tuple(x) for x in hierarchy.all_descendants(frame, "p", "c").collect()]
    assert set(got) == want and len(got) == len(want)
    tree = hierarchy.hierarchy(frame, "p", "c", False)
    placed = {x["node_id"] for x in tree.collect() if x["depth"] >= 0}
    assert {tuple(x) for x in hierarchy.descendants(tree, tree, "node_id").collect()} == {(a, b) for a, b in want if a in placed}


def test_depth_counts_weak_short_paths(spark):
    rows = [("s", "x", "DEPENDS_ON", 0.05, 1.0), ("s", "y", "DEPENDS_ON", 1.0, 1.0), ("y", "x", "DEPENDS_ON", 1.0, 1.0), ("s", "s", "DEPENDS_ON", 1.0, 1.0)]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, edge_type string, weight double, confidence double")
    starts = spark.createDataFrame([("s",)], "id string")
    found = {x["node_id"]: (round(x["influence"], 9), x["depth"]) for x in graph.khop(edges, starts, "outgoing").collect()}
    assert found == {"x": (0.36, 1), "y": (0.6, 1), "s": (0.6, 1)}


def test_found_chunks_without_an_entity_stay(spark):
    ranked = spark.createDataFrame([(1, "c1", 1, 0.5), (1, "c2", 2, 0.4), (2, "c1", 1, 0.3)], "query_id int, id string, rank int, score double")
    links = spark.createDataFrame([("e1", "c1"), ("e1", "c1"), ("e2", "c1"), ("gone", "c2")], "entity_id string, chunk_id string")
    entities = spark.createDataFrame([("e1", "one", "api", "f1"), ("e2", "two", "team", None)], "entity_id string, name string, type string, file_id string")
    files = spark.createDataFrame([("f1", "a/one.md")], "file_id string, path string")
    edges = spark.createDataFrame([("e1", f"t{i}", "DEPENDS_ON", 0.1 * i) for i in range(6)], "source_id string, target_id string, edge_type string, weight double")
    got = [tuple(r[c] for c in ("query_id", "id", "score", "nth", "entity_id", "path", "edge_type", "influence")) for r in graph.related_entities(ranked, links, entities, files, edges).orderBy("query_id", "rank", "nth").collect()]
    lists = [("e1", "a/one.md", "DEPENDS_ON", pytest.approx(0.1 * i)) for i in range(5)]
    assert got == [(1, "c1", 0.5, i + 1, *x) for i, x in enumerate(lists)] + [(1, "c2", 0.4, None, None, None, None, None)] + [(2, "c1", 0.3, i + 1, *x) for i, x in enumerate(lists)]


def test_conflicts_are_seen_from_either_end(spark):
    entities = spark.createDataFrame([(e, e.upper(), "document", None) for e in "abc"], "entity_id string, name string, type string, file_id string")
    files = spark.createDataFrame([], "file_id string, path string")
    edges = spark.createDataFrame([("a", "b", "CONFLICTS_WITH", 0.8), ("c", "a", "SUPERSEDES", 1.0), ("a", "a", "CONFLICTS_WITH", 0.2), ("a", "b", "DEPENDS_ON", 1.0)], "source_id string, target_id string, edge_type string, confidence double")
    found = graph.touching(graph.conflicts(edges, entities, files), spark.createDataFrame([("a",), ("a",), ("x",)], "e string"))
    assert sorted((r["me"], r["with_name"], r["edge_type"]) for r in found.collect()) == [("a", "A", "CONFLICTS_WITH"), ("a", "B", "CONFLICTS_WITH"), ("a", "C", "SUPERSEDES")]


def test_other_parents_are_reported(spark):
    links = spark.createDataFrame([("p", "x"), ("q", "x"), ("q", "x"), ("p", "y"), (None, "y"), ("x", "z")], "p string, c string")
    assert [tuple(r) for r in hierarchy.other_parents(links, "p", "c").collect()] == [("x", "q", "p")]
