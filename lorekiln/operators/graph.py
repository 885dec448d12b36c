"""Traversal and relations of the entity graph, for many start nodes at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions.text import ascii_lower
from lorekiln.session import durable

# Edge types of structural dependence and of conflict.
STRUCTURAL = ("DEPENDS_ON", "REFERENCES", "IMPLEMENTS")
CONFLICTS = ("CONFLICTS_WITH", "SUPERSEDES")


def oriented(edges: DataFrame, direction: str, types: tuple[str, ...] = STRUCTURAL) -> DataFrame:
    """(src, dst, factor) of the wanted types; ``both`` is the union of the two directions, so joins stay equi-joins."""
    rows = edges.filter(F.col("edge_type").isin(*types)).withColumn("factor", F.col("weight") * F.col("confidence"))
    out = rows.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "factor")
    back = rows.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), "factor")
    if direction == "outgoing":
        found = out
    elif direction == "incoming":
        found = back
    elif direction == "both":
        found = out.unionByName(back)
    else:
        raise ValueError(f"direction {direction!r}")
    # parallel edges: only the strongest can matter
    return found.groupBy("src", "dst").agg(F.max("factor").alias("factor"))


def khop(
    edges: DataFrame, starts: DataFrame, direction: str = "both", types: tuple[str, ...] = STRUCTURAL, max_k: int = 2, gamma: float = 0.6, threshold: float = 0.05
) -> DataFrame:
    """(start_id, node_id, influence, depth) of nodes within ``max_k`` steps, influence at least ``threshold``.

    A step multiplies by weight * confidence * gamma; a node has the greatest product and the least depth over simple
    paths. While no step exceeds 1 one row per node and level is enough, and rows under the threshold can be
    dropped at once, while the least depth is taken from all links; otherwise simple paths are enumerated. ``both`` leaves out the start itself; the other
    directions give it only through a self-link. Null ends reach nothing.
    """
    links = durable(oriented(edges, direction, types))
    strongest, weakest, unknown = links.agg(F.max("factor"), F.min("factor"), F.count_if(F.col("factor").isNull())).first()
    monotone = strongest is None or strongest * gamma <= 1
    # a weak short path is dropped, but its depth counts
    dropping = monotone and (unknown > 0 or (weakest is not None and (max(0.0, weakest) * gamma) ** max_k < threshold))
    first = starts.select(F.col(starts.columns[0]).alias("start_id")).distinct().join(links, F.col("start_id") == F.col("src"))
    level = first.select("start_id", F.col("dst").alias("node_id"), (F.col("factor") * gamma).alias("score"), F.array("start_id", "dst").alias("path"))
    steps = first.select("start_id", F.col("dst").alias("node_id"))
    found, all_steps = None, steps.withColumn("depth", F.lit(1))
    for depth in range(1, max_k + 1):
        if depth > 1 and dropping:
            steps = steps.join(links, F.col("node_id") == F.col("src")).filter(F.col("dst") != F.col("start_id")).select("start_id", F.col("dst").alias("node_id")).distinct()
            all_steps = all_steps.unionByName(steps.withColumn("depth", F.lit(depth)))
        if depth > 1:
            step = level.join(links, F.col("node_id") == F.col("src"))
            if monotone:
                step = step.filter(F.col("dst") != F.col("start_id"))
            else:
                step = step.filter(~F.array_contains("path", F.col("dst")))
            path = F.lit(None).cast("array<string>") if monotone else F.array_append("path", F.col("dst"))
            level = step.select("start_id", F.col("dst").alias("node_id"), (F.col("score") * F.col("factor") * gamma).alias("score"), path.alias("path"))
        if monotone:
            level = level.groupBy("start_id", "node_id").agg(F.max("score").alias("score")).filter(F.col("score") >= threshold)
        here = level.select("start_id", "node_id", "score", F.lit(depth).alias("depth"))
        found = here if found is None else found.unionByName(here)
    reached = found.groupBy("start_id", "node_id").agg(F.max("score").alias("influence"), F.min("depth").alias("depth"))
    reached = reached.filter(F.col("influence") >= threshold)
    if dropping:
        least = all_steps.groupBy("start_id", "node_id").agg(F.min("depth").alias("depth"))
        reached = reached.drop("depth").join(least, ["start_id", "node_id"])
    return reached.filter("start_id != node_id") if direction == "both" else reached


def with_entities(reached: DataFrame, entities: DataFrame, files: DataFrame, limit: int = 30) -> DataFrame:
    """Adds name, type and file path; the ``limit`` most influenced of each start. Unknown nodes are left out."""
    about = entities.select(F.col("entity_id").alias("node_id"), "name", "type", "file_id").join(files.select("file_id", "path"), "file_id", "left")
    rows = reached.join(about, "node_id")
    rank = F.row_number().over(Window.partitionBy("start_id").orderBy(F.desc(F.round("influence", 9)), "node_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select("start_id", "node_id", "name", "type", "path", "influence", "depth", "rank")


def lookup(entities: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """(asked, entity_id, name, type, file_id): entities of a name, without regard to the case of A to Z."""
    asked = names.select(F.col(column).alias("asked")).filter("asked is not null").distinct().withColumn("key", ascii_lower(F.col("asked")))
    rows = entities.select("entity_id", "name", "type", "file_id", ascii_lower(F.col("name")).alias("key"))
    return asked.join(rows, "key").drop("key")


def search_names(entities: DataFrame, patterns: list[str], limit: int = 10) -> DataFrame:
    """(pattern, entity_id, name): the first ``limit`` entities whose name holds each pattern; % and _ are wildcards.

    The patterns are a short list; each name is tested against all of them in one scan.
    """
    name = ascii_lower(F.col("name"))
    # a backslash has no meaning in a pattern
    tests = [F.when(name.like(f"%{p.lower()}%".replace("\\", "\\\\")), F.lit(p)) for p in patterns]
    hits = entities.select("entity_id", "name", F.explode(F.array_compact(F.array(*tests))).alias("pattern"))
    rank = F.row_number().over(Window.partitionBy("pattern").orderBy("name", "entity_id"))
    return hits.withColumn("r", rank).filter(F.col("r") <= limit).select("pattern", "entity_id", "name")


def conflicts(edges: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """Both ends of every conflict or supersession, with paths and confidence; ends without entity are left out."""
    about = entities.select("entity_id", "name", "type", "file_id").join(files.select("file_id", "path"), "file_id", "left").drop("file_id")
    a = about.select(*[F.col(c).alias(f"a_{c}") for c in about.columns])
    b = about.select(*[F.col(c).alias(f"b_{c}") for c in about.columns])
    rows = edges.filter(F.col("edge_type").isin(*CONFLICTS)).select("source_id", "target_id", "edge_type", "confidence").distinct()
    rows = rows.join(a, F.col("source_id") == F.col("a_entity_id")).join(b, F.col("target_id") == F.col("b_entity_id"))
    return rows.select("a_entity_id", "a_name", "a_type", "a_path", "b_entity_id", "b_name", "b_type", "b_path", "edge_type", "confidence")


def touching(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(me, with_entity_id, with_name, with_type, with_path, edge_type, confidence): pairs of ``conflicts`` at either end of
    which an asked entity stands; a link of an entity with itself comes once.

    The two orientations are equi-joins; an OR over both ends would compare all with all.
    """
    me, out = asked.select(F.col(asked.columns[0]).alias("me")).distinct(), None
    for mine, other in (("a", "b"), ("b", "a")):
        rows = pairs.join(me, F.col(f"{mine}_entity_id") == F.col("me"))
        rows = rows if mine == "a" else rows.filter("a_entity_id <> b_entity_id")
        rows = rows.select("me", *[F.col(f"{other}_{c}").alias(f"with_{c}") for c in ("entity_id", "name", "type", "path")], "edge_type", "confidence")
        out = rows if out is None else out.unionByName(rows)
    return out


def owners(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, owner_id, owner, confidence): the most trusted owner of each entity; ties to the smaller id."""
    owned = edges.filter("edge_type = 'OWNED_BY'").select("source_id", "target_id", "confidence")
    teams = entities.select(F.col("entity_id").alias("target_id"), F.col("name").alias("owner"), F.col("file_id"))
    rows = owned.join(teams, "target_id")
    # one comparable value a row, so that the choice is made before the shuffle
    best = rows.groupBy("source_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "target_id", "owner")).alias("b"))
    return best.select(F.col("source_id").alias("entity_id"), F.col("b.target_id").alias("owner_id"), F.col("b.owner").alias("owner"), (-F.col("b.c")).alias("confidence"))


def top_children(edges: DataFrame, entities: DataFrame, types: tuple[str, ...] = STRUCTURAL, top: int = 10) -> DataFrame:
    """(src, dst, edge_type, place): the ``top`` heaviest outgoing links of each node to known entities."""
    rows = edges.filter(F.col("edge_type").isin(*types)).select("source_id", "target_id", "edge_type", "weight").distinct()
    rows = rows.join(entities.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id", "edge_type"))
    return rows.withColumn("place", place).filter(F.col("place") <= top).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "edge_type", "place")


def lineage_reach(children: DataFrame, roots: DataFrame, max_depth: int = 4) -> DataFrame:
    """(root_id, node_id, depth): nodes within ``max_depth`` steps of each root over ``children``, least depth."""
    level = roots.select(F.col(roots.columns[0]).alias("root_id")).distinct().withColumn("node_id", F.col("root_id"))
    found = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        level = level.join(children, F.col("node_id") == F.col("src")).select("root_id", F.col("dst").alias("node_id")).distinct()
        found = found.unionByName(level.withColumn("depth", F.lit(depth)))
    return found.groupBy("root_id", "node_id").agg(F.min("depth").alias("depth"))


def lineage_trees(children: DataFrame, roots: DataFrame, max_depth: int = 4) -> DataFrame:
    """(root_id, position, node_id, parent_id, edge_type, depth): pre-order walk with one visited set per root.

    A group is the bounded part of the graph around one root: at most top^max_depth links.
    """
    reach = lineage_reach(children, roots, max_depth - 1)
    links = reach.join(children, F.col("node_id") == F.col("src")).select("root_id", "src", "dst", "edge_type", "place")
    alone = roots.select(F.col(roots.columns[0]).alias("root_id")).distinct()
    alone = alone.select("root_id", F.col("root_id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("edge_type"), F.lit(0).alias("place"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        root = part["root_id"].iloc[0]
        below: dict[str, list] = {}
        for link in part.sort_values("place").itertuples():
            if link.place:
                below.setdefault(link.src, []).append((link.dst, link.edge_type))
        seen, out = {root}, [(root, 0, root, None, None, 0)]
        stack = [(root, 0, iter(below.get(root, [])))]
        while stack:
            node, depth, rest = stack[-1]
            child = next(rest, None) if depth < max_depth else None
            if child is None:
                stack.pop()
            elif child[0] not in seen:
                seen.add(child[0])
                out.append((root, len(out), child[0], node, child[1], depth + 1))
                stack.append((child[0], depth + 1, iter(below.get(child[0], []))))
        return pd.DataFrame(out, columns=["root_id", "position", "node_id", "parent_id", "edge_type", "depth"])

    return links.unionByName(alone).groupBy("root_id").applyInPandas(walk, "root_id string, position int, node_id string, parent_id string, edge_type string, depth int")


def related_entities(ranked: DataFrame, links: DataFrame, entities: DataFrame, files: DataFrame, edges: DataFrame, per_chunk: int = 5) -> DataFrame:
    """``ranked`` (query_id, id, ...) with (nth, entity_id, name, type, path, edge_type, influence) of found chunks.

    Every found chunk stays: one without a known entity has one row with nulls. An entity comes once for each of its
    outgoing edges, or once with REFERENCES and no influence if it has none; the first ``per_chunk`` rows by entity,
    edge type, target, numbered from 1.
    """
    about = entities.select("entity_id", "name", "type", "file_id").join(files.select("file_id", "path"), "file_id", "left").drop("file_id")
    out = edges.select(F.col("source_id").alias("entity_id"), "target_id", F.col("edge_type").alias("kind"), "weight").distinct()
    found = ranked.select("id").distinct().join(links.select(F.col("chunk_id").alias("id"), "entity_id").distinct(), "id").join(about, "entity_id").join(out, "entity_id", "left")
    order = ["entity_id", F.asc_nulls_first("kind"), F.asc_nulls_first("target_id"), F.asc_nulls_first("weight")]
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("nth") <= per_chunk)
    kept = found.select("id", "nth", "entity_id", "name", "type", "path", F.coalesce("kind", F.lit("REFERENCES")).alias("edge_type"), F.col("weight").alias("influence"))
    return ranked.join(kept, "id", "left")

