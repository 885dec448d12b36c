"""Parent-child links to full hierarchies.

Subtree sizes are summed upward, preorder ranges handed downward by prefix sums over siblings, and the ranges then
give ancestors and descendants. Both sweeps double their stride each round, so a chain of depth d takes log2(d)
rounds instead of d. Nodes that no round brings to a root lie on or below a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.session import durable, next_round

#: Siblings are ordered by (bucket, id); prefix sums run inside buckets and then over at most so many of them.
SIBLING_BUCKETS = 1_024
#: Preorder numbers of one bucket in which ranges and nodes meet.
RANGE_BUCKET = 64


def _parents(links: DataFrame, parent: str, child: str) -> DataFrame:
    """(node, up): every id once, with its parent or null."""
    pairs = links.select(F.col(parent).cast("string").alias("p"), F.col(child).cast("string").alias("c")).filter("p is not null and c is not null")
    tagged = pairs.select(F.col("c").alias("node"), F.col("p").alias("up")).unionByName(pairs.select(F.col("p").alias("node"), F.lit(None).cast("string").alias("up")))
    return tagged.groupBy("node").agg(F.min("up").alias("up"))


def other_parents(links: DataFrame, parent: str, child: str) -> DataFrame:
    """(child_id, parent_id, kept_parent_id): links of ids with several parents that are no part of the hierarchy."""
    pairs = links.select(F.col(parent).cast("string").alias("parent_id"), F.col(child).cast("string").alias("child_id")).filter("parent_id is not null and child_id is not null").distinct()
    kept = pairs.groupBy("child_id").agg(F.min("parent_id").alias("kept_parent_id"))
    return pairs.join(kept, "child_id").filter("parent_id <> kept_parent_id").select("child_id", "parent_id", "kept_parent_id")


def _climb(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes upward: (node, up, size) of the trees, and (node, up) of what lies on or below cycles."""
    state = next_round(state.select("node", "up", F.col("up").alias("jump"), F.lit(1).cast("long").alias("size")))
    active = state.filter("jump is not null").count()
    while active:
        # Descendants nearer than 2 * stride: those nearer than the stride, of the node and of all nodes a stride below.
        lower = state.filter("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("size").alias("more"))
        ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        grown = state.join(lower, "node", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        state = next_round(grown.join(ahead, "jump", "left").select("node", "up", F.col("next").alias("jump"), "size"), state)
        left = state.filter("jump is not null").count()
        # Depths have no gaps: if none lies in this stride's range, what is left has no root.
        if left == active:
            break
        active = left
    return state.filter("jump is null").drop("jump"), state.filter("jump is not null").select("node", "up")


def _descend(trees: DataFrame, with_paths: bool) -> DataFrame:
    """Adds ``pre``, the preorder number among all nodes, and, if asked for, ``path``, the ids from the root down.

    Roots are siblings like any other, so the ranges [pre, pre + size) of all trees stand side by side.
    """
    # roots have a parent of their own kind
    above = F.when(F.col("up").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "up"))
    bucket = F.pmod(F.xxhash64("node"), F.lit(SIBLING_BUCKETS)).alias("bucket")
    child = trees.select("node", above.alias("of"), "size", bucket)
    sums = child.groupBy("of", "bucket").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("of", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("of", "bucket").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    child = child.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # a child's range begins behind its parent's own number
    offset = child.join(sums, ["of", "bucket"]).select("node", (F.col("base") + F.col("inner") + F.when(F.col("of") == "-", 0).otherwise(1)).alias("pre"))
    kept = ["path"] if with_paths else []
    state = trees.join(offset, "node").select("node", F.col("up").alias("jump"), "pre", *([F.array("node").alias("path")] if with_paths else []))
    state = next_round(state)
    while state.filter("jump is not null").limit(1).count():
        ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("pre").alias("pre_up"), *[F.col(c).alias(f"{c}_up") for c in kept])
        moved = state.join(ahead, "jump", "left")
        longer = [F.when(F.col("jump").isNull(), F.col(c)).otherwise(F.concat(f"{c}_up", c)).alias(c) for c in kept]
        state = next_round(moved.select("node", F.col("next").alias("jump"), (F.col("pre") + F.coalesce("pre_up", F.lit(0))).alias("pre"), *longer), state)
    return trees.join(state.drop("jump"), "node")


def _nested(trees: DataFrame) -> DataFrame:
    """Adds ``root`` and ``depth`` to (node, up, size, pre, ...), read off the nested ranges in one sort.

    Before a node's number ``pre`` stand as many range beginnings; less the ranges that have ended there, these are
    its ancestors, and the last root to begin is its root.
    """
    begin = trees.select(F.col("pre").alias("at"), F.lit(1).alias("kind"), "node", F.when(F.col("up").isNull(), F.struct("pre", "node")).alias("top"))
    end = trees.select((F.col("pre") + F.col("size")).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("node"), F.lit(None).cast("struct<pre:bigint,node:string>").alias("top"))
    marks = durable(begin.unionByName(end).repartitionByRange("at", "kind").withColumn("part", F.spark_partition_id()))
    ended = F.sum(1 - F.col("kind"))
    # a row a partition
    parts = marks.groupBy("part").agg(ended.alias("ended"), F.max("top").alias("top"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ended").over(earlier), F.lit(0)).alias("ended_before"), F.max("top").over(earlier).alias("top_before"))
    upto = Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.withColumns({"ended": ended.over(upto), "last_top": F.max("top").over(upto)}).filter("kind = 1").join(F.broadcast(parts), "part")
    placed = placed.select("node", F.coalesce("last_top", "top_before")["node"].alias("root"), (F.col("at") - F.col("ended") - F.col("ended_before")).alias("depth"))
    return trees.join(placed, "node")


def _cycles(rest: DataFrame) -> DataFrame:
    """(node, root): root is the smallest id on the cycle that the node lies on or below."""
    state = next_round(rest.select("node", F.col("up").alias("jump"), F.col("up").alias("low")))
    count, stride = state.count(), 1
    while stride < count:
        ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("low").alias("low_up"))
        state = next_round(state.join(ahead, "jump").select("node", F.col("next").alias("jump"), F.least("low", "low_up").alias("low")), state)
        stride *= 2
    # After that many steps every walk is on its cycle and has gone all the way round it.
    return state.select("node", "jump").join(state.select(F.col("node").alias("jump"), F.col("low").alias("root")), "jump").select("node", "root")


def hierarchy(links: DataFrame, parent: str, child: str, with_paths: bool = True) -> DataFrame:
    """(node_id, root_id, depth, path, n_descendants, pre): one row per id that occurs in ``links``.

    depth 0 and root itself at a root; ``pre`` numbers the nodes of all trees so that the descendants of a node are
    those with pre in (pre, pre + n_descendants]. A node on or below a cycle (a self-link is one) has
    depth -1, as root the smallest id on that cycle, and null elsewhere. Repeated links count once; a link with a
    null end is ignored; an id of several parents hangs under the smallest (``other_parents`` gives the rest). Extra columns are ignored; no links
    give no rows.
    """
    trees, rest = _climb(_parents(links, parent, child))
    path = F.col("path") if with_paths else F.lit(None).cast("array<string>").alias("path")
    placed = _nested(_descend(trees, with_paths)).select(
        F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), path, (F.col("size") - 1).alias("n_descendants"), "pre"
    )
    cyclic = _cycles(rest).select(
        F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.lit(-1).alias("depth"), F.lit(None).cast("array<string>").alias("path"),
        F.lit(None).cast("long").alias("n_descendants"), F.lit(None).cast("long").alias("pre"),
    )
    return placed.unionByName(cyclic)


def descendants(tree: DataFrame, asked: DataFrame, id_column: str) -> DataFrame:
    """(ancestor_id, descendant_id) for the ids in ``asked``, from the preorder ranges of ``hierarchy``.

    Ranges and nodes meet in buckets of preorder numbers, so a range is compared with few nodes outside it.
    """
    top = tree.join(asked.select(F.col(id_column).alias("node_id")).distinct(), "node_id").filter("n_descendants > 0")
    return _below(top.select("node_id", "pre", "n_descendants"), tree.select("node_id", "pre"))


def _below(top: DataFrame, tree: DataFrame) -> DataFrame:
    """Descendants of (node_id, pre, n_descendants) among (node_id, pre)."""
    top = top.filter("n_descendants > 0").select(F.col("node_id").alias("ancestor_id"), F.col("pre").alias("first"), (F.col("pre") + F.col("n_descendants")).alias("last"))
    top = top.withColumn("bucket", F.explode(F.sequence(F.expr(f"(first + 1) div {RANGE_BUCKET}"), F.expr(f"last div {RANGE_BUCKET}"))))
    below = tree.filter("pre is not null").select(F.col("node_id").alias("descendant_id"), "pre", F.expr(f"pre div {RANGE_BUCKET}").alias("bucket"))
    return top.join(below, "bucket").filter("pre > first and pre <= last").select("ancestor_id", "descendant_id")


def all_descendants(links: DataFrame, parent: str, child: str) -> DataFrame:
    """(ancestor_id, descendant_id): every node with every other node that its links lead down to.

    From the nested ranges: no join makes more than ``RANGE_BUCKET`` pairs a range and bucket that are not in the
    result. A cycle is cut above its smallest id; all of its nodes are ancestors of each other and of what lies below
    it. Links as in ``hierarchy``.
    """
    trees, rest = _climb(_parents(links, parent, child))
    lost = durable(rest.join(_cycles(rest), "node"))
    cut, _ = _climb(lost.select("node", F.when(F.col("node") != F.col("root"), F.col("up")).alias("up")))
    both = trees.withColumn("cyclic", F.lit(False)).unionByName(cut.withColumn("cyclic", F.lit(True)))
    ranges = durable(_descend(both, False).select(F.col("node").alias("node_id"), "pre", (F.col("size") - 1).alias("n_descendants"), "cyclic"))
    pairs = _below(ranges, ranges)
    # the ring of a cycle: the node above its smallest id, and what has that node below it
    closing = lost.filter("node = root").select(F.col("root").alias("ring"), F.col("up").alias("descendant_id"))
    lower = ranges.filter("cyclic").select("node_id", "pre", "n_descendants")
    rings = _below(lower, lower).join(closing, "descendant_id").select("ring", F.col("ancestor_id").alias("ancestor_id")).unionByName(closing.select("ring", F.col("descendant_id").alias("ancestor_id"))).distinct()
    turning = rings.join(lost.select(F.col("root").alias("ring"), F.col("node").alias("descendant_id")), "ring").filter("ancestor_id != descendant_id")
    known = pairs.join(rings.select("ancestor_id"), "ancestor_id", "left_anti")
    return known.unionByName(turning.select("ancestor_id", "descendant_id"))
