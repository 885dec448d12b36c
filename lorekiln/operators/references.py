"""References to records that do not exist.

Tagged parent and child keys stand in one long table, grouped by parent table and key; groups without a parent, or
whose parent came later than a child, are kept and counted by period.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.session import HOT_BROADCAST_ROWS, HOT_ROWS, durable


@dataclass(frozen=True)
class Children:
    """One referring column: ``key`` points into ``parent``; ``at_ms`` is the referring row's time."""

    table: str
    rows: DataFrame
    ref_id: Column
    key: Column
    parent: str
    at_ms: Column
    present: Column | None = None


@dataclass(frozen=True)
class Parents:
    """One table of keys that exist (``deleted`` False) or did once (``deleted`` True); ``since_ms`` may be None."""

    parent: str
    rows: DataFrame
    key: Column
    since_ms: Column | None = None
    deleted: bool = False


def child_rows(children: list[Children]) -> DataFrame:
    """(parent, key, ref_table, ref_id, at_ms), null and blank references left out."""
    out = None
    for c in children:
        there = F.trim(c.key) != "" if c.present is None else c.present
        rows = c.rows.filter(there).select(
            F.lit(c.parent).alias("parent"), c.key.alias("key"), F.lit(c.table).alias("ref_table"), c.ref_id.cast("string").alias("ref_id"), c.at_ms.cast("long").alias("at_ms")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def failing_keys(children: DataFrame, parents: list[Parents]) -> DataFrame:
    """(parent, key, refs, present, since_ms, gone): keys referred to without a parent, or before it came.

    One shuffle of keys: repeated child keys are summed and parent flags merged before it.
    """
    tagged = children.select("parent", "key", F.lit(1).alias("refs"), "at_ms", F.lit(0).alias("present"), F.lit(None).cast("long").alias("since_ms"), F.lit(0).alias("gone"))
    for p in parents:
        since = F.lit(None) if p.since_ms is None else p.since_ms
        tagged = tagged.unionByName(
            p.rows.filter(p.key.isNotNull()).select(
                F.lit(p.parent).alias("parent"),
                p.key.alias("key"),
                F.lit(0).alias("refs"),
                F.lit(None).cast("long").alias("at_ms"),
                F.lit(int(not p.deleted)).alias("present"),
                (F.lit(None) if p.deleted else since).cast("long").alias("since_ms"),
                F.lit(int(p.deleted)).alias("gone"),
            )
        )
    groups = tagged.groupBy("parent", "key").agg(
        F.sum("refs").alias("refs"), F.min("at_ms").alias("earliest_ms"), F.max("present").alias("present"), F.min("since_ms").alias("since_ms"), F.max("gone").alias("gone")
    )
    return groups.filter((F.col("refs") > 0) & ((F.col("present") == 0) | (F.col("since_ms") > F.col("earliest_ms")))).drop("earliest_ms")


def broken_references(children: list[Children], parents: list[Parents]) -> DataFrame:
    """(ref_table, ref_id, kind, period): each reference that fails, repeated rows once.

    kind: ``late`` if the key exists but since a later time than the referring row's, ``deleted`` if it does not
    exist and is listed as deleted, else ``missing``. period: month of the referring row, UTC; null where it has
    no time. A row without a time is never late. Null and blank references are none; an empty child table gives no
    rows, an empty parent table makes every reference fail.

    Failing keys are sent to the child rows if they are few enough to broadcast. Otherwise the keys that hold very
    many child rows are (there are at most rows / HOT_ROWS of them), and only the others are shuffled.
    """
    rows = child_rows(children)
    keys = durable(failing_keys(rows, parents))
    on = ["parent", "key"]
    if keys.count() <= HOT_BROADCAST_ROWS:
        held = rows.join(F.broadcast(keys), on)
    else:
        total = keys.agg(F.sum("refs")).first()[0]
        hot = F.broadcast(keys.filter(F.col("refs") > max(HOT_ROWS, total // HOT_BROADCAST_ROWS)))
        rest = rows.join(hot.select(*on), on, "left_anti").join(keys, on)
        held = rows.join(hot, on).unionByName(rest)
    late = F.col("present") == 1
    kind = F.when(late, "late").when(F.col("gone") == 1, "deleted").otherwise("missing")
    held = held.filter(~late | (F.col("since_ms") > F.col("at_ms")))
    # Both sides of the format are UTC whatever the session's zone: days are counted from the epoch.
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("at_ms") / 86_400_000).cast("int"))
    return held.select("ref_table", "ref_id", kind.alias("kind"), F.date_format(day, "yyyy-MM").alias("period")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """(ref_table, period, kind, n_refs): failing references counted by table and month."""
    return found.groupBy("ref_table", "period", "kind").agg(F.count(F.lit(1)).alias("n_refs"))
