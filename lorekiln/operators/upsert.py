"""Ordered upserts, deletes with their cascades, and snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import ascii_lower, normalized_name


def upsert_entities(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each name (case of A to Z aside): id, name and time of the first write, type and source of the
    last, file_id and metadata of the last write that has them, number of writes. ``order`` must be total."""
    seq = F.struct(*order)

    def last(c: str, only_set: bool = False):
        value = F.when(F.col(c).isNotNull(), seq) if only_set else seq
        return F.max_by(c, value).alias(c)

    first = [F.min_by(c, seq).alias(c) for c in ("entity_id", "name", "created_ms")]
    kept = [last("type"), last("source"), last("file_id", True), last("metadata", True)]
    return rows.filter("name is not null").groupBy(ascii_lower(F.col("name")).alias("name_key")).agg(*first, *kept, F.count(F.lit(1)).alias("writes"))


def upsert_edges(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each (source, target, type): id and time of the first write, the rest of the last."""
    seq = F.struct(*order)
    first = [F.min_by(c, seq).alias(c) for c in ("edge_id", "created_ms")]
    last = [F.max_by(c, seq).alias(c) for c in ("weight", "confidence", "source_type")]
    return rows.groupBy("source_id", "target_id", "edge_type").agg(*first, *last, F.count(F.lit(1)).alias("writes"))


def resolve_edges(extracted: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type, weight, confidence, source_type, extracted_ms): extracted links with ids.

    The source is the entity of the note's file (the smallest id, if several); the target the entity of that
    normalised name, else a placeholder whose id is a hash of the name. Links of notes without entity are left out.
    """
    owners = entities.filter("file_id is not null").groupBy("file_id").agg(F.min("entity_id").alias("source_id"))
    names = entities.filter("name is not null").groupBy(normalized_name(F.col("name")).alias("key")).agg(F.min("entity_id").alias("known"))
    rows = extracted.withColumn("key", normalized_name(F.col("target_name"))).filter("key != ''").drop("target_name").distinct()
    rows = rows.join(owners, "file_id").join(names, "key", "left")
    target = F.coalesce("known", F.substring(F.sha2("key", 256), 1, 16))
    return rows.select("source_id", target.alias("target_id"), "edge_type", "weight", "confidence", "source_type", "extracted_ms")


def delete_files(gone: DataFrame, files: DataFrame, chunks: DataFrame, entities: DataFrame, edges: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting the files whose ids are in ``gone``, with everything that hangs on them.

    Chunks and entities of the files go, then edges from or to those entities, and entity-chunk links of either.
    """
    key = gone.select(F.col(gone.columns[0]).alias("file_id")).distinct()
    lost_entities = entities.join(key, "file_id", "left_semi").select("entity_id").distinct()
    lost_chunks = chunks.join(key, "file_id", "left_semi").select("chunk_id").distinct()
    kept_edges = edges.join(lost_entities.withColumnRenamed("entity_id", "source_id"), "source_id", "left_anti").join(lost_entities.withColumnRenamed("entity_id", "target_id"), "target_id", "left_anti")
    return {
        "files": files.join(key, "file_id", "left_anti"),
        "chunks": chunks.join(key, "file_id", "left_anti"),
        "entities": entities.join(key, "file_id", "left_anti"),
        "edges": kept_edges.select(*edges.columns),
        "entity_chunk_map": links.join(lost_entities, "entity_id", "left_anti").join(lost_chunks, "chunk_id", "left_anti").select(*links.columns),
    }


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): new, updated, unchanged or deleted, by hash, from (path, hash) of either side."""
    o = old.select("path", F.col("hash").alias("old_hash"))
    n = new.select("path", F.col("hash").alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    return o.join(n, "path", "full_outer").select("path", status.alias("status"))


def diff_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, content_hash, status): kept, new or deleted distinct chunk hashes of each file."""
    key = ["file_id", "content_hash"]
    sides = old.select(*key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*key, F.lit(0).alias("o"), F.lit(1).alias("n")))
    both = sides.groupBy(*key).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    status = F.when(F.col("o") + F.col("n") == 2, "kept").when(F.col("n") == 1, "new").otherwise("deleted")
    return both.select(*key, status.alias("status"))


def counted(diff: DataFrame) -> DataFrame:
    """(status, n) of a difference."""
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
