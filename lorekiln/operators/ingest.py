"""Incremental ingest: difference by hash, cut, embed, extract, publish."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekiln.config import Config
from lorekiln.functions.text import ascii_lower
from lorekiln.operators import chunking, extraction, lexical, upsert
from lorekiln.operators.embedding import Contextualizer, Provider, contextualized, embedded
from lorekiln.session import durable
from lorekiln.sources.store import Store
from lorekiln.sources.vault import scan_note, scan_vault

#: Text columns of the inverted index.
INDEXED = ["content", "contextualized_content"]


def _key(*parts: F.Column | str) -> F.Column:
    """A stable id: tasks may run twice, so ids depend on content alone."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def graph_writes(notes: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """What each Markdown note (path, file_id, content) writes into the graph: its own entity, and its links."""
    marked = notes.filter(F.lower("path").endswith(".md") & F.col("content").isNotNull())
    ids = marked.select("path", "file_id")
    own = extraction.note_entities(marked).withColumn("metadata", F.when(F.col("metadata") != "{}", F.col("metadata")))
    own = own.select("path", F.lit(-1).cast("bigint").alias("nth"), "name", "type", "source", "metadata", F.lit(now_ms).alias("created_ms")).join(ids, "path")
    links = extraction.note_edges(marked).join(own.select("path", "file_id", F.col("name").alias("source_name")), "path")
    links = links.select(
        "path", F.col("nth").cast("bigint").alias("nth"), "source_name", "target_name", "edge_type", "weight", "confidence", "source_type", F.lit(now_ms).alias("created_ms"), "file_id"
    )
    return own, links


def graph_tables(own: DataFrame, links: DataFrame, prefer_declared: bool = False) -> dict[str, DataFrame]:
    """Entities and edges from the writes of all notes, as after a cold build.

    Writes apply in path order, a note's own entity before its links. A link to a name resets its type to
    ``document`` unless ``prefer_declared``. No note is read again.
    """
    named = links.select(
        "path", "nth", F.col("target_name").alias("name"), F.lit("document").alias("type"), F.lit("auto_link").alias("source"),
        F.lit(None).cast("string").alias("metadata"), "created_ms", F.lit(None).cast("string").alias("file_id"),
    )
    writes = own.unionByName(named).withColumn("declared", (F.col("nth") < 0) & F.lit(prefer_declared))
    writes = writes.withColumn("entity_id", _key(ascii_lower(F.col("name"))))
    entities = upsert.upsert_entities(writes, ["declared", "path", "nth"]).select("entity_id", "name", "type", "file_id", "source", "metadata", "created_ms")
    edges = links.withColumns({"source_id": _key(ascii_lower(F.col("source_name"))), "target_id": _key(ascii_lower(F.col("target_name")))})
    edges = edges.withColumn("edge_id", _key("source_id", "target_id", "edge_type"))
    edges = upsert.upsert_edges(edges, ["path", "nth"]).select("edge_id", "source_id", "target_id", "edge_type", "weight", "confidence", "source_type", "created_ms")
    return {"entities": entities, "edges": edges}


def ingest(
    spark: SparkSession, config: Config, provider: Provider | None = None, model: str = "", force: bool = False, only: str | None = None,
    notes: DataFrame | None = None, contextualizer: Contextualizer | None = None,
) -> dict[str, int]:
    """Brings the index up to date with the vault and publishes it as a new version; gives the counts.

    Only files whose hash changed are cut, tokenised and extracted, and only chunks with a new hash are embedded; kept
    chunks keep id and vector but get their new index and heading. What is written of chunks and of the inverted index
    are the rows of changed files; ``files``, entities and edges are narrow and written whole. ``only`` reads one note,
    ``notes`` (as ``scan_vault`` gives them) stands for those it holds; both prune nothing. ``force`` treats every file
    as changed. With a ``contextualizer`` fresh chunks are indexed and embedded behind the context that it gives for
    them. Nothing is published if nothing changed.
    """
    store, now_ms = Store(spark, config.store_dir), int(time.time() * 1000)
    base = (store.versions() or [0])[-1]
    partly = only is not None or notes is not None
    if notes is None:
        notes = scan_note(spark, config.vault_dir, only) if only else scan_vault(spark, config.vault_dir)
    scope = notes.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    manifest = store.manifest()
    old_files = store._current("files", manifest)
    before = old_files.select("path", F.lit("").alias("hash") if force else F.col("file_hash").alias("hash"))
    diff = upsert.diff_files(before.join(scope.select("path"), "path", "left_semi") if partly else before, scope.select("path", "hash"))
    diff = durable(diff)
    counts = {r["status"]: r["n"] for r in upsert.counted(diff).collect()}
    stats = {"files_scanned": sum(v for k, v in counts.items() if k != "deleted")}
    stats |= {f"files_{k}": counts.get(k, 0) for k in ("new", "updated", "unchanged", "deleted")}
    if not any(counts.get(k) for k in ("new", "updated", "deleted")):
        return stats | {"chunks_new": 0, "chunks_kept": 0, "chunks_deleted": 0}

    segment = F.lit(uuid.uuid4().hex)
    changed = diff.filter("status in ('new', 'updated')").select("path")
    touched = durable(scope.join(changed, "path").withColumn("file_id", _key("path")))
    new_files = touched.select("file_id", "path", F.col("hash").alias("file_hash"), "mtime_ms", F.lit(now_ms).alias("updated_ms"), segment.alias("segment"))
    files = durable(old_files.join(diff.filter("status <> 'unchanged'").select("path"), "path", "left_anti").select(*new_files.columns).unionByName(new_files))

    cut = chunking.chunk_notes(touched.select("path", "content"), config.chunk_chars, config.overlap_chars)
    cut = cut.withColumns({"file_id": _key("path"), "content_hash": F.sha2("content", 256)})
    # repeated contents of one file are told apart by their place among themselves
    nth = F.row_number().over(Window.partitionBy("file_id", "content_hash").orderBy("chunk_index"))
    cut = durable(cut.withColumn("nth", nth).withColumn("chunk_id", _key("file_id", "content_hash", F.col("nth").cast("string"))).drop("nth", "path"))
    lost = diff.filter("status in ('updated', 'deleted')").join(old_files.select("path", "file_id"), "path").select("file_id")
    old_chunks = store._current("chunks", manifest)
    replaced = old_chunks.join(lost, "file_id", "left_semi")
    kept = cut.join(replaced.select("chunk_id", "contextualized_content", "embedding", "embedding_model", "created_ms", "ord"), "chunk_id")
    fresh = cut.join(replaced.select("chunk_id"), "chunk_id", "left_anti")
    fresh = contextualized(fresh, touched, contextualizer) if contextualizer else fresh.withColumn("contextualized_content", F.lit(None).cast("string"))
    vectors = embedded(fresh.withColumn("text", F.coalesce("contextualized_content", "content")), "chunk_id", "text", config.dim, provider, model).withColumnRenamed("id", "chunk_id")
    last = old_chunks.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
    fresh = durable(fresh.join(vectors, "chunk_id"))
    # arrival order: unique and ascending with the version
    fresh = fresh.withColumns({"created_ms": F.lit(now_ms), "ord": F.monotonically_increasing_id() + F.lit(last + 1)})
    columns = [c for c in old_chunks.columns if c != "segment"]
    chunks = durable(kept.select(*columns).unionByName(fresh.select(*columns)))
    stats |= {"chunks_new": fresh.count(), "chunks_kept": kept.count()}
    stats["chunks_deleted"] = replaced.join(cut.select("chunk_id"), "chunk_id", "left_anti").count()

    own, links = (durable(w) for w in graph_writes(touched.select("path", "file_id", "content"), now_ms))
    names = own.select("file_id", _key(ascii_lower(F.col("name"))).alias("entity_id"))
    added = {"chunks": chunks, "entity_chunk_map": names.join(chunks.select("file_id", "chunk_id"), "file_id").select("entity_id", "chunk_id", "file_id").distinct()}
    added |= {"entity_writes": own, "link_writes": links} | index_tables(chunks)
    added = {name: rows.withColumn("segment", segment) for name, rows in added.items()}
    current = files.select("file_id", "segment")

    def everything(name: str, new: DataFrame) -> DataFrame:
        return store._current(name, manifest).join(current, ["file_id", "segment"], "left_semi").drop("segment").unionByName(new)

    graph = graph_tables(everything("entity_writes", own), everything("link_writes", links))
    store.publish({"files": files} | graph, added, base)
    return stats


def index_tables(chunks: DataFrame) -> dict[str, DataFrame]:
    """The inverted index of chunks: postings sorted by term, so that a search reads few of them, and token counts.

    A chunk without context is indexed with its content in both columns.
    """
    docs = chunks.withColumn("contextualized_content", F.coalesce("contextualized_content", "content"))
    about = chunks.select(F.col("chunk_id").alias("id"), "file_id")
    postings = lexical.postings(docs, "chunk_id", INDEXED).withColumn("col", F.col("col").cast("int")).join(about, "id")
    lengths = lexical.doc_lengths(docs, "chunk_id", INDEXED).join(about, "id")
    return {"postings": postings.select("term", "id", "col", "tf", "positions", "file_id").repartitionByRange("term").sortWithinPartitions("term"), "doc_stats": lengths.select("id", "dl", "file_id")}
