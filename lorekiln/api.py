"""The thirteen tools of the engine, on one vault and its index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.config import Config
from lorekiln.functions.text import normalized_name
from lorekiln.operators import fusion, graph, lexical, vectors
from lorekiln.operators.embedding import HashProvider
from lorekiln.operators.ingest import ingest
from lorekiln.sources import vault
from lorekiln.sources.store import Store


class Engine:
    """Search, notes and graph of one vault. Results are DataFrames; a missing entity gives suggestions."""

    def __init__(self, spark: SparkSession, config: Config) -> None:
        self.spark, self.config, self.store = spark, config, Store(spark, config.store_dir)

    def _table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _asked(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "query_id int, text string")

    def _found(self, ranked: DataFrame) -> DataFrame:
        files = self._table("files").select("file_id", F.col("path").alias("file_path"))
        rows = ranked.withColumnRenamed("id", "chunk_id").join(self._table("chunks").select("chunk_id", "file_id", "heading_path", "content"), "chunk_id").join(files, "file_id", "left")
        return rows.select("chunk_id", "file_path", "heading_path", "content", "score", "rank").orderBy("rank")

    def _hybrid(self, query: str, k: int) -> DataFrame:
        pool = self.config.pool
        return fusion.rrf([self._keyword(query, pool), self._nearest(query, pool)], k, self.config.k_rrf)

    def _keyword(self, query: str, k: int) -> DataFrame:
        """On the stored index: neither texts nor other terms are read."""
        order = self._table("chunks").select(F.col("chunk_id").alias("id"), F.col("ord").alias("tie"))
        return lexical.index_search(self._table("postings"), self._table("doc_stats"), self._asked(query), "query_id", "text", order, k)

    def _nearest(self, query: str, k: int) -> DataFrame:
        vector = [float(x) for x in HashProvider(self.config.dim)([query])[0]]
        asked = self.spark.createDataFrame([(0, vector)], "query_id int, embedding array<float>")
        return vectors.vector_search(asked, self._table("chunks"), "query_id", "chunk_id", "embedding", k)

    def hybrid_search(self, query: str, k: int = 8) -> DataFrame:
        return self._found(self._hybrid(query, k))

    def keyword_search(self, query: str, k: int = 8) -> DataFrame:
        return self._found(self._keyword(query, k))

    def similar_notes(self, query: str, k: int = 8) -> DataFrame:
        return self._found(self._nearest(query, k))

    def context_for_query(self, query: str, max_tokens: int = 2_000) -> DataFrame:
        docs = self._table("chunks").join(self._table("files").select("file_id", "path"), "file_id", "left")
        return fusion.context_blocks(self._hybrid(query, 15), docs.select(F.col("chunk_id").alias("id"), "path", "heading_path", "content"), max_tokens)

    def graph_hybrid_search(self, query: str, k: int = 8) -> DataFrame:
        """Every found chunk with its fields, once for each of up to five related entity rows, or once without any."""
        tables = [self._table(t) for t in ("entity_chunk_map", "entities", "files", "edges")]
        found = self._found(self._hybrid(query, k)).withColumnRenamed("chunk_id", "id")
        return graph.related_entities(found, *tables).withColumnRenamed("id", "chunk_id").orderBy("rank", "nth")

    def chunks_of(self, path: str) -> DataFrame:
        """The chunks of one note in their order."""
        file = self._table("files").filter(F.col("path") == path).select("file_id")
        return self._table("chunks").join(F.broadcast(file), "file_id").orderBy("chunk_index")

    def chunk(self, chunk_id: str) -> DataFrame:
        """One chunk by its id."""
        return self._table("chunks").filter(F.col("chunk_id") == chunk_id)

    def read_note(self, path: str) -> DataFrame:
        return vault.read_note(self.spark, self.config.vault_dir, path)

    def list_notes(self, prefix: str = "") -> DataFrame:
        return vault.list_notes(self.spark, self.config.vault_dir, prefix)

    def write_note(self, path: str, content: str, overwrite: bool = False) -> dict:
        rel = vault.write_note(self.config.vault_dir, path, content, overwrite)
        return {"success": True, "path": rel, "ingest": ingest(self.spark, self.config, only=rel)}

    def append_note(self, path: str, content: str) -> dict:
        rel = vault.append_note(self.config.vault_dir, path, content)
        return {"success": True, "path": rel, "ingest": ingest(self.spark, self.config, only=rel)}

    def _entity(self, name: str, normalize: bool = False) -> DataFrame:
        asked = self.spark.createDataFrame([(name,)], "name string")
        asked = asked.select(normalized_name(F.col("name")).alias("name")) if normalize else asked
        return graph.lookup(self._table("entities"), asked, "name")

    def suggestions(self, name: str) -> DataFrame:
        """Up to five entities whose names hold what was asked for."""
        return graph.search_names(self._table("entities"), [name], 5)

    def impact_analysis(self, entity_name: str, k: int = 2, edge_types: tuple[str, ...] = graph.STRUCTURAL, direction: str = "both", normalize: bool = False) -> DataFrame:
        if not 1 <= k <= 4:
            raise ValueError("k must be 1 to 4")
        reached = graph.khop(self._table("edges"), self._entity(entity_name, normalize).select("entity_id"), direction, edge_types, k)
        named = graph.with_entities(reached, self._table("entities"), self._table("files"))
        return named.select("name", "type", "path", F.round("influence", 4).alias("influence"), "depth").orderBy(F.desc("influence"), "name")

    def detect_conflicts(self, entity_name: str) -> DataFrame:
        pairs = graph.conflicts(self._table("edges"), self._table("entities"), self._table("files"))
        rows = graph.touching(pairs, self._entity(entity_name).select("entity_id"))
        return rows.select("with_name", "with_type", "with_path", "edge_type", "confidence").orderBy(F.desc("confidence"), "with_name")

    def get_entity_lineage(self, entity_name: str, max_depth: int = 4) -> DataFrame:
        if not 1 <= max_depth <= 6:
            raise ValueError("max_depth must be 1 to 6")
        children = graph.top_children(self._table("edges"), self._table("entities"))
        tree = graph.lineage_trees(children, self._entity(entity_name).select("entity_id"), max_depth)
        names = self._table("entities").select(F.col("entity_id").alias("node_id"), "name", "type")
        return tree.join(names, "node_id", "left").orderBy("position")

    def find_owner(self, entity_name: str) -> DataFrame:
        me = self._entity(entity_name).select("entity_id", "name")
        return me.join(graph.owners(self._table("edges"), self._table("entities")), "entity_id", "left").select("name", "owner", "confidence")

    def answer(self, tool: str, entity_name: str, **options: object) -> dict:
        """What one of the four entity tools says of one entity: a small record, for a single caller.

        ``found`` False with up to five ``suggestions`` if there is no such entity; else the entity, the rows of the
        tool and what goes with them: their number, nested children for a lineage, the size of the graph for an owner.
        """
        tools = {"impact_analysis": self.impact_analysis, "detect_conflicts": self.detect_conflicts, "get_entity_lineage": self.get_entity_lineage, "find_owner": self.find_owner}
        files = self._table("files").select("file_id", "path")
        me = self._entity(entity_name).join(files, "file_id", "left").select("entity_id", "name", "type", "path").orderBy("entity_id").first()
        if me is None:
            names = self.suggestions(entity_name).join(self._table("entities").select("entity_id", "type"), "entity_id").orderBy("name").collect()
            return {"found": False, "suggestions": [{"name": r["name"], "type": r["type"]} for r in names]}
        rows = [r.asDict() for r in tools[tool](entity_name, **options).collect()]
        out = {"found": True, "entity": me.asDict(), "count": len(rows), "rows": rows}
        if tool == "get_entity_lineage":
            nodes = {r["node_id"]: r | {"children": []} for r in rows}
            for r in nodes.values():
                if r["parent_id"] is not None:
                    nodes[r["parent_id"]]["children"].append(r)
            out["tree"] = nodes.get(me["entity_id"])
        if tool == "find_owner":
            out["has_owner"] = any(r["owner"] is not None for r in rows)
            out["graph"] = {"entities": self._table("entities").count(), "edges": self._table("edges").count()}
        return out
