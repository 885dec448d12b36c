"""Registered queries of the entity graph, with their oracle SQL.

Start nodes are the nodes of the lineage rows whose lineage_id is divisible by 50; searches run against all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.operators import fusion, graph, upsert
from lorekiln.plans import retrieval
from lorekiln.session import load


def _starts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineage_nodes").filter("lineage_id % 50 = 0").select("node_id").distinct()


def _khop(spark: SparkSession, sf: str, direction: str) -> DataFrame:
    reached = graph.khop(load(spark, sf, "edges"), _starts(spark, sf), direction, max_k=2)
    out = graph.with_entities(reached, load(spark, sf, "entities"), load(spark, sf, "files"))
    return out.select("start_id", F.col("node_id").alias("entity_id"), "name", "type", "path", F.round("influence", 6).alias("influence"), F.col("depth").cast("bigint").alias("depth"))


def khop_outgoing(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that a start depends on, within two steps."""
    return _khop(spark, sf, "outgoing")


def khop_incoming(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that depend on a start, within two steps."""
    return _khop(spark, sf, "incoming")


def khop_both(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of a start in either direction, within two steps."""
    return _khop(spark, sf, "both")


def khop_growing(spark: SparkSession, sf: str) -> DataFrame:
    """Influence over two outgoing steps that may each grow (a decay of 2.5), so that simple paths are enumerated."""
    reached = graph.khop(load(spark, sf, "edges"), _starts(spark, sf), "outgoing", max_k=2, gamma=2.5)
    return reached.select("start_id", F.col("node_id").alias("entity_id"), F.round("influence", 6).alias("influence"), F.col("depth").cast("bigint").alias("depth"))


def conflicts_touching(spark: SparkSession, sf: str) -> DataFrame:
    """Conflicts and supersessions at either end of which a start node stands, seen from that node."""
    pairs = graph.conflicts(load(spark, sf, "edges"), load(spark, sf, "entities"), load(spark, sf, "files"))
    return graph.touching(pairs, load(spark, sf, "lineage_nodes").select("node_id"))


def impact_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Names looked up without case, then influence in both directions to 4 places."""
    entities = load(spark, sf, "entities")
    asked = load(spark, sf, "lineage_nodes").filter("lineage_id % 50 = 0").select(F.upper("name").alias("name"))
    starts = graph.lookup(entities, asked, "name")
    reached = graph.khop(load(spark, sf, "edges"), starts.select("entity_id"), "both", max_k=2)
    out = graph.with_entities(reached, entities, load(spark, sf, "files"))
    return out.select(F.col("start_id").alias("source_id"), "name", "type", "path", F.round("influence", 4).alias("influence"), F.col("depth").cast("bigint").alias("depth"))


def detect_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """All conflicts and supersessions with both ends."""
    return graph.conflicts(load(spark, sf, "edges"), load(spark, sf, "entities"), load(spark, sf, "files"))


def find_owner(spark: SparkSession, sf: str) -> DataFrame:
    """Owner of every owned entity."""
    return graph.owners(load(spark, sf, "edges"), load(spark, sf, "entities"))


def entity_lookup_nocase(spark: SparkSession, sf: str) -> DataFrame:
    """Every extracted target name that names an entity but for case."""
    return graph.lookup(load(spark, sf, "entities"), load(spark, sf, "extracted_edges"), "target_name").select("asked", "entity_id", "name", "type")


#: Patterns of the substring search; % and _ are wildcards.
PATTERNS = ["svc-", "TEAM", "doc-%index", "api_", "schema", "a_b"]


def entity_search_like(spark: SparkSession, sf: str) -> DataFrame:
    """The first 10 names that hold each pattern."""
    return graph.search_names(load(spark, sf, "entities"), PATTERNS)


def lineage_edges_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes within four steps over each node's ten heaviest links."""
    children = graph.top_children(load(spark, sf, "edges"), load(spark, sf, "entities"))
    return graph.lineage_reach(children, _starts(spark, sf), 4).withColumn("depth", F.col("depth").cast("bigint"))


def lineage_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Pre-order lineage of each start, four steps deep, every node once."""
    entities = load(spark, sf, "entities")
    tree = graph.lineage_trees(graph.top_children(load(spark, sf, "edges"), entities), _starts(spark, sf), 4)
    names = entities.select(F.col("entity_id").alias("node_id"), "name", "type")
    return tree.join(names, "node_id", "left").select("root_id", "position", "node_id", F.coalesce("name", "node_id").alias("name"), F.coalesce("type", F.lit("document")).alias("type"), "parent_id", "edge_type", "depth")


def graph_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search, every found chunk with its fields and up to five related entity rows, or one without any."""
    chunks = retrieval._chunks(spark, sf)
    ranked = fusion.hybrid_search(chunks, retrieval._asked(spark, sf), "chunk_id", retrieval.COLUMNS, "query_id", "text", "ord", 8)
    files = load(spark, sf, "files")
    about = chunks.join(files.select("file_id", F.col("path").alias("file_path")), "file_id", "left")
    ranked = ranked.join(about.select(F.col("chunk_id").alias("id"), "file_path", "heading_path", F.sha2("content", 256).alias("content_sha")), "id")
    found = graph.related_entities(ranked, load(spark, sf, "entity_chunk_map"), load(spark, sf, "entities"), files, load(spark, sf, "edges"))
    return found.select(
        "query_id", F.col("id").alias("chunk_id"), F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"), "file_path", "heading_path", "content_sha",
        F.col("nth").cast("bigint").alias("nth"), "entity_id", "name", "type", "path", "edge_type", "influence",
    )


def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the index tables."""
    out = None
    for t in ("files", "chunks", "entities", "edges", "entity_chunk_map"):
        one = load(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def upsert_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities after applying all rows in time order."""
    return upsert.upsert_entities(load(spark, sf, "entities"), ["created_ms", "entity_id"])


def upsert_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges after applying all rows in time order."""
    return upsert.upsert_edges(load(spark, sf, "edges"), ["created_ms", "edge_id", "weight", "confidence", "source_type"])


def resolve_extracted_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted links with the ids of their ends."""
    return upsert.resolve_edges(load(spark, sf, "extracted_edges").drop("extract_id"), load(spark, sf, "entities"))


def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left in each table after deleting the files listed as deleted."""
    gone = load(spark, sf, "tombstones").filter("table_name = 'files'").select("key_id")
    left = upsert.delete_files(gone, *[load(spark, sf, t) for t in ("files", "chunks", "entities", "edges", "entity_chunk_map")])
    out = None
    for t, rows in left.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = (
    khop_outgoing, khop_incoming, khop_both, khop_growing, conflicts_touching, impact_analysis, detect_conflicts, find_owner, entity_lookup_nocase, entity_search_like,
    lineage_edges_bounded, lineage_tree, graph_hybrid_search, graph_counts, upsert_entities, upsert_edges, resolve_extracted_edges, cascade_delete,
)

_STARTS = "starts AS (SELECT DISTINCT node_id AS start_id FROM lineage_nodes WHERE lineage_id % 50 = 0)"


def _walk(direction: str, starts: str = _STARTS) -> str:
    """Enumeration of simple paths."""
    rows = "FROM edges WHERE edge_type IN ('DEPENDS_ON', 'REFERENCES', 'IMPLEMENTS')"
    out, back = f"SELECT source_id AS src, target_id AS dst, weight * confidence AS f {rows}", f"SELECT target_id, source_id, weight * confidence {rows}"
    link = {"outgoing": out, "incoming": f"SELECT src AS dst, dst AS src, f FROM ({out})", "both": f"{out} UNION ALL {back}"}[direction]
    drop = "AND node_id <> start_id" if direction == "both" else ""
    return f"""WITH RECURSIVE {starts}, link AS MATERIALIZED (SELECT DISTINCT src, dst, f FROM ({link})),
walk AS (
  SELECT start_id, dst AS node_id, 1 AS depth, f * 0.6 AS score, [start_id, dst] AS path FROM starts JOIN link ON src = start_id
  UNION ALL SELECT start_id, dst, depth + 1, score * f * 0.6, list_append(path, dst) FROM walk JOIN link ON src = node_id WHERE depth < 2 AND NOT list_contains(path, dst)),
best AS (SELECT start_id, node_id, max(score) AS influence, min(depth) AS depth FROM walk GROUP BY ALL HAVING max(score) >= 0.05),
named AS (
  SELECT b.*, e.name, e.type, f.path, row_number() OVER (PARTITION BY start_id ORDER BY round(influence, 9) DESC, node_id) AS rank
  FROM best b JOIN entities e ON e.entity_id = node_id LEFT JOIN files f USING (file_id) WHERE true {drop})"""


_KHOP = " SELECT start_id, node_id AS entity_id, name, type, path, round(influence, 6) AS influence, CAST(depth AS BIGINT) AS depth FROM named WHERE rank <= 30"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NAME = r"lower(trim(regexp_replace(regexp_replace({0}, '\.(md|txt|yaml|yml|json)$', '', 'i'), '[_/\\]+', '-', 'g'), E' \t\r\n'))"

_PAIRS = """SELECT DISTINCT a.entity_id AS a_entity_id, a.name AS a_name, a.type AS a_type, fa.path AS a_path, b.entity_id AS b_entity_id, b.name AS b_name, b.type AS b_type, fb.path AS b_path, edge_type, confidence
FROM edges e JOIN entities a ON a.entity_id = source_id JOIN entities b ON b.entity_id = target_id LEFT JOIN files fa ON fa.file_id = a.file_id LEFT JOIN files fb ON fb.file_id = b.file_id
WHERE edge_type IN ('CONFLICTS_WITH', 'SUPERSEDES')"""

ORACLE = {
    "khop_growing": _walk("outgoing").replace("f * 0.6", "f * 2.5") + " SELECT start_id, node_id AS entity_id, round(influence, 6) AS influence, CAST(depth AS BIGINT) AS depth FROM best",
    "conflicts_touching": f"""WITH p AS ({_PAIRS}), me AS (SELECT DISTINCT node_id AS me FROM lineage_nodes WHERE node_id IS NOT NULL)
SELECT me, CASE WHEN a_entity_id = me THEN b_entity_id ELSE a_entity_id END AS with_entity_id, CASE WHEN a_entity_id = me THEN b_name ELSE a_name END AS with_name,
  CASE WHEN a_entity_id = me THEN b_type ELSE a_type END AS with_type, CASE WHEN a_entity_id = me THEN b_path ELSE a_path END AS with_path, edge_type, confidence
FROM p JOIN me ON a_entity_id = me OR b_entity_id = me""",
    "khop_outgoing": _walk("outgoing") + _KHOP,
    "khop_incoming": _walk("incoming") + _KHOP,
    "khop_both": _walk("both") + _KHOP,
    "impact_analysis": _walk(
        "both", f"starts AS (SELECT DISTINCT entity_id AS start_id FROM entities e JOIN lineage_nodes l ON lineage_id % 50 = 0 AND {_LOW.format('e.name')} = {_LOW.format('upper(l.name)')})"
    )
    + " SELECT start_id AS source_id, name, type, path, round(influence, 4) AS influence, CAST(depth AS BIGINT) AS depth FROM named WHERE rank <= 30",
    "detect_conflicts": _PAIRS,
    "find_owner": """SELECT entity_id, owner_id, owner, confidence FROM (
  SELECT source_id AS entity_id, target_id AS owner_id, name AS owner, confidence, row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, target_id) AS r
  FROM edges JOIN entities t ON t.entity_id = target_id WHERE edge_type = 'OWNED_BY') WHERE r = 1""",
    "entity_lookup_nocase": f"SELECT asked, entity_id, name, type FROM (SELECT DISTINCT target_name AS asked FROM extracted_edges WHERE target_name IS NOT NULL) JOIN entities ON {_LOW.format('name')} = {_LOW.format('asked')}",
    "entity_search_like": "SELECT pattern, entity_id, name FROM (SELECT pattern, entity_id, name, row_number() OVER (PARTITION BY pattern ORDER BY name, entity_id) AS r FROM entities, (SELECT unnest(["
    + ", ".join(f"'{p}'" for p in PATTERNS)
    + f"]) AS pattern) WHERE {_LOW.format('name')} LIKE '%' || lower(pattern) || '%') WHERE r <= 10",
    "lineage_edges_bounded": f"""WITH RECURSIVE {_STARTS},
kid AS (
  SELECT src, dst FROM (
    SELECT source_id AS src, target_id AS dst, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id, edge_type) AS place
    FROM (SELECT DISTINCT source_id, target_id, edge_type, weight FROM edges WHERE edge_type IN ('DEPENDS_ON', 'REFERENCES', 'IMPLEMENTS'))
    WHERE target_id IN (SELECT entity_id FROM entities)) WHERE place <= 10),
walk AS (SELECT start_id AS root_id, start_id AS node_id, 0 AS depth FROM starts UNION SELECT root_id, dst, depth + 1 FROM walk JOIN kid ON src = node_id WHERE depth < 4)
SELECT root_id, node_id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY ALL""",
    "graph_hybrid_search": f"""WITH {retrieval._ASKED}, {retrieval._INDEX}, {retrieval._BM25}, {retrieval._VEC}, {retrieval._FUSED},
rel AS (
  SELECT chunk_id, entity_id, name, type, path, coalesce(edge_type, 'REFERENCES') AS edge_type, weight AS influence,
    row_number() OVER (PARTITION BY chunk_id ORDER BY entity_id, edge_type NULLS FIRST, target_id NULLS FIRST, weight NULLS FIRST) AS nth
  FROM (SELECT DISTINCT * FROM entity_chunk_map) m JOIN entities USING (entity_id) LEFT JOIN files USING (file_id)
    LEFT JOIN (SELECT DISTINCT source_id, target_id, edge_type, weight FROM edges) e ON e.source_id = entity_id)
SELECT query_id, id AS chunk_id, rank, round(score, 6) AS score, f.path AS file_path, heading_path, sha256(content) AS content_sha, nth, entity_id, name, type, rel.path, edge_type, influence
FROM fused JOIN chunks c ON c.chunk_id = id LEFT JOIN files f USING (file_id) LEFT JOIN rel ON rel.chunk_id = id AND nth <= 5 WHERE rank <= 8""",
    "graph_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("files", "chunks", "entities", "edges", "entity_chunk_map")),
    "upsert_entities": f"""SELECT {_LOW.format('name')} AS name_key, arg_min(entity_id, s) AS entity_id, arg_min(name, s) AS name, arg_min(created_ms, s) AS created_ms, arg_max(type, s) AS type, arg_max(source, s) AS source,
  arg_max(file_id, s) FILTER (WHERE file_id IS NOT NULL) AS file_id, arg_max(metadata, s) FILTER (WHERE metadata IS NOT NULL) AS metadata, count(*) AS writes
FROM (SELECT *, row_number() OVER (ORDER BY created_ms, entity_id) AS s FROM entities WHERE name IS NOT NULL) GROUP BY 1""",
    "upsert_edges": """SELECT source_id, target_id, edge_type, arg_min(edge_id, s) AS edge_id, arg_min(created_ms, s) AS created_ms, arg_max(weight, s) AS weight, arg_max(confidence, s) AS confidence, arg_max(source_type, s) AS source_type, count(*) AS writes
FROM (SELECT *, row_number() OVER (ORDER BY created_ms, edge_id, weight, confidence, source_type) AS s FROM edges) GROUP BY ALL""",
    "resolve_extracted_edges": f"""WITH o AS (SELECT file_id, min(entity_id) AS source_id FROM entities WHERE file_id IS NOT NULL GROUP BY 1),
n AS (SELECT {_NAME.format('name')} AS key, min(entity_id) AS known FROM entities WHERE name IS NOT NULL GROUP BY 1),
x AS (SELECT DISTINCT file_id, {_NAME.format('target_name')} AS key, edge_type, weight, confidence, source_type, extracted_ms FROM extracted_edges)
SELECT source_id, coalesce(known, substr(sha256(key), 1, 16)) AS target_id, edge_type, weight, confidence, source_type, extracted_ms FROM x JOIN o USING (file_id) LEFT JOIN n USING (key) WHERE key <> ''""",
    "cascade_delete": """WITH g AS (SELECT DISTINCT key_id AS file_id FROM tombstones WHERE table_name = 'files'),
le AS (SELECT entity_id FROM entities WHERE file_id IN (SELECT file_id FROM g)), lc AS (SELECT chunk_id FROM chunks WHERE file_id IN (SELECT file_id FROM g))
SELECT 'files' AS table_name, count(*) AS n FROM files WHERE file_id NOT IN (SELECT file_id FROM g)
UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM lc)
UNION ALL SELECT 'entities', count(*) FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM le)
UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_id NOT IN (SELECT entity_id FROM le) AND target_id NOT IN (SELECT entity_id FROM le)
UNION ALL SELECT 'entity_chunk_map', count(*) FROM entity_chunk_map WHERE entity_id NOT IN (SELECT entity_id FROM le) AND chunk_id NOT IN (SELECT chunk_id FROM lc)""",
}
