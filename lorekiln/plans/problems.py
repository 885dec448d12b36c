"""The registered queries of the general problems 3 and 5, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions.text import normalized_name
from lorekiln.operators import hierarchy as h
from lorekiln.operators import references as r
from lorekiln.session import load


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """References of edges, extracted_edges and entities to keys that are missing, deleted or late."""
    files, entities, gone = load(spark, sf, "files"), load(spark, sf, "entities"), load(spark, sf, "tombstones")
    edges, extracted = load(spark, sf, "edges"), load(spark, sf, "extracted_edges")
    c = F.col
    children = [
        r.Children("edges", edges, c("edge_id"), c("target_id"), "entities", c("created_ms")),
        r.Children("extracted_edges", extracted, c("extract_id"), normalized_name(c("target_name")), "names", c("extracted_ms"), F.trim("target_name") != ""),
        r.Children("entities", entities, c("entity_id"), c("file_id"), "files", c("created_ms")),
    ]
    parents = [
        r.Parents("entities", entities, c("entity_id"), c("created_ms")),
        r.Parents("names", entities, normalized_name(c("name")), c("created_ms")),
        r.Parents("files", files, c("file_id")),
        r.Parents("entities", gone.filter("table_name = 'entities'"), c("key_id"), deleted=True),
        r.Parents("names", gone.filter("table_name = 'entities'"), normalized_name(c("name")), deleted=True),
        r.Parents("files", gone.filter("table_name = 'files'"), c("key_id"), deleted=True),
    ]
    return r.broken_references(children, parents)


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Failing references by table, month and kind."""
    return r.orphan_report(p3_found(spark, sf))


def _tree(spark: SparkSession, sf: str, with_paths: bool = True) -> DataFrame:
    return h.hierarchy(load(spark, sf, "edges").filter("edge_type = 'IMPLEMENTS'"), "source_id", "target_id", with_paths)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of every id in an IMPLEMENTS edge."""
    return _tree(spark, sf, False).select("node_id", "root_id", "depth")


def p5_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Path, depth, root and number of descendants of every id in an IMPLEMENTS edge."""
    return _tree(spark, sf).select("node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"), "n_descendants")


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All descendants of every id in an IMPLEMENTS edge, those on and below cycles too."""
    return h.all_descendants(load(spark, sf, "edges").filter("edge_type = 'IMPLEMENTS'"), "source_id", "target_id")


def p5_other_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Links of ids with several parents that the trees leave out."""
    return h.other_parents(load(spark, sf, "edges").filter("edge_type = 'IMPLEMENTS'"), "source_id", "target_id")


def p5_depth_check(spark: SparkSession, sf: str) -> DataFrame:
    """Exported lineage rows beside the depth that the links give: same, stale, cyclic or unknown."""
    tree = _tree(spark, sf, False).select("node_id", F.col("depth").alias("actual_depth"))
    rows = load(spark, sf, "lineage_nodes").select("lineage_id", "node_id", "depth").join(tree, "node_id", "left")
    same = F.col("depth").eqNullSafe(F.col("actual_depth"))
    status = F.when(F.col("actual_depth").isNull(), "unknown").when(F.col("actual_depth") < 0, "cyclic").when(same, "same").otherwise("stale")
    return rows.select("lineage_id", "node_id", "depth", "actual_depth", status.alias("status"))


QUERIES = (p3_found, p3_report, p5_found, p5_hierarchy, p5_descendants, p5_other_parents, p5_depth_check)

_NAME = r"lower(trim(regexp_replace(regexp_replace({0}, '\.(md|txt|yaml|yml|json)$', '', 'i'), '[_/\\]+', '-', 'g'), E' \t\r\n'))"

_P3 = rf"""
WITH refs AS (
  SELECT 'edges' AS ref_table, edge_id AS ref_id, 'entities' AS parent, target_id AS key, created_ms AS at_ms FROM edges WHERE trim(target_id) <> ''
  UNION ALL SELECT 'extracted_edges', CAST(extract_id AS VARCHAR), 'names', {_NAME.format("target_name")}, extracted_ms FROM extracted_edges WHERE trim(target_name) <> ''
  UNION ALL SELECT 'entities', entity_id, 'files', file_id, created_ms FROM entities WHERE trim(file_id) <> ''),
there AS (
  SELECT 'entities' AS parent, entity_id AS key, min(created_ms) AS since FROM entities GROUP BY ALL
  UNION ALL SELECT 'names', {_NAME.format("name")}, min(created_ms) FROM entities GROUP BY ALL
  UNION ALL SELECT 'files', file_id, NULL FROM files GROUP BY ALL),
gone AS (
  SELECT DISTINCT table_name AS parent, key_id AS key FROM tombstones
  UNION SELECT 'names', {_NAME.format("name")} FROM tombstones WHERE table_name = 'entities')
SELECT DISTINCT ref_table, ref_id,
  CASE WHEN t.key IS NOT NULL THEN 'late' WHEN g.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind,
  strftime(make_timestamp(at_ms * 1000), '%Y-%m') AS period
FROM refs r LEFT JOIN there t ON r.parent = t.parent AND r.key = t.key LEFT JOIN gone g ON r.parent = g.parent AND r.key = g.key
WHERE t.key IS NULL OR t.since > r.at_ms"""

_TREE = """
WITH RECURSIVE links AS (
  SELECT target_id AS node, min(source_id) AS up FROM edges WHERE edge_type = 'IMPLEMENTS' AND source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1),
nodes AS (SELECT node FROM links UNION SELECT up FROM links),
down AS (
  SELECT node, node AS root, 0 AS depth, node AS path FROM nodes WHERE node NOT IN (SELECT node FROM links)
  UNION ALL SELECT l.node, d.root, d.depth + 1, d.path || ' > ' || l.node FROM down d JOIN links l ON l.up = d.node),
lost AS (SELECT node, up FROM links WHERE node NOT IN (SELECT node FROM down)),
reach AS (SELECT node, up AS anc FROM lost UNION SELECT r.node, l.up FROM reach r JOIN lost l ON l.node = r.anc),
ring AS (SELECT node FROM reach WHERE node = anc),
below AS (SELECT node, min(anc) AS root FROM reach WHERE anc IN (SELECT node FROM ring) GROUP BY node),
above AS (SELECT node, node AS anc FROM down UNION ALL SELECT a.node, l.up FROM above a JOIN links l ON l.node = a.anc),
sizes AS (SELECT anc AS node, count(*) - 1 AS n FROM above GROUP BY anc)
"""

ORACLE = {
    "p3_found": _P3,
    "p3_report": f"SELECT ref_table, period, kind, count(*) AS n_refs FROM ({_P3}) GROUP BY ALL",
    "p5_found": _TREE + "SELECT node AS node_id, root AS root_id, depth FROM down UNION ALL SELECT node, root, -1 FROM below",
    "p5_hierarchy": _TREE
    + "SELECT d.node AS node_id, root AS root_id, depth, path, n AS n_descendants FROM down d JOIN sizes s ON s.node = d.node UNION ALL SELECT node, root, -1, NULL, NULL FROM below",
    "p5_descendants": _TREE
    + "SELECT anc AS ancestor_id, node AS descendant_id FROM above WHERE anc <> node UNION ALL SELECT anc, node FROM reach WHERE anc <> node",
    "p5_other_parents": """SELECT DISTINCT target_id AS child_id, source_id AS parent_id, kept AS kept_parent_id FROM edges
JOIN (SELECT target_id, min(source_id) AS kept FROM edges WHERE edge_type = 'IMPLEMENTS' AND source_id IS NOT NULL GROUP BY 1) USING (target_id)
WHERE edge_type = 'IMPLEMENTS' AND source_id <> kept""",
    "p5_depth_check": _TREE
    + """, tree AS (SELECT node, depth FROM down UNION ALL SELECT node, -1 FROM below)
SELECT lineage_id, node_id, l.depth, t.depth AS actual_depth,
  CASE WHEN t.depth IS NULL THEN 'unknown' WHEN t.depth < 0 THEN 'cyclic' WHEN l.depth IS NOT DISTINCT FROM t.depth THEN 'same' ELSE 'stale' END AS status
FROM lineage_nodes l LEFT JOIN tree t ON t.node = l.node_id""",
}
