"""Registered queries of evaluation, with their oracle SQL.

Retrieval quality is measured on the vectors: every vector whose vec_id is divisible by 50 asks for its ten nearest,
itself left out; the truth is all other vectors of its label, which is also the category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions.text import normalized_name
from lorekiln.operators import evaluation, graph, vectors
from lorekiln.session import load

_METRICS = [*(f"hit_rate_{k}" for k in (1, 3, 5, 10)), *(f"recall_{k}" for k in (1, 3, 5, 10)), "mrr", "ndcg_5"]


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = load(spark, sf, "embeddings")
    asked = rows.filter("vec_id % 50 = 0")
    near = vectors.vector_search(asked, rows, "vec_id", "vec_id", "embedding", 11).filter("query_id <> id")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    retrieved = near.withColumn("rank", rank).filter("rank <= 10").select("query_id", "id", "rank")
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("category"))
    same = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("category"))
    truth = queries.join(same, "category").filter("query_id <> id").select("query_id", "id")
    return retrieved, truth, queries


def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rate, recall, reciprocal rank and NDCG of every query."""
    found = evaluation.ranking_metrics(*_judged(spark, sf))
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in _METRICS])


def eval_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the metrics by category and over all."""
    retrieved, truth, queries = _judged(spark, sf)
    rows = evaluation.ranking_metrics(retrieved, truth, queries).join(queries, "query_id")
    return evaluation.by_category(rows, "category", ["mrr", "ndcg_5", "recall_10"])


def set_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 of the ten nearest as a set."""
    found = evaluation.set_metrics(*_judged(spark, sf))
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def path_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the words of each entity's name occur in the path of its file."""
    rows = load(spark, sf, "entities").join(load(spark, sf, "files").select("file_id", "path"), "file_id")
    score = evaluation.path_accuracy(F.split("path", r"[-/.]"), F.split("name", "-"))
    return rows.select("entity_id", F.round(score["overlap"], 6).alias("overlap"), score["exact"].alias("exact"))


def _blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineage_nodes").filter("root_id <> node_id").select("root_id", "node_id")
    targets = rows.select("node_id").distinct()
    reached = graph.khop(load(spark, sf, "edges"), targets, "incoming", max_k=3)
    reached = graph.with_entities(reached, load(spark, sf, "entities"), load(spark, sf, "files")).select(F.col("start_id").alias("query_id"), F.col("node_id").alias("id"))
    truth = rows.select(F.col("node_id").alias("query_id"), F.col("root_id").alias("id"))
    return evaluation.set_metrics(reached, truth, targets.withColumnRenamed("node_id", "query_id"))


def blast_radius_f1(spark: SparkSession, sf: str) -> DataFrame:
    """What depends on each exported node within three steps, against the roots whose export lists it."""
    return _blast_radius(spark, sf).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def blast_radius_macro(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the above over all nodes."""
    return evaluation.macro_average(_blast_radius(spark, sf))


def conflict_owner_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Conflict recall and ownership accuracy of the graph against what the notes state.

    Asked is the entity of every note. Expected are the names that its note states as conflicting or superseded, found
    the names at both ends of its conflict edges; expected owners are those stated, found is the most trusted one.
    """
    entities, files, edges = (load(spark, sf, t) for t in ("entities", "files", "edges"))
    note = entities.filter("file_id is not null").groupBy("file_id").agg(F.min("entity_id").alias("query_id"))
    stated = load(spark, sf, "extracted_edges").filter("target_name is not null").join(note, "file_id")
    stated = stated.select("query_id", "edge_type", normalized_name(F.col("target_name")).alias("id"))
    pairs = graph.conflicts(edges, entities, files)
    names = F.explode(F.array("a_name", "b_name")).alias("id")
    found = pairs.select(F.col("a_entity_id").alias("query_id"), names).unionByName(pairs.select(F.col("b_entity_id").alias("query_id"), names))
    truth = stated.filter(F.col("edge_type").isin(*graph.CONFLICTS))
    conflict = evaluation.hit_rate(evaluation.any_hit(found, truth, note.select("query_id")), "conflict_recall")
    truth = stated.filter("edge_type = 'OWNED_BY'")
    found = graph.owners(edges, entities).select(F.col("entity_id").alias("query_id"), F.col("owner").alias("id"))
    owner = evaluation.hit_rate(evaluation.any_hit(found, truth, truth, empty_agrees=False), "ownership_accuracy")
    return conflict.unionByName(owner)


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of event values by type."""
    return evaluation.latency_stats(load(spark, sf, "events"), "event_type", "value")


def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens and cost of all chunks in each mode."""
    total = load(spark, sf, "chunks").agg(F.sum(F.length("content")).alias("chars"))
    out = None
    for mode in evaluation.COSTS:
        tokens, cost = evaluation.token_cost(F.col("chars"), mode)
        one = total.select(F.lit(mode).alias("mode"), tokens.alias("tokens"), cost.alias("cost_usd"))
        out = one if out is None else out.unionByName(one)
    return out


def index_amplification(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of the chunks' texts, of what the index keeps of them (texts, contexts, vectors), and their ratio."""
    raw = F.coalesce(F.octet_length("content"), F.lit(0))
    kept = raw + F.coalesce(F.octet_length("contextualized_content"), F.lit(0)) + F.coalesce(4 * F.greatest(F.size("embedding"), F.lit(0)), F.lit(0))
    sums = load(spark, sf, "chunks").agg(F.count(F.lit(1)).alias("chunks"), F.sum(raw.cast("bigint")).alias("raw_bytes"), F.sum(kept.cast("bigint")).alias("index_bytes"))
    return sums.withColumn("amplification", F.round(F.try_divide("index_bytes", "raw_bytes"), 2))


QUERIES = (ranking_metrics, eval_by_category, set_f1, path_accuracy, blast_radius_f1, blast_radius_macro, conflict_owner_accuracy, latency_percentiles, token_cost, index_amplification)

_NAME = r"lower(trim(regexp_replace(regexp_replace({0}, '\.(md|txt|yaml|yml|json)$', '', 'i'), '[_/\\]+', '-', 'g'), E' \t\r\n'))"

_JUDGED = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(coalesce(list_cosine_similarity(q.v, e.v), 0), 9) DESC, e.vec_id) AS r FROM q, e),
ret AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM s WHERE r <= 11 AND query_id <> id QUALIFY rank <= 10),
truth AS (SELECT q.vec_id AS query_id, e.vec_id AS id FROM q JOIN e ON q.label = e.label AND q.vec_id <> e.vec_id),
n AS (SELECT query_id, count(*) AS t FROM truth GROUP BY 1),
hit AS (SELECT r.* FROM ret r JOIN truth t ON r.query_id = t.query_id AND r.id = t.id),"""

_RANKED = (
    _JUDGED
    + " h AS (SELECT query_id, "
    + ", ".join(f"count(*) FILTER (WHERE rank <= {k}) AS h{k}" for k in (1, 3, 5, 10))
    + """, min(rank) AS first, sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 5) AS dcg FROM hit GROUP BY 1),
m AS (SELECT q.vec_id AS query_id, q.label AS category, """
    + ", ".join(f"CASE WHEN t IS NULL THEN 1 ELSE least(1, CAST(coalesce(h{k}, 0) AS DOUBLE)) END AS hit_rate_{k}, CASE WHEN t IS NULL THEN 1 ELSE least(1, coalesce(h{k}, 0) / t) END AS recall_{k}" for k in (1, 3, 5, 10))
    + """, CASE WHEN t IS NULL THEN 1 ELSE coalesce(1.0 / first, 0) END AS mrr,
  CASE WHEN t IS NULL THEN 1 ELSE coalesce(dcg / list_sum(list_transform(range(1, least(t, 5) + 1), lambda i: 1 / log2(i + 1))), 0) END AS ndcg_5
  FROM q LEFT JOIN n ON n.query_id = q.vec_id LEFT JOIN h ON h.query_id = q.vec_id)"""
)

_SETS = """b AS (SELECT query_id, count(DISTINCT r) AS r, count(DISTINCT t) AS t, count(DISTINCT CASE WHEN r = t THEN r END) AS tp FROM (
  SELECT coalesce(r.query_id, t.query_id) AS query_id, r.id AS r, t.id AS t FROM ret r FULL JOIN truth t ON r.query_id = t.query_id AND r.id = t.id) GROUP BY 1),
p AS (SELECT k.query_id, coalesce(r, 0) AS r, coalesce(t, 0) AS t, coalesce(tp, 0) AS tp FROM keys k LEFT JOIN b ON b.query_id = k.query_id)
SELECT query_id, round(CASE WHEN t = 0 THEN CASE WHEN r = 0 THEN 1 ELSE 0 END WHEN r = 0 THEN 0 ELSE tp / r END, 6) AS precision, round(CASE WHEN t = 0 THEN 1 ELSE tp / t END, 6) AS recall,
  round(CASE WHEN t = 0 THEN CASE WHEN r = 0 THEN 1 ELSE 0 END WHEN tp = 0 THEN 0 ELSE 2 * (tp / r) * (tp / t) / (tp / r + tp / t) END, 6) AS f1 FROM p"""

_BLAST = f"""WITH RECURSIVE pairs AS (SELECT DISTINCT root_id, node_id FROM lineage_nodes WHERE root_id <> node_id), keys AS (SELECT DISTINCT node_id AS query_id FROM pairs),
link AS MATERIALIZED (SELECT target_id AS src, source_id AS dst, max(weight * confidence) AS f FROM edges WHERE edge_type IN ('DEPENDS_ON', 'REFERENCES', 'IMPLEMENTS') GROUP BY ALL),
walk AS (
  SELECT query_id, dst AS node_id, 1 AS depth, f * 0.6 AS score, [query_id, dst] AS path FROM keys JOIN link ON src = query_id
  UNION ALL SELECT query_id, dst, depth + 1, score * f * 0.6, list_append(path, dst) FROM walk JOIN link ON src = node_id WHERE depth < 3 AND NOT list_contains(path, dst)),
best AS (SELECT query_id, node_id, max(score) AS influence FROM walk GROUP BY ALL HAVING max(score) >= 0.05),
ret AS (SELECT DISTINCT query_id, lower(trim(entity_id)) AS id FROM (
  SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY round(influence, 9) DESC, node_id) AS rank FROM best JOIN entities ON entity_id = node_id) WHERE rank <= 30),
truth AS (SELECT node_id AS query_id, lower(trim(root_id)) AS id FROM pairs), scored AS (WITH {_SETS})"""

ORACLE = {
    "ranking_metrics": f"WITH {_RANKED} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)} FROM m",
    "eval_by_category": f"WITH {_RANKED} SELECT category, count(*) AS n, round(avg(mrr), 3) AS mrr, round(avg(ndcg_5), 3) AS ndcg_5, round(avg(recall_10), 3) AS recall_10 FROM m GROUP BY ROLLUP (category)",
    "set_f1": f"WITH {_JUDGED} keys AS (SELECT vec_id AS query_id FROM q), {_SETS}",
    "path_accuracy": r"""WITH x AS (SELECT entity_id, list_transform(string_split_regex(path, '[-/.]'), lambda s: lower(trim(s))) AS r, list_transform(string_split(name, '-'), lambda s: lower(trim(s))) AS t FROM entities JOIN files USING (file_id)),
y AS (SELECT entity_id, CASE WHEN len(t) = 0 THEN 1 ELSE len(list_filter(t, lambda s: list_contains(r, s))) / len(t) END AS o FROM x)
SELECT entity_id, round(o, 6) AS overlap, o >= 1 AS exact FROM y""",
    "blast_radius_f1": f"{_BLAST} SELECT query_id, precision, recall, f1 FROM scored",
    "blast_radius_macro": f"{_BLAST} SELECT count(*) AS items, round(avg(precision), 3) AS precision, round(avg(recall), 3) AS recall, round(avg(f1), 3) AS f1 FROM scored",
    "conflict_owner_accuracy": f"""WITH note AS (SELECT file_id, min(entity_id) AS query_id FROM entities WHERE file_id IS NOT NULL GROUP BY 1),
stated AS (SELECT DISTINCT query_id, edge_type, lower(trim({_NAME.format('target_name')})) AS id FROM extracted_edges JOIN note USING (file_id) WHERE target_name IS NOT NULL),
pair AS (SELECT source_id, target_id, a.name AS a_name, b.name AS b_name FROM edges JOIN entities a ON a.entity_id = source_id JOIN entities b ON b.entity_id = target_id WHERE edge_type IN ('CONFLICTS_WITH', 'SUPERSEDES')),
ends AS (SELECT DISTINCT unnest([source_id, target_id]) AS query_id, a_name, b_name FROM pair),
found AS (SELECT DISTINCT query_id, lower(trim(unnest([a_name, b_name]))) AS id FROM ends),
want AS (SELECT query_id, id FROM stated WHERE edge_type IN ('CONFLICTS_WITH', 'SUPERSEDES')),
c AS (SELECT query_id, EXISTS (SELECT 1 FROM want w JOIN found f ON f.id = w.id AND f.query_id = w.query_id WHERE w.query_id = n.query_id)
  OR (query_id NOT IN (SELECT query_id FROM want) AND query_id NOT IN (SELECT query_id FROM found)) AS hit FROM (SELECT DISTINCT query_id FROM note) n),
own AS (SELECT source_id AS query_id, lower(trim(name)) AS id FROM (
  SELECT source_id, name, row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, target_id) AS r FROM edges JOIN entities ON entity_id = target_id WHERE edge_type = 'OWNED_BY') WHERE r = 1),
o AS (SELECT s.query_id, bool_or(own.id IS NOT NULL AND own.id = s.id) AS hit FROM stated s LEFT JOIN own ON own.query_id = s.query_id WHERE edge_type = 'OWNED_BY' GROUP BY 1)
SELECT 'conflict_recall' AS metric, count(*) AS items, count(*) FILTER (WHERE hit) AS hits, round(avg(CAST(hit AS INTEGER)), 3) AS score FROM c
UNION ALL SELECT 'ownership_accuracy', count(*), count(*) FILTER (WHERE hit), round(avg(CAST(hit AS INTEGER)), 3) FROM o""",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(min(value), 2) AS min, round(max(value), 2) AS max, round(avg(value), 2) AS mean, """
    + ", ".join(f"round(max(CASE WHEN i = least(n - 1, CAST(floor({p} * n / 100) AS BIGINT)) THEN value END), 2) AS p{p}" for p in (50, 95, 99))
    + " FROM r GROUP BY event_type",
    "index_amplification": """WITH c AS (SELECT count(*) AS chunks, CAST(sum(coalesce(strlen(content), 0)) AS BIGINT) AS raw_bytes,
  CAST(sum(coalesce(strlen(content), 0) + coalesce(strlen(contextualized_content), 0) + 4 * coalesce(len(embedding), 0)) AS BIGINT) AS index_bytes FROM chunks)
SELECT chunks, raw_bytes, index_bytes, round(index_bytes / raw_bytes, 2) AS amplification FROM c""",
    "token_cost": """WITH c AS (SELECT CAST(ceil(sum(length(content)) / 4.0) AS BIGINT) AS t FROM chunks)
SELECT 'zero_token' AS mode, CAST(0 AS BIGINT) AS tokens, CAST(0 AS DOUBLE) AS cost_usd FROM c UNION ALL SELECT 'openai_embedding_only', t, round(t / 1000000.0 * 0.02, 5) FROM c UNION ALL SELECT 'llm_graph_extract', t * 4, round(t * 4 / 1000000.0 * 0.3, 4) FROM c""",
}
