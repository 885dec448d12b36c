"""Registered queries of lexical and vector retrieval, fusion and context, with their oracle SQL.

The query set is every evaluation item whose item_id is divisible by 50, with its whole text, against all chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions.tokens import FOLD_FROM, FOLD_TO, match_expression
from lorekiln.operators import fusion, lexical, vectors
from lorekiln.session import durable, load, next_round

COLUMNS = ["content", "contextualized_content"]


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "eval_items").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "chunks").select("chunk_id", "file_id", "heading_path", *COLUMNS, "ord")


def _out(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", F.col("id").alias("chunk_id"), F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def query_sanitise(spark: SparkSession, sf: str) -> DataFrame:
    """Match expressions of all evaluation items."""
    return load(spark, sf, "eval_items").select("item_id", match_expression(F.col("text")).alias("expression"))


def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency and idf of every term of the index."""
    return lexical.term_stats(_chunks(spark, sf), "chunk_id", COLUMNS).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, tokens and average length of the index."""
    return lexical.corpus_stats(_chunks(spark, sf), "chunk_id", COLUMNS).select("n", "total_len", F.round("avgdl", 6).alias("avgdl"))


def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted index: term frequency and positions."""
    found = lexical.postings(_chunks(spark, sf), "chunk_id", COLUMNS)
    return found.select("term", F.col("id").alias("chunk_id"), "col", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 search, top 8."""
    return _out(lexical.keyword_search(_chunks(spark, sf), _asked(spark, sf), "chunk_id", COLUMNS, "query_id", "text", "ord", 8))


def _index(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverted index as a table, whose columns hold repeated terms, ids and places in few bytes, and token counts."""
    # the aggregation gives each partition in the order of its terms
    return next_round(lexical.postings(chunks, "chunk_id", COLUMNS)), durable(lexical.doc_lengths(chunks, "chunk_id", COLUMNS))


def keyword_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same search over the inverted index, whose tables are made first and then read alone."""
    chunks = _chunks(spark, sf)
    index, lengths = _index(chunks)
    order = chunks.select(F.col("chunk_id").alias("id"), F.col("ord").alias("tie"))
    return _out(lexical.index_search(index, lengths, _asked(spark, sf), "query_id", "text", order, 8))


def keyword_phrase_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Headings as phrases, found by the positions that the inverted index holds."""
    chunks = _chunks(spark, sf)
    index, lengths = _index(chunks)
    order = chunks.select(F.col("chunk_id").alias("id"), F.col("ord").alias("tie"))
    return _out(lexical.index_search(index, lengths, _headings(chunks), "query_id", "text", order, 8))


def _headings(chunks: DataFrame) -> DataFrame:
    last = F.regexp_replace(F.trim(F.element_at(F.split("heading_path", " > "), -1)), r"\s+", "_")
    return chunks.filter("ord % 50 = 0 and heading_path is not null").select(F.col("ord").alias("query_id"), last.alias("text"))


def keyword_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 search for headings as phrases: those of the chunks whose ord is divisible by 50."""
    chunks = _chunks(spark, sf)
    return _out(lexical.keyword_search(chunks, _headings(chunks), "chunk_id", COLUMNS, "query_id", "text", "ord", 8))


def hash_embedding_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Hash embedding of every chunk."""
    found = vectors.hash_embedding(_chunks(spark, sf), "chunk_id", "content")
    return found.select(F.col("id").alias("chunk_id"), "bucket", F.round(F.col("weight").cast("double"), 5).alias("weight"))


def hash_search(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest chunks by hash embedding, top 8."""
    return _out(vectors.hash_search(_chunks(spark, sf), _asked(spark, sf), "chunk_id", "content", "query_id", "text", "ord", 8))


def _hybrid(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return fusion.hybrid_search(_chunks(spark, sf), _asked(spark, sf), "chunk_id", COLUMNS, "query_id", "text", "ord", k)


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword and vector search fused by reciprocal rank, top 8."""
    return _out(_hybrid(spark, sf, 8))


def context_for_query(spark: SparkSession, sf: str) -> DataFrame:
    """Context of at most 2,000 estimated tokens from the best 15 chunks of each query."""
    docs = _chunks(spark, sf).join(load(spark, sf, "files").select("file_id", "path"), "file_id", "left")
    blocks = fusion.context_blocks(_hybrid(spark, sf, 15), docs.select(F.col("chunk_id").alias("id"), "path", "heading_path", "content"))
    return blocks.select("query_id", "chunks_count", "estimated_tokens", F.sha2("context", 256).alias("context_sha"))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Exact top 10 by cosine for every vector whose vec_id is divisible by 50, against all."""
    rows = load(spark, sf, "embeddings")
    found = vectors.vector_search(rows.filter("vec_id % 50 = 0"), rows, "vec_id", "vec_id", "embedding", 10)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def vector_cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of the vectors of chunks that repeat a chunk_index of their file with that of the one before by ord.

    Most chunks repeat none and give no row; ``vector_cosine_before`` compares all neighbours of a file.
    """
    from pyspark.sql import Window

    rows = load(spark, sf, "chunks").select("chunk_id", "file_id", "chunk_index", "ord", "embedding")
    before = F.lag("embedding").over(Window.partitionBy("file_id", "chunk_index").orderBy("ord"))
    rows = rows.withColumn("before", before).filter("before is not null")
    return rows.select("chunk_id", F.round(vectors.cosine(F.col("embedding"), F.col("before")), 6).alias("score"))


def vector_cosine_before(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of every chunk's vector with that of the chunk before it in arrival order of its file, if that has one."""
    rows = load(spark, sf, "chunks").select("chunk_id", "file_id", "ord", "embedding")
    rows = vectors.with_previous(rows, "file_id", ["ord", "chunk_id"], "embedding").filter("before is not null")
    return rows.select("chunk_id", F.round(vectors.cosine(F.col("embedding"), F.col("before")), 6).alias("score"))


QUERIES = (
    query_sanitise, bm25_term_stats, bm25_corpus_stats, bm25_postings, keyword_search, keyword_phrase, keyword_search_indexed, keyword_phrase_indexed, hash_embedding_buckets,
    hash_search, hybrid_search, context_for_query, vector_topk, vector_cosine_pairs, vector_cosine_before,
)

_SP = r"\s\x{00A0}\x{FEFF}\p{Z}"


def _tok(c: str) -> str:
    return rf"regexp_extract_all(translate(lower(regexp_replace({c}, '[\x{{0300}}-\x{{036f}}]', '', 'g')), '{FOLD_FROM}', '{FOLD_TO}'), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def _terms(c: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace({c}, '[^\p{{L}}\p{{N}}{_SP}_]', ' ', 'g'), '[{_SP}]+'), lambda t: t <> '')"


_INDEX = f"""
toks AS MATERIALIZED (
  SELECT chunk_id AS id, 0 AS col, coalesce({_tok("content")}, []) AS t FROM chunks
  UNION ALL SELECT chunk_id, 1, coalesce({_tok("contextualized_content")}, []) FROM chunks),
lens AS MATERIALIZED (SELECT id, CAST(sum(len(t)) AS BIGINT) AS dl FROM toks GROUP BY id),
stats AS (SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS total_len, avg(dl) AS avgdl FROM lens)"""

_ASKED = "asked AS (SELECT item_id AS query_id, text FROM eval_items WHERE item_id % 50 = 0)"

_BM25 = f"""
terms AS (SELECT query_id, unnest({_terms("text")}) AS term FROM asked),
phr AS MATERIALIZED (
  SELECT query_id, array_to_string(t, ' ') AS phrase, len(t) AS words, count(*) AS times
  FROM (SELECT query_id, {_tok("term")} AS t FROM terms) WHERE len(t) > 0 GROUP BY ALL),
lengths AS (SELECT DISTINCT words FROM phr),
grams AS (
  SELECT id, words, unnest(list_transform(range(1, len(t) - words + 2), lambda i: array_to_string(t[i:i + words - 1], ' '))) AS phrase
  FROM toks, lengths WHERE len(t) >= words),
hits AS MATERIALIZED (SELECT id, phrase, count(*) AS f FROM grams WHERE phrase IN (SELECT phrase FROM phr) GROUP BY ALL),
df AS (SELECT phrase, count(*) AS df FROM hits GROUP BY 1),
parts AS (
  SELECT id, phrase, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
    * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part
  FROM hits JOIN df USING (phrase) JOIN lens USING (id), stats),
bm AS MATERIALIZED (SELECT query_id, id, -sum(part * times) AS score FROM parts JOIN phr USING (phrase) GROUP BY ALL),
kw AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), ord) AS rank
  FROM bm JOIN (SELECT chunk_id AS id, ord FROM chunks) USING (id))"""


def _hash(source: str) -> str:
    words = rf"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}{_SP}_]', ' ', 'g'), '[{_SP}]+'), lambda w: w <> '')"
    h = "list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(word, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 33 + c) % 4294967296)"
    return f"""(
  WITH w AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest({words}) AS word FROM ({source})) GROUP BY ALL),
  hw AS (SELECT word, {h} AS h FROM (SELECT DISTINCT word FROM w)),
  b AS (SELECT id, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 768 AS INTEGER) AS bucket, sum(n) AS n FROM w JOIN hw USING (word) GROUP BY ALL)
  SELECT id, bucket, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS weight FROM b)"""


_VEC = f"""
hd AS MATERIALIZED {_hash("SELECT chunk_id AS id, content AS text FROM chunks")},
hq AS MATERIALIZED {_hash("SELECT query_id AS id, text FROM asked")},
vs AS (SELECT hq.id AS query_id, hd.id, sum(CAST(hq.weight AS DOUBLE) * CAST(hd.weight AS DOUBLE)) AS score FROM hd JOIN hq USING (bucket) GROUP BY ALL),
vec AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank
  FROM vs JOIN (SELECT chunk_id AS id, ord FROM chunks) USING (id))"""

_FUSED = """
lists AS (SELECT query_id, id, rank, 0 AS list FROM kw WHERE rank <= 30 UNION ALL SELECT query_id, id, rank, 1 FROM vec WHERE rank <= 30),
summed AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS seen FROM lists GROUP BY ALL),
fused AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen) AS rank FROM summed)"""

_TOP = "SELECT query_id, id AS chunk_id, rank, round(score, 6) AS score FROM {0} WHERE rank <= 8"

ORACLE = {
    "query_sanitise": f"SELECT item_id, array_to_string(list_transform({_terms('text')}, lambda t: '\"' || t || '\"'), ' OR ') AS expression FROM eval_items",
    "bm25_term_stats": f"""WITH {_INDEX}, d AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(t) AS term FROM toks) GROUP BY 1)
SELECT term, df, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 6) AS idf FROM d, stats""",
    "bm25_corpus_stats": f"WITH {_INDEX} SELECT n, total_len, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_postings": f"""WITH {_INDEX}, p AS (SELECT id, col, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM toks)
SELECT term, id AS chunk_id, col, count(*) AS tf, array_to_string(list_sort(list(pos)), ' ') AS positions FROM p GROUP BY ALL""",
    "keyword_search": f"WITH {_ASKED}, {_INDEX}, {_BM25} {_TOP.format('kw')}",
    "keyword_phrase": rf"""WITH asked AS (SELECT ord AS query_id, regexp_replace(trim(string_split(heading_path, ' > ')[-1]), '\s+', '_', 'g') AS text FROM chunks WHERE ord % 50 = 0 AND heading_path IS NOT NULL),
{_INDEX}, {_BM25} {_TOP.format('kw')}""",
    "hash_embedding_buckets": f"SELECT id AS chunk_id, bucket, round(CAST(weight AS DOUBLE), 5) AS weight FROM {_hash('SELECT chunk_id AS id, content AS text FROM chunks')}",
    "hash_search": f"WITH {_ASKED}, {_VEC} {_TOP.format('vec')}",
    "hybrid_search": f"WITH {_ASKED}, {_INDEX}, {_BM25}, {_VEC}, {_FUSED} {_TOP.format('fused')}",
    "context_for_query": f"""WITH {_ASKED}, {_INDEX}, {_BM25}, {_VEC}, {_FUSED},
blocks AS (
  SELECT query_id, rank, '### [' || coalesce(path, '') || ']' || CASE WHEN coalesce(heading_path, '') = '' THEN '' ELSE ' > ' || heading_path END || chr(10) || coalesce(content, '') || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS block
  FROM fused JOIN chunks ON chunk_id = id LEFT JOIN files USING (file_id) WHERE rank <= 15),
est AS (SELECT *, CAST(ceil(length(block) / 4.0) AS BIGINT) AS est FROM blocks),
tot AS (SELECT *, sum(est) OVER (PARTITION BY query_id ORDER BY rank) AS total, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM est)
SELECT query_id, count(*) AS chunks_count, CAST(sum(est) AS BIGINT) AS estimated_tokens, sha256(regexp_replace(string_agg(block, '' ORDER BY rank), '^[{_SP}]+|[{_SP}]+$', '', 'g')) AS context_sha FROM tot WHERE nth = 1 OR total <= 2000 GROUP BY 1""",
    "vector_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CASE WHEN len(q.v) = len(e.v) THEN coalesce(list_cosine_similarity(q.v, e.v), 0) ELSE 0 END AS score FROM e q, e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "vector_cosine_pairs": """WITH c AS (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS x, CAST(lag(embedding) OVER (PARTITION BY file_id, chunk_index ORDER BY ord) AS DOUBLE[]) AS y FROM chunks)
SELECT chunk_id, round(CASE WHEN x IS NULL OR len(x) <> len(y) THEN 0 WHEN list_dot_product(x, x) = 0 OR list_dot_product(y, y) = 0 THEN 0 ELSE list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) END, 6) AS score FROM c WHERE y IS NOT NULL""",
    "vector_cosine_before": """WITH c AS (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS x, CAST(lag(embedding) OVER (PARTITION BY file_id ORDER BY ord, chunk_id) AS DOUBLE[]) AS y FROM chunks)
SELECT chunk_id, round(CASE WHEN x IS NULL OR len(x) <> len(y) THEN 0 WHEN list_dot_product(x, x) = 0 OR list_dot_product(y, y) = 0 THEN 0 ELSE list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) END, 6) AS score FROM c WHERE y IS NOT NULL""",
}
ORACLE |= {f"{name}_indexed": ORACLE[name] for name in ("keyword_search", "keyword_phrase")}
