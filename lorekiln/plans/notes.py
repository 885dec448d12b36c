"""Registered queries of note text: cleaning, sections, chunks, extraction, snapshots; with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions.text import normalized_name, token_estimate, without_inline_images
from lorekiln.operators import chunking, extraction, upsert
from lorekiln.session import load


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content), one row a document: the path is made unique by the id."""
    path = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.coalesce("note_path", F.lit("note.md")))
    return load(spark, sf, "documents").select(path.alias("path"), F.col("text").alias("content"))


def clean_base64_images(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks without inline images: length and hash of what is left."""
    text = without_inline_images(F.col("content"))
    return load(spark, sf, "chunks").select("chunk_id", F.length(text).cast("bigint").alias("chars"), F.sha2(text, 256).alias("sha"))


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Real content hash of every chunk, and whether the stored one agrees."""
    sha = F.sha2("content", 256)
    return load(spark, sf, "chunks").select("chunk_id", sha.alias("sha"), (sha == F.col("content_hash")).alias("agrees"))


def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated tokens of every chunk."""
    return load(spark, sf, "chunks").select("chunk_id", token_estimate(F.col("content")).alias("tokens"))


def heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of every document below their headings."""
    rows = _notes(spark, sf).filter("content is not null").select("path", F.posexplode(chunking.heading_sections(F.col("content"))).alias("section", "s"))
    return rows.select("path", F.col("section").cast("bigint").alias("section"), F.col("s.path").alias("heading_path"), F.sha2("s.content", 256).alias("sha"))


def chunk_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of every document."""
    return chunking.chunk_notes(_notes(spark, sf))


def normalize_entity_name(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised target names as extracted."""
    return load(spark, sf, "extracted_edges").filter("target_name is not null").select("extract_id", normalized_name(F.col("target_name")).alias("name"))


def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    """Wikilink and note-link targets of every document."""
    rows = _notes(spark, sf).select("path", F.posexplode(extraction.link_targets(F.col("content"))).alias("nth", "target"))
    return rows.select("path", F.col("nth").cast("bigint").alias("nth"), "target")


def note_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entity of every document, with type and metadata."""
    return extraction.note_entities(_notes(spark, sf).filter("content is not null"))


def infer_entity_type(spark: SparkSession, sf: str) -> DataFrame:
    """Type that the path of every file tells."""
    return load(spark, sf, "files").select("file_id", extraction.entity_type(F.lit(""), F.concat(F.lit("/"), F.col("path"))).alias("type"))


def frontmatter_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Links that the frontmatter of every document states."""
    return extraction.frontmatter_edges(_notes(spark, sf)).drop("nth")


def extract_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """All links of every document, stated and written."""
    return extraction.note_edges(_notes(spark, sf)).drop("nth")


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All documents as two states of a vault: some only in one, some edited."""
    docs = load(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    edited = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 7 <> 0").withColumn("text", edited)


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.sha2("text", 256).alias("hash"))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("path").alias("file_id"), F.explode(F.split("text", "\n\n")).alias("content")).select("file_id", F.sha2("content", 256).alias("content_hash"))


def diff_files(spark: SparkSession, sf: str) -> DataFrame:
    """Status of every file between two states of the vault."""
    old, new = _snapshots(spark, sf)
    return upsert.diff_files(_hashed(old), _hashed(new))


def diff_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Status of every paragraph between two states of the vault."""
    old, new = _snapshots(spark, sf)
    return upsert.diff_chunks(_lines(old), _lines(new))


def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of both differences."""
    files = upsert.counted(diff_files(spark, sf)).select(F.lit("files").alias("what"), "status", "n")
    return files.unionByName(upsert.counted(diff_chunks(spark, sf)).select(F.lit("chunks").alias("what"), "status", "n"))


def list_notes_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Notes below runbooks/, with size and ISO time."""
    rows = load(spark, sf, "files").filter(F.col("path").startswith("runbooks/"))
    return rows.select("path", F.date_format(F.timestamp_millis("mtime_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("mtime"))


def appended(existing: Column, more: Column) -> Column:
    """A note with text appended: one line break if it ends in one, else a blank line between."""
    gap = F.when(existing.endswith("\n"), "\n").otherwise("\n\n")
    return F.when(existing.isNull(), more).otherwise(F.concat(existing, gap, more))


def append_separator(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with a line appended."""
    return load(spark, sf, "documents").select("doc_id", F.sha2(appended(F.col("text"), F.lit("## Appended")), 256).alias("sha"))


QUERIES = (
    clean_base64_images, content_hash, token_estimates, heading_sections, chunk_notes, normalize_entity_name, extract_links, note_entities,
    infer_entity_type, frontmatter_edges, extract_graph_edges, diff_files, diff_chunks, ingest_stats, list_notes_prefix, append_separator,
)

_W = r"[\s\x{00A0}\x{FEFF}\p{Z}]"
_NAME = rf"lower(regexp_replace(regexp_replace(regexp_replace({{0}}, '\.(md|txt|yaml|yml|json)$', '', 'i'), '[_/\\]+', '-', 'g'), '^{_W.replace('{', '{{').replace('}', '}}')}+|{_W.replace('{', '{{').replace('}', '}}')}+$', '', 'g'))"
_IMG = r"""regexp_replace(regexp_replace({0}, '!\[([^\n\r]*?)\]\(data:image/[^;]+;base64,[^)]+\)', '![\1]', 'gi'), '<img\s+[^>]*src=["'']data:image/[^;]+;base64,[^"'']+["''][^>]*>', '[image]', 'gi')"""
_DOCS = "n AS MATERIALIZED (SELECT doc_id || '/' || coalesce(note_path, 'note.md') AS path, text AS content FROM documents)"
_FM = r"(?s)\A---[ \t]*\r?\n(.*?\r?\n)?---[ \t]*(?:\r?\n|\z)"


def _field(key: str) -> str:
    return rf"trim(coalesce(regexp_extract(fm, '(?m)^{key}:[ \t]*([^\r\n]*(?:\r?\n[ \t]*- [^\r\n]*)*)', 1), ''))"


def _listed(raw: str) -> str:
    return rf"({raw} LIKE '[%' OR regexp_matches({raw}, '(^|\n)[ \t]*- '))"


def _unq(v: str) -> str:
    return rf"""regexp_replace(regexp_replace({v}, '^{_W}+|{_W}+$', '', 'g'), '^["'']|["'']$', '', 'g')"""


_ITEM = extraction.INLINE_ITEM.replace("'", "''")


def _scalar(raw: str) -> str:
    number = rf"regexp_replace(regexp_replace({raw}, '(\.\d*?)0+$', '\1'), '\.$', '')"
    return rf"CASE WHEN regexp_matches({raw}, '{extraction.NUMBER}') THEN {number} WHEN regexp_matches({raw}, '{extraction.TRUTH}') THEN lower({raw}) ELSE CAST(to_json({_unq(raw)}) AS VARCHAR) END"


def _values(raw: str) -> str:
    parts = rf"CASE WHEN {raw} LIKE '[%' THEN regexp_extract_all(regexp_replace({raw}, '^\[|\]$', '', 'g'), '{_ITEM}') WHEN regexp_matches({raw}, '(^|\n)[ \t]*- ') THEN string_split_regex({raw}, '(?:^|\r?\n)[ \t]*- ') ELSE [{raw}] END"
    return rf"list_filter(list_transform({parts}, lambda v: {_unq('v')}), lambda v: v <> '')"


_BLOCK = rf"{_DOCS}, b AS MATERIALIZED (SELECT path, content, coalesce(regexp_extract(content, '{_FM}', 1), '') AS fm FROM n)"
_BASE = r"regexp_replace(regexp_replace({0}, '^.*/', ''), '(.)\.[^.]*$', '\1')"
_RAWNAME = f"coalesce({_values(_field('id'))}[1], {_values(_field('title'))}[1], {_BASE.format('path')})"
_ENTNAME = f"CASE WHEN {_NAME.format(_RAWNAME)} = '' THEN {_RAWNAME} ELSE {_NAME.format(_RAWNAME)} END"


def _typed(stated: str, path: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains(lower({path}), {chr(39)}{m}{chr(39)})' for m in marks)} THEN '{t}'" for t, marks in extraction.PATH_TYPES)
    return f"CASE WHEN {stated} IN {extraction.ENTITY_TYPES} THEN {stated} {whens} ELSE 'document' END"


_META = " || ".join(
    f"CASE WHEN {_field(k)} = '' THEN '' ELSE ',\"{k}\":' || CASE WHEN {_listed(_field(k))} THEN CAST(to_json({_values(_field(k))}) AS VARCHAR) ELSE {_scalar(_field(k))} END END"
    for k in extraction.METADATA
)
_ALL = (*extraction.FIELD_EDGES, extraction.OWNER_EDGE)
_STATED = f"stated AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(f'SELECT path, {_NAME.format(chr(118))} AS target_name, {chr(39)}{kind}{chr(39)} AS edge_type, CAST({weight} AS DOUBLE) AS weight FROM (SELECT path, unnest({_values(_field(key))}) AS v FROM b)' for key, kind, weight in _ALL)}) WHERE target_name <> '')"
_LINKS = rf"""links AS MATERIALIZED (
  SELECT path, list_filter(list_distinct_ordered, lambda t: t <> '') AS t FROM (
    SELECT path, list_concat(
      list_transform(regexp_extract_all(content, '\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]', 1), lambda x: {_NAME.format('x')}),
      list_transform(list_filter(regexp_extract_all(content, '(?i)\[[^\]]+\]\(([^)]+\.(?:md|txt))\)', 1), lambda x: NOT regexp_matches(x, '^(?i)https?://')), lambda x: {_NAME.format(_BASE.format('x'))})) AS list_distinct_ordered
    FROM n WHERE content IS NOT NULL)),
flat AS (SELECT path, unnest(t) AS target, unnest(range(0, len(t))) AS pos FROM links),
firsts AS (SELECT path, target, min(pos) AS pos FROM flat GROUP BY ALL)"""

_SNAP = """old AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text FROM documents WHERE doc_id % 5 <> 0),
new AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') || CASE WHEN doc_id % 11 = 0 THEN ' edited' ELSE '' END AS text FROM documents WHERE doc_id % 7 <> 0),
df AS (
  SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN sha256(o.text) = sha256(n.text) THEN 'unchanged' ELSE 'updated' END AS status
  FROM old o FULL JOIN new n ON o.path = n.path),
oc AS (SELECT DISTINCT path AS file_id, sha256(c) AS content_hash FROM (SELECT path, unnest(string_split(text, chr(10) || chr(10))) AS c FROM old)),
nc AS (SELECT DISTINCT path AS file_id, sha256(c) AS content_hash FROM (SELECT path, unnest(string_split(text, chr(10) || chr(10))) AS c FROM new)),
dc AS (
  SELECT coalesce(o.file_id, n.file_id) AS file_id, coalesce(o.content_hash, n.content_hash) AS content_hash, CASE WHEN o.file_id IS NULL THEN 'new' WHEN n.file_id IS NULL THEN 'deleted' ELSE 'kept' END AS status
  FROM oc o FULL JOIN nc n ON o.file_id = n.file_id AND o.content_hash = n.content_hash)"""

_LEVELS = ", ".join(f"max(CASE WHEN level = {k} THEN pos END) OVER w AS p{k}, arg_max(title, pos) FILTER (WHERE level = {k}) OVER w AS t{k}" for k in range(1, 7))
_PATH = " || ".join(f"CASE WHEN p{k} IS NOT NULL AND {' AND '.join([f'p{k} > coalesce(p{j}, -1)' for j in range(1, k)] or ['true'])} THEN ' > ' || t{k} ELSE '' END" for k in range(1, 7))

ORACLE = {
    "clean_base64_images": f"SELECT chunk_id, length({_IMG.format('content')}) AS chars, sha256({_IMG.format('content')}) AS sha FROM chunks",
    "content_hash": "SELECT chunk_id, sha256(content) AS sha, sha256(content) = content_hash AS agrees FROM chunks",
    "token_estimates": "SELECT chunk_id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM chunks",
    "heading_sections": rf"""WITH {_DOCS}, l AS (
  SELECT path, unnest(x) AS line, unnest(range(0, len(x))) AS pos FROM (
    SELECT path, string_split_regex(regexp_replace({_IMG.format('content')}, '{_FM}', ''), '\r?\n') AS x FROM n WHERE content IS NOT NULL)),
h AS (SELECT *, length(coalesce(regexp_extract(line, '^(#{{1,6}}){_W}+([^\r]+)$', 1), '')) AS level, regexp_replace(regexp_extract(line, '^(#{{1,6}}){_W}+([^\r]+)$', 2), '^{_W}+|{_W}+$', '', 'g') AS title FROM l),
m AS (SELECT path, pos, line, level, {_LEVELS}, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS sec FROM h WINDOW w AS (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING)),
s AS (SELECT path, sec, min(substr({_PATH}, 4)) AS heading_path, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^{_W}+|{_W}+$', '', 'g') AS content FROM m WHERE level = 0 GROUP BY ALL)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY sec) - 1 AS section, heading_path, sha256(content) AS sha FROM s WHERE content <> ''""",
    "normalize_entity_name": f"SELECT extract_id, {_NAME.format('target_name')} AS name FROM extracted_edges WHERE target_name IS NOT NULL",
    "extract_links": f"WITH {_DOCS}, {_LINKS} SELECT path, row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS nth, target FROM firsts",
    "note_entities": f"WITH {_BLOCK} SELECT path, {_ENTNAME} AS name, {_typed('lower(coalesce(' + _values(_field('type')) + chr(91) + '1' + chr(93) + chr(44) + chr(39) * 2 + '))', 'path')} AS type, 'frontmatter' AS source, '{{' || substr({_META}, 2) || '}}' AS metadata FROM b WHERE content IS NOT NULL".replace("'{{'", "'{'").replace("'}}'", "'}'"),
    "infer_entity_type": "SELECT file_id, " + _typed("''", "'/' || path") + " AS type FROM files",
    "frontmatter_edges": f"WITH {_BLOCK}, {_STATED} SELECT path, target_name, edge_type, weight, CAST(1 AS DOUBLE) AS confidence, 'frontmatter' AS source_type FROM stated",
    "extract_graph_edges": f"""WITH {_BLOCK}, {_STATED}, {_LINKS} SELECT path, target_name, edge_type, weight, CAST(1 AS DOUBLE) AS confidence, 'frontmatter' AS source_type FROM stated
UNION ALL SELECT f.path, target, 'REFERENCES', CAST(0.7 AS DOUBLE), CAST(0.9 AS DOUBLE), 'wikilink' FROM firsts f JOIN (SELECT path, lower({_ENTNAME}) AS own FROM b) e ON e.path = f.path
WHERE target <> own AND NOT EXISTS (SELECT 1 FROM stated s WHERE s.path = f.path AND s.target_name = f.target)""",
    "diff_files": f"WITH {_SNAP} SELECT * FROM df",
    "diff_chunks": f"WITH {_SNAP} SELECT * FROM dc",
    "ingest_stats": f"WITH {_SNAP} SELECT 'files' AS what, status, count(*) AS n FROM df GROUP BY ALL UNION ALL SELECT 'chunks', status, count(*) FROM dc GROUP BY ALL",
    "list_notes_prefix": "SELECT path, strftime(make_timestamp(mtime_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS mtime FROM files WHERE starts_with(path, 'runbooks/')",
    "append_separator": "SELECT doc_id, sha256(CASE WHEN text IS NULL THEN '## Appended' WHEN ends_with(text, chr(10)) THEN text || chr(10) || '## Appended' ELSE text || chr(10) || chr(10) || '## Appended' END) AS sha FROM documents",
}
