"""Schemas of the index tables."""

FILES = "file_id string, path string, file_hash string, mtime_ms bigint, updated_ms bigint"
CHUNKS = (
    "chunk_id string, file_id string, chunk_index int, heading_path string, content string, contextualized_content string, "
    "content_hash string, embedding array<float>, embedding_model string, created_ms bigint, ord bigint"
)
ENTITIES = "entity_id string, name string, type string, file_id string, source string, metadata string, created_ms bigint"
EDGES = "edge_id string, source_id string, target_id string, edge_type string, weight double, confidence double, source_type string, created_ms bigint"
ENTITY_CHUNK_MAP = "entity_id string, chunk_id string"
#: The inverted index: positions of a term in one column of a chunk, and the tokens of each chunk.
POSTINGS = "term string, id string, col int, tf bigint, positions array<int>"
DOC_STATS = "id string, dl bigint"
#: What each note writes into the graph, from which entities and edges are built.
ENTITY_WRITES = "path string, nth bigint, name string, type string, source string, metadata string, created_ms bigint, file_id string"
LINK_WRITES = "path string, nth bigint, source_name string, target_name string, edge_type string, weight double, confidence double, source_type string, created_ms bigint, file_id string"
TABLES = {
    "files": FILES, "chunks": CHUNKS, "entities": ENTITIES, "edges": EDGES, "entity_chunk_map": ENTITY_CHUNK_MAP,
    "postings": POSTINGS, "doc_stats": DOC_STATS, "entity_writes": ENTITY_WRITES, "link_writes": LINK_WRITES,
}
#: Tables that the store keeps in segments by file.
SEGMENTED = ("files", "chunks", "entity_chunk_map", "postings", "doc_stats", "entity_writes", "link_writes")
