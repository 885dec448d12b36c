"""Embedding of texts by a provider, with the hash embedding as default and fallback."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[list[float]]]
#: Gives for a document (its window) and a chunk the context that the chunk stands in, or nothing.
Contextualizer = Callable[[str, str], str | None]
HASH_MODEL = "hash-djb2"
_NOT_WORD = re.compile(r"[^\w\s]")


class HashProvider:
    """The deterministic embedding: words counted in hashed buckets, unit length."""

    def __init__(self, dim: int) -> None:
        self.dim, self.known = dim, {}

    def bucket(self, word: str) -> int:
        if word not in self.known:
            h = 5381
            # hashed in UTF-16 units, as the index does
            for unit in np.frombuffer(word.encode("utf-16-le", "surrogatepass"), dtype="<u2").tolist():
                h = (h * 33 + unit) & 0xFFFFFFFF
            if len(self.known) >= 500_000:
                self.known.clear()
            self.known[word] = abs(h - (1 << 32) if h >> 31 else h) % self.dim
        return self.known[word]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word, n in Counter(_NOT_WORD.sub(" ", text.lower()).split()).items():
                v[self.bucket(word)] += n
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).astype(np.float32))
        return out


def embedded(rows: DataFrame, id_column: str, text_column: str, dim: int, provider: Provider | None = None, model: str = "", group: int = 10, pause_s: float = 30.0, workers: int = 4) -> DataFrame:
    """(id, embedding, embedding_model): vectors of texts in groups of ``group``; a blank text has none.

    A task asks the provider for up to ``workers`` groups at a time. After a failure of the provider its task uses the hash embedding for ``pause_s`` seconds. The model recorded is
    the one that made the vector.
    """
    texts = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare, closed_until = HashProvider(dim), 0.0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            vectors: list = [None] * len(texts)
            models: list = [None] * len(texts)
            wanted = [i for i, t in enumerate(texts) if t.strip()]
            groups = [wanted[at : at + group] for at in range(0, len(wanted), group)]

            def made(some: list[int], texts: list[str] = texts) -> list | None:
                nonlocal closed_until
                if provider and time.monotonic() >= closed_until:
                    try:
                        return provider([texts[i] for i in some])
                    except Exception:  # noqa: BLE001 - whatever fails remotely, the text is embedded locally
                        closed_until = time.monotonic() + pause_s
                return None

            with ThreadPoolExecutor(workers) as pool:
                answers = list(pool.map(made, groups)) if provider else [None] * len(groups)
            for some, answer in zip(groups, answers, strict=True):
                for i, v in zip(some, spare([texts[i] for i in some]) if answer is None else answer, strict=True):
                    vectors[i], models[i] = v, HASH_MODEL if answer is None else model
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array(models, pa.string())], names=["id", "embedding", "embedding_model"])

    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, embedding array<float>, embedding_model string")


def context_window(document: F.Column, limit: int = 12_000) -> F.Column:
    """A document for a contextualiser: beyond ``limit`` characters only its first and last half of that."""
    half = limit // 2
    short = F.concat(F.substring(document, 1, half), F.lit("\n\n[…]\n\n"), F.right(document, F.lit(half)))
    return F.when(F.length(document) <= limit, document).otherwise(short)


def contextualized(chunks: DataFrame, notes: DataFrame, contextualizer: Contextualizer) -> DataFrame:
    """``chunks`` with ``contextualized_content``: the context of each in its note, a blank line, its content.

    ``chunks`` (chunk_id, file_id, content, ...), ``notes`` (file_id, content). Null where the contextualizer fails or
    has nothing to say; a failure concerns its chunk alone.
    """
    windows = notes.select("file_id", context_window(F.col("content")).alias("document"))
    rows = chunks.select("chunk_id", "file_id", "content").join(windows, "file_id").select("chunk_id", "document", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for document, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    context = (contextualizer(document, content) or "").strip()
                except Exception:  # noqa: BLE001 - whatever fails remotely, the chunk is indexed without context
                    context = ""
                out.append(f"{context}\n\n{content}" if context else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["chunk_id", "contextualized_content"])

    return chunks.join(rows.mapInArrow(run, "chunk_id string, contextualized_content string"), "chunk_id", "left")
