"""Splitting oversized texts at natural boundaries.

Token lengths are summed to offsets, boundaries stand in sorted arrays by kind, and each cut is the last boundary
under the limit found by binary search; the next piece starts the overlap before it. Without a boundary the cut is
hard. Only oversized rows leave the JVM.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import without_inline_images
from lorekiln.session import durable

#: White space that is trimmed at both ends.
BLANKS = " \t\r\n"
_TOKEN = re.compile(r"\s+|\S+")
_SENTENCE_END = (".", "!", "?", "…", "。", "！", "？", '."', ".)", '!"', '?"', ".”", ".«", ".»")
#: Names of the cuts by strength.
CUTS = ("block", "line", "sentence", "word", "hard")


def boundaries(text: str) -> list[list[int]]:
    """Sorted offsets of block ends, line ends, sentence ends and word ends, each after its white space."""
    tokens = _TOKEN.findall(text)
    out: list[list[int]] = [[], [], [], []]
    before = ""
    for token, offset in zip(tokens, accumulate(map(len, tokens)), strict=True):
        if token.isspace():
            out[3].append(offset)
            breaks = token.count("\n")
            if breaks:
                out[1].append(offset)
                if breaks > 1:
                    out[0].append(offset)
            if breaks or before.endswith(_SENTENCE_END):
                out[2].append(offset)
        before = token
    return out


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, kind of the cut at end) of pieces of at most ``limit`` characters; kind -1 at the text's end.

    A boundary must leave the piece at least half full; else the next weaker kind is tried, words without that rule.
    """
    marks, start, out = boundaries(text), 0, []
    while len(text) - start > limit:
        stop, kind = start + limit, 4
        for k, at in enumerate(marks):
            i = bisect_right(at, start + limit) - 1
            if i >= 0 and at[i] > start + max(overlap, limit // 2 if k < 3 else overlap):
                stop, kind = at[i], k
                break
        out.append((start, stop, kind))
        start = stop - overlap
    return [*out, (start, len(text), -1)]


def fits_in_blocks(text: str, limit: int) -> bool:
    """Whether every block between empty or white-space-only lines fits the limit after trimming."""
    block: list[str] = []
    for line in [*text.split("\n"), ""]:
        if line.strip(BLANKS):
            block.append(line)
        else:
            if len("\n".join(block).strip(BLANKS)) > limit:
                return False
            block = []
    return True


def cleaned(text_column: str) -> Column:
    """Text without inline images, trimmed."""
    return F.regexp_replace(without_inline_images(F.col(text_column)), r"^[ \t\r\n]+|[ \t\r\n]+\z", "")


def oversized_pieces(rows: DataFrame, id_column: str, text_column: str, limit: int = 2_800, overlap: int = 400) -> DataFrame:
    """(id, kind, piece, start, stop, cut, content): the pieces of every text longer than ``limit`` once cleaned.

    ``content`` is text[start:stop]; each piece but the first starts ``overlap`` characters before the last one's
    end, so the pieces give the text back. kind: ``blocks`` if every block between blank lines fits the limit,
    else ``inside``. Lengths are code points. Null, empty and short texts give no rows; a repeated row gives its
    pieces again; extra columns are ignored. No shuffle; one text is one row, whatever its length.
    """
    rows = rows.select(F.col(id_column).cast("string").alias("carry"), cleaned(text_column).alias("text"))
    out = _cut(rows.filter(F.length("text") > limit), limit, overlap)
    return out.select(F.col("carry").alias("id"), "kind", "piece", "start", "stop", "cut", "content")


def _cut(long: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of each (carry, text) row, ``carry`` unchanged beside them."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half of the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, scalar in enumerate(batch.column(1)):
                text = scalar.as_py()
                found = spans(text, limit, overlap)
                kind = "blocks" if fits_in_blocks(text, limit) else "inside"
                for at in range(0, len(found), 1_000):
                    some = found[at : at + 1_000]
                    columns = [
                        batch.column(0).take(pa.array([i] * len(some))),
                        pa.array([kind] * len(some)),
                        pa.array(range(at, at + len(some)), pa.int32()),
                        pa.array([s for s, _, _ in some], pa.int32()),
                        pa.array([e for _, e, _ in some], pa.int32()),
                        pa.array([None if k < 0 else CUTS[k] for _, _, k in some], pa.string()),
                        pa.array([text[s:e] for s, e, _ in some]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["carry", "kind", "piece", "start", "stop", "cut", "content"])

    carried = long.schema["carry"].dataType.simpleString()
    return long.mapInArrow(run, f"carry {carried}, kind string, piece int, start int, stop int, cut string, content string")


def resplit_chunks(chunks: DataFrame, limit: int = 2_800, overlap: int = 400) -> DataFrame:
    """(chunk_id, file_id, heading_path, chunk_index, piece, content): all chunks, oversized ones as pieces.

    chunk_index is renumbered from 0 in each file, by old index, arrival (ord), chunk_id and piece; old gaps and
    repeats do not matter, a repeated row is numbered again, and rows without file_id are numbered together. Null
    contents keep their row. Rows are sorted over range partitions; each partition goes on counting where the one
    before left off in the file that they share, so one file may hold any share of the rows.
    """
    text = cleaned("content")
    keys = F.struct("file_id", "chunk_index", "ord", "chunk_id", "heading_path")
    whole = chunks.select(keys.alias("carry"), text.alias("text")).filter(F.length("text") > limit)
    short = chunks.filter(F.col("content").isNull() | (F.length(text) <= limit)).select(keys.alias("carry"), F.lit(0).alias("piece"), text.alias("content"))
    rows = short.unionByName(_cut(whole, limit, overlap).select("carry", "piece", "content")).select("carry.*", "piece", "content")
    order = ["file_id", "chunk_index", "ord", "chunk_id", "piece"]
    placed = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a partition: its first and last file and how many rows they have."""
        first = last = None
        n_first = n_last = n = 0
        for batch in batches:
            for file, size in _runs(batch.column(0)):
                if n and file == last:
                    n_last += size
                else:
                    last, n_last = file, size
                first = file if not n else first
                n += size
                n_first += size if file == first and n_first + size == n else 0
        if n:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "first": [first], "n_first": [n_first], "last": [last], "n_last": [n_last], "n": [n]}, schema=summary)

    summary = pa.schema([("part", pa.int32()), ("first", pa.string()), ("n_first", pa.int64()), ("last", pa.string()), ("n_last", pa.int64()), ("n", pa.int64())])
    # as many rows as there are partitions
    found = sorted(placed.select("file_id").mapInArrow(edges, "part int, first string, n_first long, last string, n_last long, n long").collect())
    base, open_file, open_rows = {}, object(), 0
    for part, first, n_first, last, n_last, n in found:
        base[part] = open_rows if first == open_file else 0
        open_rows = n_last + (base[part] if n_first == n else 0)
        open_file = last

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, count = object(), base.get(TaskContext.get().partitionId(), 0)
        started = False
        for batch in batches:
            index = []
            for file, size in _runs(batch.column(0)):
                if started and file != current:
                    count = 0
                current, started = file, True
                index.append(np.arange(count, count + size, dtype=np.int32))
                count += size
            if index:
                columns = {name: batch.column(name) for name in ("chunk_id", "file_id", "heading_path")}
                columns |= {"chunk_index": pa.array(np.concatenate(index)), "piece": batch.column("piece"), "content": batch.column("content")}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return placed.mapInArrow(number, "chunk_id string, file_id string, heading_path string, chunk_index int, piece int, content string")


def _runs(column: pa.Array) -> Iterator[tuple[str | None, int]]:
    """Equal neighbours with their number."""
    for value, group in groupby(column.to_pylist()):
        yield value, sum(1 for _ in group)
