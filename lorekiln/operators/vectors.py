"""Hash embeddings, cosine and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.operators.embedding import HashProvider
from lorekiln.session import durable

DIM = 768
#: Rows that are embedded or multiplied at a time.
_STEP = 1_024


def hash_embedding(rows: DataFrame, id_column: str, text_column: str, dim: int = DIM) -> DataFrame:
    """(id, bucket, weight): non-zero values of the deterministic embedding, of unit length, as float.

    Words are counted inside the row, so nothing is shuffled. A text without words has no rows; null is such a text; a
    repeated row gives its values again.
    """
    texts = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = HashProvider(dim)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                x = np.stack(embed(part.column(1).to_pylist()))
                row, bucket = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(bucket.astype(np.int32)), pa.array(x[row, bucket])], names=["id", "bucket", "weight"])

    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, bucket int, weight float")


def cosine(x: Column, y: Column) -> Column:
    """Cosine in doubles; 0 if the lengths differ, a vector is empty or null, or its norm is zero."""

    def dot(a: Column, b: Column) -> Column:
        product = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda s, t: s * t)
        return F.aggregate(product, F.lit(0.0), lambda s, t: s + t)

    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    fine = x.isNotNull() & y.isNotNull() & (F.size(x) == F.size(y)) & (F.size(x) > 0)
    return F.when(fine, F.coalesce(F.try_divide(dot(x, y), norm), F.lit(0.0))).otherwise(F.lit(0.0))


def with_previous(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Adds ``before``: ``value`` of the row before in its group by ``order``, null at the first row of a group.

    Rows are sorted over range partitions and looked up inside (partition, group); the last row of each is handed on
    to the next partition that the group reaches, so one group may hold any share of the rows. Null is a group.
    """
    placed = durable(rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", group).orderBy(*order)
    lasts = placed.groupBy("part", group).agg(F.max_by(value, F.struct(*order)).alias("last"))
    handed = lasts.withColumn("handed", F.lag("last").over(Window.partitionBy(group).orderBy("part"))).filter("handed is not null")
    handed = handed.select(F.col("part").alias("to_part"), F.col(group).alias("to_group"), "handed")
    looked = placed.withColumns({"before": F.lag(value).over(inside), "nth": F.row_number().over(inside)})
    looked = looked.join(handed, (F.col("part") == F.col("to_part")) & F.col(group).eqNullSafe(F.col("to_group")), "left")
    return looked.withColumn("before", F.when(F.col("nth") == 1, F.col("handed")).otherwise(F.col("before"))).select(*rows.columns, "before")


def vector_search(queries: DataFrame, rows: DataFrame, query_id: str, id_column: str, vector_column: str, k: int = 8, pass_rows: int = 16_384) -> DataFrame:
    """(query_id, id, score, rank): exact top ``k`` by cosine of every query vector against all row vectors.

    Rows of another length than the query score 0, as do zero vectors; null vectors are left out; ties go to the
    smaller id. The query vectors of a pass (at most ``pass_rows``) are broadcast and multiplied with the rows as they
    are scanned; a task keeps the best k of each query, so what is shuffled does not grow with the rows.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector_column).alias("v")).filter("v is not null")
    base = rows.select(F.col(id_column).alias("tie"), F.col(id_column).alias("id"), F.col(vector_column).alias("v")).filter("v is not null")
    return _searched(asked, base, k, pass_rows, _vectors)


def hash_search(docs: DataFrame, queries: DataFrame, id_column: str, doc_text: str, query_id: str, text: str, order: str, k: int = 8, dim: int = DIM, pass_rows: int = 2_048) -> DataFrame:
    """(query_id, id, score, rank): nearest documents by cosine of hash embeddings, those that share a word's bucket.

    Ties in the order of ``order``. Documents are embedded as they are scanned, as in ``vector_search``; null and
    wordless texts find nothing and are not found.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("v")).filter("v is not null")
    base = docs.select(F.col(order).alias("tie"), F.col(id_column).alias("id"), F.col(doc_text).alias("v")).filter("v is not null")
    return _searched(asked, base, k, pass_rows, _HashedTexts(dim)).filter("score > 0")


def _searched(asked: DataFrame, base: DataFrame, k: int, pass_rows: int, read: Reader) -> DataFrame:
    passes = max(1, -(-asked.count() * 5 // (pass_rows * 4)))
    kinds = dict(base.dtypes)
    out = None
    for p in range(passes):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).toArrow()
        shared = base.sparkSession.sparkContext.broadcast((block.column("query_id").combine_chunks(), read(block.column("v").combine_chunks())))
        found = base.mapInArrow(_meeting(shared, k, read), f"query_id {dict(asked.dtypes)['query_id']}, tie {kinds['tie']}, id {kinds['id']}, score double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "tie", "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


#: Gives for each length of vectors the places that have it and the unit vectors themselves.
Reader = Callable[[pa.Array], dict[int, tuple[np.ndarray, np.ndarray]]]


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    sizes, out = np.asarray(pc.list_value_length(column)), {}
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        out[int(n)] = at, _unit(flat.astype(np.float64).reshape(len(at), n))
    return out


class _HashedTexts:
    """Reads texts as their hash embeddings."""

    def __init__(self, dim: int) -> None:
        self.embed = HashProvider(dim)

    def __call__(self, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {self.embed.dim: (np.arange(len(column)), np.stack(self.embed(column.to_pylist())).astype(np.float64))} if len(column) else {}


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _meeting(shared: object, k: int, read: Reader) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shared.value
        best: list[list[tuple]] = [[] for _ in range(len(names))]
        tie_kind = (pa.null(), pa.null())
        floor = np.full(len(names), -np.inf)
        for whole in batches:
            for at in range(0, whole.num_rows, _STEP):
                batch = whole.slice(at, _STEP)
                tie_kind = (batch.column(0).type, batch.column(1).type)
                ties, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                order = sorted(range(len(ids)), key=lambda i: (ties[i] is not None, ties[i], ids[i]))
                rows = read(batch.column(2).take(pa.array(order, pa.int64())))
                for size, (mine, x) in asked.items():
                    score = np.zeros((len(mine), len(ids)))
                    if size in rows:
                        there, y = rows[size]
                        score[:, there] = x @ y.T
                    for q, d in zip(*_chosen(np.round(score, 9), floor[mine], k), strict=True):
                        best[mine[q]].append((-round(score[q, d], 9), ties[order[d]], ids[order[d]], score[q, d]))
                    for q in mine:
                        if len(best[q]) > k:
                            best[q] = sorted(best[q], key=lambda r: (r[0], r[1] is not None, *r[1:3]))[:k]
                        if len(best[q]) == k:
                            floor[q] = -max(r[0] for r in best[q])
        rows = [(q, *r[1:]) for q, found in enumerate(best) for r in found]
        if rows:
            q, tie, name, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(tie, tie_kind[0]), pa.array(name, tie_kind[1]), pa.array(score, pa.float64())], names=["query_id", "tie", "id", "score"])

    return run


def _chosen(score: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's best ``k`` that reach its floor; of equal ones the first."""
    ok = score >= floor[:, None]
    crowded = np.flatnonzero(ok.sum(axis=1) > k)
    if len(crowded):
        held = np.where(ok[crowded], score[crowded], -np.inf)
        kth = -np.partition(-held, k - 1, axis=1)[:, k - 1 : k]
        above, equal = held > kth, held == kth
        ok[crowded] = above | (equal & (equal.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(ok)
