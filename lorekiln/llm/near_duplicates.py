"""Records that share most of their word sequences, over collections too large to compare pair by pair.

Many universal hash minima with banding, signature verification, and connected components by alternating
large-star and small-star. Records with one set of word sequences form a class first, so copies cost nothing
later; only class representatives are banded, compared and linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekiln.llm.words import WordHashes, mixed, shingles, words_of
from lorekiln.session import durable, hot_keys, next_round

#: Bits of the verification signature: one bit of each of so many minima.
SIGNATURE_BITS = 128
#: Members of a class that one part holds when classes are expanded to pairs.
PART_ROWS = 2_048


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, dtype=np.uint64)


def _minima(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Minima of ``n`` universal (multiply-shift) hashes over the segments that begin at ``starts``."""
    a, b = _coefficients(n)
    out = np.empty((len(starts), n), dtype=np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(((values * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, ordered by both."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], owner[first]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def signatures(rows: DataFrame, width: int, min_words: int, bands: int, depth: int) -> DataFrame:
    """(id, text_hash, key_a, key_b, sign_a, sign_b, bands) for each (id, text_hash, text) row of ``min_words`` or more words.

    key_*: 128-bit hash of the set of word sequences. sign_*: one bit of each of 128 minima. bands: a hash of
    each band of ``depth`` minima.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            lists = [words_of(t) for t in batch.column(2).to_pylist()]
            kept = [i for i, w in enumerate(lists) if len(w) >= max(min_words, width)]
            if not kept:
                continue
            values, owner = _distinct(*shingles([lists[i] for i in kept], width, hashes))
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            keys = [np.add.reduceat(mixed(values + np.uint64(c)), starts) for c in (1, 0x5851F42D4C957F2D)]
            low = _minima(values, starts, max(SIGNATURE_BITS, bands * depth))
            bits = np.packbits((mixed(low[:, :SIGNATURE_BITS].astype(np.uint64)) & np.uint64(1)).astype(np.uint8), axis=1)
            signs = np.ascontiguousarray(bits).view(np.uint64)
            band = np.empty((len(kept), bands), dtype=np.uint64)
            for j in range(bands):
                acc = np.full(len(kept), j + 1, dtype=np.uint64)
                for k in range(j * depth, (j + 1) * depth):
                    acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + low[:, k])
                band[:, j] = acc
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(kept) * bands + 1, bands, dtype=np.int32)), _longs(band.ravel()))
            known = [batch.column(i).take(pa.array(kept)) for i in (0, 1)]
            columns = [*known, _longs(keys[0]), _longs(keys[1]), _longs(signs[:, 0]), _longs(signs[:, 1]), listed]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "key_a", "key_b", "sign_a", "sign_b", "bands"])

    return rows.mapInArrow(run, "id string, text_hash long, key_a long, key_b long, sign_a long, sign_b long, bands array<long>")


def _bucket_pairs(reps: DataFrame, most_bits: int) -> DataFrame:
    """Pairs (a < b) of representatives that share a band and differ in at most ``most_bits`` signature bits.

    One equi-join on the band's hash. A band value held by very many texts is salted: its left rows are spread
    over tasks and its right rows repeated for each.
    """
    rows = reps.select("n", "sign_a", "sign_b", F.explode("bands").alias("bucket"))
    keys = ["bucket"]
    left = right = rows
    hot = hot_keys(rows, "bucket", "n")
    if hot is not None:
        keys = ["bucket", "salt"]
        salted = rows.join(hot, "bucket", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        left = salted.withColumn("salt", F.pmod(F.hash("n"), F.col("salts"))).drop("salts")
        right = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    left, right = left.alias("l"), right.alias("r")
    apart = F.bit_count(F.col("l.sign_a").bitwiseXOR(F.col("r.sign_a"))) + F.bit_count(F.col("l.sign_b").bitwiseXOR(F.col("r.sign_b")))
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l.n") < F.col("r.n"), apart <= most_bits]
    joined = left.join(right, on[0] if len(on) == 1 else _all(on))
    return joined.select(F.col("l.n").alias("a"), F.col("r.n").alias("b")).distinct()


def _all(conditions: list) -> object:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(n, grams): the sorted distinct sequence hashes of each (n, text) row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            lists = [words_of(t) for t in batch.column(1).to_pylist()]
            values, owner = _distinct(*shingles(lists, width, hashes))
            ends = np.searchsorted(owner, np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.LargeListArray.from_arrays(pa.array(ends.astype(np.int64)), _longs(values)).cast(pa.list_(pa.int64()))], names=["n", "grams"])

    return rows.mapInArrow(run, "n long, grams array<long>")


def _agreeing(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sets of sequences share at least ``threshold`` of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            lv, rv = left.values.to_numpy(), right.values.to_numpy()
            share = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                # both are ordered as unsigned numbers
                at = np.searchsorted(large.view(np.uint64), small.view(np.uint64))
                at[at == len(large)] = 0
                both = int((large[at] == small).sum()) if len(large) else 0
                share[i] = both / max(1, len(x) + len(y) - both)
            ok = share >= threshold - 1e-12
            kept = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(share[ok])], names=["a", "b", "similarity"])

    return pairs.mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(
    rows: DataFrame, id_column: str, text_column: str, threshold: float = 0.8, width: int = 5, min_words: int = 20, bands: int = 24, depth: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts and links between similar ones.

    Returns ``members`` (id, rep) with one row per text of at least ``min_words`` words, rep being the number of the
    class of texts with the same set of ``width``-word sequences, and ``links`` (rep_a, rep_b, similarity), rep_a <
    rep_b, for classes whose sets share at least ``threshold`` of their union, checked exactly.

    Banding finds a pair of similarity s with probability 1 - (1 - s^depth)^bands: 0.9986 at 0.7, 0.999997 at 0.8.
    The signature then drops pairs that lie more than 3.5 standard deviations under the threshold.
    Null, empty and short texts are in no class. Ids are compared as strings; an id with different texts is a member
    of the class of each, a repeated row counts once. Other columns, whatever their names, are ignored. An empty table
    gives empty results.
    """
    text = F.col(text_column)
    texts = rows.select(F.col(id_column).cast("string").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    texts = texts.filter(F.col("id").isNotNull() & (F.length("text") >= 2 * min_words - 1))
    # The one pass over all texts; what follows reads its few numbers a text.
    signed = durable(signatures(texts, width, min_words, bands, depth))
    # A row with the smallest id stands for its class; partial aggregation collapses copies before the shuffle.
    first = F.min(F.struct("id", "text_hash")).alias("first")
    reps = signed.groupBy("key_a", "key_b").agg(first, F.first("sign_a").alias("sign_a"), F.first("sign_b").alias("sign_b"), F.first("bands").alias("bands"))
    reps = durable(reps.select("first.*", "key_a", "key_b", "sign_a", "sign_b", "bands")).withColumn("n", F.monotonically_increasing_id())
    names = reps.select("n", "key_a", "key_b")

    spread = 2 * math.sqrt((1 + threshold) / 2 * (1 - threshold) / 2 / SIGNATURE_BITS)
    most_bits = math.floor(SIGNATURE_BITS * (1 - (1 + max(0.0, threshold - 3.5 * spread)) / 2))
    pairs = durable(_bucket_pairs(reps.select("n", "sign_a", "sign_b", "bands"), most_bits))
    used = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct().join(reps.select("n", "id", "text_hash"), "n")
    # an id may hold several texts: the hash tells which one stands for the class
    grams = durable(_sets(texts.join(used, ["id", "text_hash"]).dropDuplicates(["n"]).select("n", "text"), width))
    held = pairs.join(grams.select(F.col("n").alias("a"), F.col("grams").alias("grams_a")), "a")
    held = held.join(grams.select(F.col("n").alias("b"), F.col("grams").alias("grams_b")), "b")
    agreed = _agreeing(held.select("a", "b", "grams_a", "grams_b"), threshold)
    links = agreed.select(F.least("a", "b").alias("rep_a"), F.greatest("a", "b").alias("rep_b"), "similarity")
    members = signed.select("id", "key_a", "key_b").join(names.select("key_a", "key_b", F.col("n").alias("rep")), ["key_a", "key_b"])
    return members.select("id", "rep").distinct(), links


def expanded_pairs(members: DataFrame, links: DataFrame, max_copies: int | None = None) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b, for all members of one class or of linked classes.

    Every pair comes out, so a class of n members gives n * (n - 1) / 2 rows. Members of large classes are cut into
    parts of about ``PART_ROWS`` and every two parts meet, so no task makes all pairs of a class.

    Only if ``max_copies`` is given, the result is a shorter form: a larger class is written as pairs of its
    representative with each member, and stands in links to other classes by its representative alone. Members of a
    class have equal sets of word sequences, not equal texts, so pairs of different texts are then left out.
    """
    sized = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    placed = durable(members.join(sized, "rep"))
    ends, classes = placed, sized.filter(F.col("copies") > 1)
    if max_copies is not None:
        ends = placed.filter((F.col("copies") <= max_copies) | (F.col("id") == F.col("first")))
        classes = classes.filter(F.col("copies") <= max_copies)
    met = links.select("rep_a", "rep_b").unionByName(classes.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")))
    ends = ends.select("rep", "id", "copies")
    part = F.lit(0)
    if ends.filter(F.col("copies") > PART_ROWS).limit(1).count():
        parts = ends.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")).filter("parts > 1")
        for side in ("a", "b"):
            cut = parts.select(F.col("rep").alias(f"rep_{side}"), F.col("parts").alias(f"parts_{side}"))
            met = met.join(cut, f"rep_{side}", "left")
            met = met.withColumn(f"part_{side}", F.explode(F.sequence(F.lit(0), F.coalesce(f"parts_{side}", F.lit(1)) - 1)))
        met = met.filter("rep_a != rep_b or part_a <= part_b").select("rep_a", "rep_b", "part_a", "part_b")
        ends = ends.join(parts, "rep", "left")
        part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    else:
        met = met.withColumns({"part_a": F.lit(0), "part_b": F.lit(0)})
    ends = ends.select("rep", "id", part.alias("part"))
    met = met.join(ends.select(F.col("rep").alias("rep_a"), F.col("part").alias("part_a"), F.col("id").alias("x")), ["rep_a", "part_a"])
    met = met.join(ends.select(F.col("rep").alias("rep_b"), F.col("part").alias("part_b"), F.col("id").alias("y")), ["rep_b", "part_b"])
    pairs = met.filter("rep_a != rep_b or part_a != part_b or x < y").select("x", "y")
    if max_copies is not None:
        star = placed.filter((F.col("copies") > max_copies) & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"))
        pairs = pairs.unionByName(star)
    # an id with several texts may meet another, or itself, more than once
    return pairs.filter("x != y").select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the undirected links; root is the smallest node of its component.

    Alternating large-star and small-star until the edges stay as they are; a logarithmic number of rounds, each
    of two aggregations by node. Self-links and repeats do no harm; a null end is ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    edges, before = next_round(edges.distinct()), None
    while True:
        last = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.withColumnRenamed("m", "v"))
        edges = next_round(edges.distinct(), last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per id, with its class, its component and its class's links.

    A class has the name of its smallest id, a group that of its smallest class. An id in several classes stands in
    the one of the smallest name.
    """
    classes = members.groupBy("rep").agg(F.min("id").alias("class_id"))
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    linked = durable(components(links, "rep_a", "rep_b").withColumnRenamed("node", "rep").join(ends, "rep").join(classes, "rep"))
    named = linked.groupBy("root").agg(F.min("class_id").alias("group_id"))
    about = classes.join(linked.join(named, "root").select("rep", "group_id", "n_links"), "rep", "left")
    out = members.join(about, "rep").select("id", F.struct("class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")).alias("c"))
    return out.groupBy("id").agg(F.min("c").alias("c")).select("id", "c.*")
