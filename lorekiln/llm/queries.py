"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import leakage as lk
from lorekiln.llm import mixing as mx
from lorekiln.llm import near_duplicates as nd
from lorekiln.llm import similar_vectors as sv
from lorekiln.llm import splitting as sp
from lorekiln.llm import stuffing as st
from lorekiln.session import durable, load

#: Parameters of problem 1 as TESTDATA.md states them.
P1 = {"threshold": 0.7, "width": 3, "min_words": 20}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks with nearly the same content."""
    members, links = nd.near_duplicates(load(spark, sf, "chunks"), "chunk_id", "content", **P1)
    return nd.expanded_pairs(members, links)


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk with its class of equal sets of word sequences, its group of similar ones and its number of links.

    A chunk with null or too short content is alone in its class and group.
    """
    chunks = load(spark, sf, "chunks")
    members, links = nd.near_duplicates(chunks, "chunk_id", "content", **P1)
    every = chunks.select(F.col("chunk_id").cast("string").alias("id")).filter("id is not null").distinct()
    found = every.join(nd.duplicate_groups(members, durable(links)), "id", "left")
    return found.select(
        F.col("id").alias("chunk_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks of cosine 0.9 or more of which one is among the 5 most similar of the other."""
    return sv.mutual_pairs(sv.most_similar(load(spark, sf, "chunks"), "chunk_id", "embedding", dim=64, k=5, least=0.9))


def p2_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar chunks of every chunk whose ord is divisible by 50, against all chunks, exactly."""
    chunks = load(spark, sf, "chunks").select("ord", "chunk_id", "embedding")
    found = sv.search(chunks.filter("ord % 50 = 0"), chunks, "chunk_id", "embedding", dim=64, k=5)
    return found.select(F.col("id").alias("chunk_id"), "rank", "neighbour", F.round("cosine", 6).alias("cosine"))


def p2_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar chunks of every usable chunk, exactly and with no least similarity."""
    found = sv.most_similar(load(spark, sf, "chunks"), "chunk_id", "embedding", dim=64, k=5)
    return found.select(F.col("id").alias("chunk_id"), "rank", "neighbour", F.round("cosine", 6).alias("cosine"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Oversized chunks, and whether their blocks fit the limit."""
    pieces = sp.oversized_pieces(load(spark, sf, "chunks"), "chunk_id", "content")
    return pieces.filter("piece = 0").select(F.col("id").alias("chunk_id"), "kind")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks after splitting, with heading path and chunk_index renumbered in each file."""
    return sp.resplit_chunks(load(spark, sf, "chunks"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return lk.leaked_spans(load(spark, sf, "documents"), "doc_id", "text", load(spark, sf, "eval_items"), "item_id", "text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation item."""
    return _leaks(spark, sf).select(F.col("id").cast("bigint").alias("doc_id"), F.col("item_id").cast("bigint").alias("item_id")).distinct()


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items that leaked: in how many documents, and how many words of them."""
    words = F.aggregate("spans", F.lit(0), lambda n, s: n + s[1] - s[0] + 1)
    by_item = _leaks(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(words).alias("n_words"))
    return by_item.select(F.col("item_id").cast("bigint").alias("item_id"), "n_documents", "n_words")


def p6_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without the leaked passages; those that are mostly leaked are dropped."""
    cleaned = lk.cleaned_texts(load(spark, sf, "documents"), "doc_id", "text", load(spark, sf, "eval_items"), "item_id", "text")
    return cleaned.select(F.col("id").cast("bigint").alias("doc_id"), "text", "removed_words", "dropped")


def p6_removed(spark: SparkSession, sf: str) -> DataFrame:
    """How many words cleaning takes out of each document that it changes, and whether it drops it."""
    return p6_cleaned(spark, sf).filter("removed_words > 0").select("doc_id", F.col("removed_words").cast("bigint").alias("removed_words"), "dropped")


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of each recipe, with how often each is taken."""
    chosen, _ = mx.mixture(load(spark, sf, "documents"), load(spark, sf, "mix_targets"))
    return chosen.select("recipe", F.col("id").cast("bigint").alias("doc_id"), "source", "n_tokens", "repeats")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares of every source of each recipe."""
    return mx.mixture(load(spark, sf, "documents"), load(spark, sf, "mix_targets"))[1].drop("binding")


def p7_exact_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the largest mixture in which every source with documents keeps its share, and which source binds it."""
    return mx.mixture(load(spark, sf, "documents"), load(spark, sf, "mix_targets"), keep_shares=True)[1]


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Of each recipe's mixture: documents beyond their repeats, of unlisted sources, taken twice as rows; sources listed."""
    targets = load(spark, sf, "mix_targets").select("recipe", mx.source_key(F.col("source")).alias("source"), "max_repeats")
    chosen, _ = mx.mixture(load(spark, sf, "documents"), load(spark, sf, "mix_targets"))
    rows = chosen.join(targets, ["recipe", "source"], "left")
    over, unlisted = F.count_if(F.col("repeats") > F.col("max_repeats")), F.count_if(F.col("max_repeats").isNull())
    found = rows.groupBy("recipe").agg(over.alias("over_repeats"), unlisted.alias("unlisted"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("twice"))
    listed = targets.groupBy("recipe").agg(F.count_distinct("source").alias("sources"))
    return listed.join(found, "recipe", "left")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of repeated keywords, links or tags."""
    return st.stuffed_pages(load(spark, sf, "documents"), "doc_id", "text").select(F.col("id").cast("bigint").alias("doc_id"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (p1_found, p1_groups, p2_found, p2_search, p2_nearest, p4_found, p4_pieces, p6_found, p6_items, p6_cleaned, p6_removed, p7_mixture, p7_shares, p7_exact_shares, p7_invariants, p8_found)
    }
