"""Mixing sources to target weights, sized in tokens of a public tokenizer.

Documents are counted by source and exact token length. For each source of a recipe whole repeats are taken first;
what its budget lacks is filled from the length counts: a share of every length, then a bounded-knapsack dynamic
programme for the last tokens. Documents are then selected in a seeded order within their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.session import durable

#: Default tokenizer file, a byte-level BPE as ranks; a parameter wherever it is used.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Tokens that the dynamic programme fits; what lies above is filled length by length.
FIT_TOKENS = 65_536
#: Parts of the hash range in which documents of one source and length are ranked.
RANK_PARTS = 256

_encoders: dict[int, object] = {}


def _encoder(path: str) -> object:
    """The encoder of a rank file."""
    return _made(Path(path).read_bytes())


def _made(ranks: bytes) -> object:
    """The encoder of a rank file's contents, made once a process."""
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        parsed = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=parsed, special_tokens={})
    return _encoders[key]


def token_counts(documents: DataFrame, id_column: str, text_column: str, source: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, n_tokens) of every text that is not null or blank; markup for special tokens is plain text.

    The rank file (a few megabytes at most) is read on the driver and broadcast, so executors need no such file.
    """
    rows = documents.select(F.col(id_column).cast("string").alias("id"), source.alias("source"), F.col(text_column).alias("text"))
    rows = rows.filter(F.col("text").rlike(r"\S"))
    ranks = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _made(ranks.value).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["id", "source", "n_tokens"])

    return rows.mapInArrow(run, "id string, source string, n_tokens long")


def source_key(c: Column) -> Column:
    """Source names compare without case and surrounding white space."""
    return F.lower(F.trim(c))


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: int, fit_tokens: int = FIT_TOKENS) -> np.ndarray:
    """How many items of each length to take so that their sum comes as near to ``budget`` as it can from below.

    Lengths are distinct and positive. Where everything fits, all is taken.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.astype(np.int64)
    if budget <= 0:
        return taken
    # a share of every length, leaving about half the programme's room
    share = max(0.0, (budget - fit_tokens // 2) / total)
    taken = np.floor(counts * share).astype(np.int64)
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths):
        if left <= fit_tokens:
            break
        more = min(int(counts[i] - taken[i]), (left - fit_tokens // 2) // int(lengths[i]))
        if more > 0:
            taken[i] += more
            left -= more * int(lengths[i])
    # bounded knapsack: bit s of ``reach`` says that s tokens can be made; each new sum keeps the stage that made it
    stage_of = np.full(left + 1, -1, dtype=np.int64)
    stages: list[tuple[int, int]] = []
    reach, full = 1, (1 << (left + 1)) - 1
    for i in np.argsort(lengths):
        spare, part = int(min(counts[i] - taken[i], left // lengths[i])), 1
        while spare > 0 and not reach >> left & 1:
            part = min(part, spare)
            fresh = (reach << (part * int(lengths[i]))) & full & ~reach
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes((left >> 3) + 1, "little"), dtype=np.uint8), bitorder="little")
                stage_of[np.flatnonzero(bits[: left + 1])] = len(stages)
                stages.append((i, part))
                reach |= fresh
            spare -= part
            part *= 2
    at = reach.bit_length() - 1
    while at > 0:
        i, part = stages[stage_of[at]]
        taken[i] += part
        at -= part * int(lengths[i])
    return taken


def budgets(histogram: DataFrame, targets: DataFrame, total_tokens: int | None = None, keep_shares: bool = False) -> DataFrame:
    """(recipe, source, target_share, max_repeats, there, share, budget, binding): what each source is to give.

    ``share`` is the target relative to the sum of the recipe's. A recipe's total is ``total_tokens``, or all tokens of
    its listed sources. With ``keep_shares`` sources without documents have no share, and the total is lowered to what
    the scarcest source can give within its repeats (``binding``), so that every share holds.
    """
    sizes = histogram.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("held")).alias("there"))
    goals = targets.join(sizes, "source", "left").withColumn("there", F.coalesce("there", F.lit(0)))
    every = Window.partitionBy("recipe")
    counted = F.when((F.col("there") > 0) | F.lit(not keep_shares), F.col("target_share")).otherwise(0.0)
    goals = goals.withColumn("share", F.coalesce(F.try_divide(counted, F.sum(counted).over(every)), F.lit(0.0)))
    total = F.sum("there").over(every) if total_tokens is None else F.lit(total_tokens)
    most = F.when(F.col("share") > 0, F.floor(F.col("there") * F.col("max_repeats") / F.col("share")))
    goals = goals.withColumns({"total": total, "most": most}).withColumn("least", F.min("most").over(every))
    binding = F.coalesce((F.col("most") == F.col("least")) & (F.col("least") < F.col("total")), F.lit(False))
    kept = F.least("total", "least") if keep_shares else F.col("total")
    return goals.select("recipe", "source", "target_share", "max_repeats", "there", "share", F.round(kept * F.col("share")).cast("long").alias("budget"), binding.alias("binding"))


def plan(histogram: DataFrame, targets: DataFrame, total_tokens: int | None = None, keep_shares: bool = False) -> DataFrame:
    """(recipe, source, n_tokens, repeats, extra): whole repeats of a source, and of each length how many once more.

    A group of the grouped map is the length counts of one source: as many rows as it has distinct lengths, however
    many documents. A source that cannot give its budget within its repeats gives all it may.
    """
    goals = budgets(histogram, targets, total_tokens, keep_shares).filter("there > 0").select("recipe", "source", "there", "budget", "max_repeats")

    def fit(goal: pd.DataFrame, lengths: pd.DataFrame) -> pd.DataFrame:
        out = []
        n, held = lengths["n_tokens"].to_numpy(), lengths["held"].to_numpy()
        for g in goal.itertuples():
            repeats = int(min(g.budget // g.there, g.max_repeats))
            extra = fitted(n, held, int(g.budget - repeats * g.there)) if repeats < g.max_repeats else np.zeros(len(n), dtype=np.int64)
            out.append(pd.DataFrame({"recipe": g.recipe, "source": g.source, "n_tokens": n, "repeats": repeats, "extra": extra}))
        return pd.concat(out) if out else pd.DataFrame({"recipe": [], "source": [], "n_tokens": [], "repeats": [], "extra": []})

    return goals.groupBy("source").cogroup(histogram.groupBy("source")).applyInPandas(fit, "recipe string, source string, n_tokens long, repeats long, extra long")


def mixture(documents: DataFrame, targets: DataFrame, id_column: str = "doc_id", text_column: str = "text", total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 17, keep_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents of each recipe with their repeats, and the shares that came of it.

    ``targets`` (recipe, source, target_share, max_repeats) names at most some thousand sources. Sources compare by
    ``source_key``. First result: (recipe, id, source, n_tokens, repeats), repeats of at least 1 and at most
    max_repeats. Second: (recipe, source, target_share, target_tokens, actual_tokens, actual_share, n_documents, binding).
    The budget is the largest total at which every share holds if ``keep_shares``, else ``total_tokens`` or all tokens
    of the listed sources, of which scarce sources give what they may; ``binding`` marks the scarcest.
    Listed sources without documents have actual share 0; documents of null or unlisted sources, null and blank
    texts are in no mixture; a repeated row counts as one more document. A null or negative share counts as 0, a
    null or negative max_repeats as 0, a repeated target counts once (greatest share). Extra columns are ignored;
    empty tables give empty results.
    """
    wanted = targets.filter("recipe is not null and source is not null").groupBy("recipe", source_key(F.col("source")).alias("source"))
    wanted = wanted.agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"))
    wanted = durable(wanted)
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), source_key(F.col("source")).alias("source"))
    texts = texts.join(F.broadcast(wanted.select("source").distinct()), "source", "left_semi")
    sized = durable(token_counts(texts, "id", "text", F.col("source"), tokenizer))
    histogram = durable(sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("held")))
    takes = durable(plan(histogram, wanted, total_tokens, keep_shares))

    # Rank in the seeded order of one source and length: by part of the hash range, then inside the part.
    order = F.xxhash64(F.lit(seed), "id")
    ranked = sized.withColumn("order", order).withColumn("part", F.pmod(F.shiftrightunsigned("order", 56), F.lit(RANK_PARTS)))
    held = ranked.groupBy("source", "n_tokens", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("source", "n_tokens", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("source", "n_tokens", "part").orderBy("order", "id"))
    ranked = ranked.withColumn("nth", nth).join(held, ["source", "n_tokens", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    chosen = ranked.join(takes, ["source", "n_tokens"])
    repeats = F.col("repeats") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    chosen = chosen.select("recipe", "id", "source", "n_tokens", repeats.alias("repeats")).filter("repeats > 0")

    gained = takes.join(histogram, ["source", "n_tokens"]).groupBy("recipe", "source").agg(
        F.sum(F.col("n_tokens") * (F.col("repeats") * F.col("held") + F.col("extra"))).alias("actual_tokens"),
        F.sum(F.when(F.col("repeats") > 0, F.col("held")).otherwise(F.col("extra"))).alias("n_documents"),
    )
    every = Window.partitionBy("recipe")
    shares = budgets(histogram, wanted, total_tokens, keep_shares).withColumnRenamed("budget", "target_tokens")
    shares = shares.join(gained, ["recipe", "source"], "left").fillna(0, ["actual_tokens", "n_documents"])
    shares = shares.withColumn("actual_share", F.coalesce(F.try_divide("actual_tokens", F.sum("actual_tokens").over(every)), F.lit(0.0)))
    return chosen, shares.select("recipe", "source", "target_share", "target_tokens", "actual_tokens", "actual_share", "n_documents", "binding")
