"""Evaluation texts that leak into training text.

A generalised suffix automaton of the normalised test items; the words of every training text stream through it and
the length of the longest match is known at each word. Items are a bounded set: they are taken in blocks of at most
``block_words`` words, one automaton and one scan of the texts for each block.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm.automaton import SuffixAutomaton
from lorekiln.session import durable

#: Words of a block of items: its automaton takes some 0.9 KB a word on the driver and in every Python worker.
BLOCK_WORDS = 200_000
#: A word with its combining marks, if they stand apart.
TOKEN = re.compile(r"(?:[^\W_][\u0300-\u036f]*)+")
_MARKS = re.compile(r"[\u0300-\u036f]+")


def plain(word: str) -> str:
    """Lower case, without accents; đ is d."""
    word = word.lower()
    return word if word.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", word)).replace("đ", "d")


class ItemAutomaton(SuffixAutomaton):
    """Generalised suffix automaton over words; each state knows the items that contain its strings."""

    def __init__(self, items: list[tuple[object, list[str]]], least: int) -> None:
        super().__init__()
        self.least, self.vocabulary = least, {}
        ends = [self.feed(self.vocabulary.setdefault(word, len(self.vocabulary)) for word in words) for _, words in items]
        held: list[set] = [set() for _ in self.next]
        for (item, _), own in zip(items, ends, strict=True):
            for state in own:
                while state > 0 and item not in held[state]:
                    held[state].add(item)
                    state = self.link[state]
        # The items that hold the last ``least`` words of a match are those of its shortest suffix state that long.
        self.items: list[tuple] = [()] * len(self.next)
        for state in self.by_length():
            if self.length[state] >= least:
                up = self.link[state]
                self.items[state] = self.items[up] if self.length[up] >= least else tuple(sorted(held[state]))

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int, tuple]]:
        """(position, longest match ending there, items of its last ``least`` words), where that is long enough."""
        state = matched = 0
        follow, link, length, least = self.next, self.link, self.length, self.least
        for position, word in enumerate(ids):
            while state and word not in follow[state]:
                state = link[state]
                matched = length[state]
            if word in follow[state]:
                state = follow[state][word]
                matched += 1
                if matched >= least:
                    # the state may hold longer strings than the match: climb to the one that holds it
                    while length[link[state]] >= matched:
                        state = link[state]
                    yield position, matched, self.items[state]


class _Ids(dict):
    """Word as written -> its number in the automaton's vocabulary, -1 if it has none."""

    def __init__(self, vocabulary: dict[str, int], limit: int = 500_000) -> None:
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.vocabulary.get(plain(word), -1)
        return value


def _runs(ids: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Stretches of at least ``least`` words that are all in the vocabulary."""
    edges = np.flatnonzero(np.diff(np.r_[0, (ids >= 0).view(np.int8), 0]))
    for start, stop in zip(edges[::2], edges[1::2], strict=True):
        if stop - start >= least:
            yield int(start), int(stop)


def _matched(a: ItemAutomaton, numbers: _Ids, words: list[str]) -> dict[object, list]:
    """For each item met in a text: the longest match, and the stretches [first, last] of matches of ``least`` words."""
    found: dict[object, list] = {}
    if len(words) < a.least:
        return found
    ids = np.fromiter((numbers[w] for w in words), dtype=np.int32, count=len(words))
    for start, stop in _runs(ids, a.least):
        for position, matched, items in a.matches(ids[start:stop].tolist()):
            first, last = start + position - a.least + 1, start + position
            for item in items:
                mine = found.setdefault(item, [0, []])
                mine[0] = max(mine[0], matched)
                if mine[1] and mine[1][-1][1] >= first - 1:
                    mine[1][-1][1] = last
                else:
                    mine[1].append([first, last])
    return found


def _scan(texts: DataFrame, automaton: ItemAutomaton) -> DataFrame:
    """(id, item_id, longest, spans): spans are [first, last] word positions of each stretch, in text order."""
    shared = texts.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        numbers = _Ids(a.vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _matched(a, numbers, TOKEN.findall(text))
                out += [(name, item, longest, stretches) for item, (longest, stretches) in found.items()]
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema=schema)

    schema = pa.schema([("id", pa.string()), ("item_id", pa.string()), ("longest", pa.int32()), ("spans", pa.list_(pa.list_(pa.int32())))])
    return texts.mapInArrow(run, "id string, item_id string, longest int, spans array<array<int>>")


def leaked_spans(documents: DataFrame, id_column: str, text_column: str, items: DataFrame, item_id: str, item_text: str, least: int = 12, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item_id, longest, spans): texts that hold ``least`` or more consecutive words of an item.

    ``spans`` are the word stretches [first, last] covered by such matches with the item; ``longest`` bounds the
    longest match met there. Words are runs of letters and digits, lower-cased, without accents (đ is d);
    everything else is ignored. Null and short texts and items match nothing; rows of one item id count as one
    item, unless they fall into two blocks, which then give a row each; a repeated text counts again; an empty
    side gives no rows. Ids are compared as strings. Driver and broadcast hold one block of items, at
    most ``block_words`` words and the item that goes beyond; texts are never shuffled.
    """
    texts = documents.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).filter(F.length("text") >= 2 * least - 1)
    found = None
    for automaton in _automata(items, item_id, item_text, least, block_words):
        found = _with(found, _scan(texts, automaton))
    return found


def _automata(items: DataFrame, item_id: str, item_text: str, least: int, block_words: int) -> Iterator[ItemAutomaton]:
    """One automaton for each block of items, at least one."""
    held, size, made = [], 0, False
    for row in items.select(F.col(item_id).cast("string"), item_text).filter(F.col(item_text).isNotNull()).toLocalIterator():
        words = [plain(w) for w in TOKEN.findall(row[1])]
        if len(words) >= least:
            held.append((row[0], words))
            size += len(words)
        if size >= block_words:
            yield ItemAutomaton(held, least)
            held, size, made = [], 0, True
    if held or not made:
        yield ItemAutomaton(held, least)


def _with(found: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if found is None else found.unionByName(more)


def cleaned_texts(
    documents: DataFrame, id_column: str, text_column: str, items: DataFrame, item_id: str, item_text: str, least: int = 12, max_words: int = 12, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(id, text, removed_words, dropped): ``decontaminated`` by the matches of ``leaked_spans``, in the same scan.

    Each block of items adds its stretches to the rows as they pass; nothing is shuffled or joined.
    """
    rows = documents.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"), F.array().cast("array<array<int>>").alias("cuts"))
    for automaton in _automata(items, item_id, item_text, least, block_words):
        rows = _marked(rows, automaton, max_words)
    return _cut(rows, max_words, max_coverage)


def _marked(rows: DataFrame, automaton: ItemAutomaton, max_words: int) -> DataFrame:
    """(id, text, cuts) with the stretches of one block of items added to ``cuts``."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        numbers = _Ids(a.vocabulary)
        for batch in batches:
            cuts = []
            for text, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = _matched(a, numbers, TOKEN.findall(text or ""))
                cuts.append(known + [s for _, stretches in found.values() for s in stretches if s[1] - s[0] + 1 >= max_words])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.list_(pa.list_(pa.int32())))], names=["id", "text", "cuts"])

    return rows.mapInArrow(run, "id string, text string, cuts array<array<int>>")


def decontaminated(documents: DataFrame, id_column: str, text_column: str, found: DataFrame, max_words: int = 12, max_coverage: float = 0.5) -> DataFrame:
    """(id, text, removed_words, dropped): texts without the leaked stretches of ``found``.

    Stretches of ``max_words`` or more words are cut out, together with what stands between their words; where they
    cover more than ``max_coverage`` of a text's words it is dropped (text null). Other texts come back unchanged.
    """
    cuts = durable(found.select("id", F.explode("spans").alias("span")).groupBy("id").agg(F.collect_set("span").alias("cuts")))
    rows = documents.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).join(cuts, "id", "left")
    touched, clean = rows.filter("cuts is not null"), rows.filter("cuts is null")
    cut = _cut(touched.select("id", "text", "cuts"), max_words, max_coverage)
    return cut.unionByName(clean.select("id", "text", F.lit(0).alias("removed_words"), F.lit(False).alias("dropped")))


def _cut(rows: DataFrame, max_words: int, max_coverage: float) -> DataFrame:
    """Cuts the stretches ``cuts`` out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, text, cuts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not cuts or text is None:
                    out.append((name, text, 0, False))
                    continue
                at = [m.span() for m in TOKEN.finditer(text)]
                gone = np.zeros(len(at), dtype=bool)
                for first, last in cuts:
                    gone[first : last + 1] |= last - first + 1 >= max_words
                edges = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
                kept, before = [], 0
                for first, stop in zip(edges[::2], edges[1::2], strict=True):
                    kept.append(text[before : at[first][0]])
                    before = at[stop - 1][1]
                dropped = bool(gone.sum() > max_coverage * max(1, len(at)))
                out.append((name, None if dropped else "".join([*kept, text[before:]]), int(gone.sum()), dropped))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema=schema)

    schema = pa.schema([("id", pa.string()), ("text", pa.string()), ("removed_words", pa.int32()), ("dropped", pa.bool_())])
    return rows.mapInArrow(run, "id string, text string, removed_words int, dropped boolean")
