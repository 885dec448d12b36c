"""Keyword-stuffed pages, link lists and tag lists.

Each page is cut into segments (sentences, list items, table cells, links, separated keywords) and read as two strings:
its words, and its layout, in which a short item is one symbol whatever it says. The suffix automaton of each tells
which characters of the page lie in repeated maximal substrings: keywords said again and again in the first, lists of
links or tags in the second. Covered characters count unless their segment has clause structure. No word list and no
language is known: a clause is a stretch of several words, not cut into short pieces, most of which are not said again
and again close by.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm.automaton import repeat_lengths
from lorekiln.llm.words import WORD

_FRONTMATTER = re.compile(r"\A\s*---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?^[ \t]*\1[^\n]*$", re.S | re.M)
_ANCHOR = re.compile(r"<a\b(?:[^>]*?href\s*=\s*[\"']?([^\"'\s>]*))?[^>]*>(.*?)</a\s*>", re.S | re.I)
_TAG = re.compile(r"</?(li|ul|ol|p|div|br|tr|td|th|h[1-6]|table)\b[^>]*>", re.I)
_OTHER_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(([^()\s]*)\)|\[\[([^\[\]\n]*)\]\]|<?((?:https?://|www\.)[^\s<>|\x01-\x03]+)>?")
#: Where a link's target is kept behind its text, up to the link's end.
_TARGET = re.compile("\x03[^\x02]*")
_WHOLE_LINK = re.compile("\x01[^\x01-\x03]*\x03[^\x02]*\x02")
_HASHTAG = re.compile(r"(?<!\S)#(?=[^\W_])")
_MARK = re.compile(r"^(?:\s|>|[-*+•](?=\s)|\d{1,3}[.)](?=\s)|\[[ xX]\])+")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s+\S")
_RULE = re.compile(r"^[\s|:\-=*_]+$")
_STOPS = re.compile(r"(?<=[.!?…])[\"'”»)*_]*\s+|(?<=[。！？])")
_PARTS = re.compile("[\x01\x02|;·•\t、，；]+|,\\s|\\s[-/>»→–—]+\\s")
#: Letters of scripts that set no blanks between words; two of them are taken for a word.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")

#: Occurrences that make a string a repeated one, and items of the shortest layout that counts.
REPEATS, RUN_ITEMS = 3, 4
#: Words of the longest item of a list, of the longest text of a link without a sentence, and of the shortest clause.
ITEM_WORDS, LINK_WORDS, CLAUSE_WORDS = 5, 12, 5
#: Share of a block's characters in clauses from which its short items belong to these.
BESIDE = 0.25
#: A word is dense where so many occurrences of it lie within so many words.
DENSE_TIMES, NEAR_WORDS = 5, 60
#: Least share of a clause's characters in words that are not dense.
CLAUSE_FRESH = 0.5
#: A clause with at least this share of different words is none of keywords, dense or not, if it has so many words, or
#: so many with one among them that the page says no more than so often.
FULL_DIVERSITY, FULL_WORDS, SHORT_WORDS, RARE_TIMES = 0.75, 12, 8, 2


@dataclass
class Segment:
    """Words of one sentence, item or cell; kind: clause (if its words allow it), item (short), loose (long) or none.

    ``target`` holds the words of a link's target, ``layout`` what surrounds the segment in the page's layout.
    """

    words: list[str]
    kind: str
    layout: str = ""
    target: tuple[str, ...] = ()
    block: int = 0

    @property
    def chars(self) -> int:
        return sum(map(len, self.words)) + sum(map(len, self.target))


def _size(words: list[str], text: str) -> float:
    """Number of the words of a text, those of scripts without blanks estimated."""
    if text.isascii() or not _UNSPACED.search(text):
        return len(words)
    return sum(max(1.0, len(_UNSPACED.findall(w)) / 2) for w in words)


def _blocks(text: str) -> Iterator[str]:
    """List items, table rows and headings one by one; wrapped lines of a paragraph together."""
    held: list[str] = []
    for line in [*text.split("\n"), ""]:
        bare = _MARK.sub("", line)
        plain = bool(line.strip()) and not _RULE.match(line)
        own = plain and (_HEADING.match(line) or "|" in line or (bare != line and not line.lstrip().startswith(">") and bare != line.lstrip()))
        if held and (own or not plain):
            yield "\n".join(held)
            held = []
        if own:
            yield line if _HEADING.match(line) else bare
        elif plain:
            held.append(bare)


def _link(text: str, target: str) -> str:
    return f"\x01{text}\x03{' '.join(WORD.findall(target.lower()))}\x02"


def segments(text: str) -> list[Segment]:
    """The page's segments: frontmatter, text with headings, and fenced code, whose words are of no kind."""
    text = text.replace("\r\n", "\n")
    out: list[Segment] = []
    if front := _FRONTMATTER.match(text):
        out += _front(front[0])
        text = text[front.end() :]
    code = [w for m in _FENCE.finditer(text) for w in WORD.findall(m[0].lower())]
    text = _FENCE.sub("\n", text)
    if "<" in text:
        text = _OTHER_TAG.sub(" ", _TAG.sub("\n", _ANCHOR.sub(lambda m: _link(m[2], m[1] or ""), text)))
    text = _HASHTAG.sub("\x01", _LINK.sub(lambda m: _link(m[1] or m[3] or "", m[2] or m[4] or ""), text))
    for number, block in enumerate(_blocks(text), 1):
        for sentence in _STOPS.split(block):
            words = WORD.findall(_TARGET.sub(" ", sentence).lower())
            if _size(words, sentence) >= CLAUSE_WORDS and not _listed(sentence, words) and WORD.search(_WHOLE_LINK.sub("", sentence)):
                out.append(Segment(words, "clause", block=number))
                continue
            for part in _PARTS.split(sentence):
                shown, _, target = part.partition("\x03")
                words, behind = WORD.findall(shown.lower()), tuple(target.split())
                if words or behind:
                    long = _size(words, shown) > (LINK_WORDS if behind else ITEM_WORDS)
                    layout = "link" if behind else "mark" if "\x01" in sentence else "item"
                    out.append(Segment(words, "clause" if long else "item", layout, behind, number))
    return [*out, Segment(code, "none")] if code else out


def _front(text: str) -> list[Segment]:
    """Keys and single values are of no kind, the elements of lists are segments like any other."""
    out = []
    for line in text.split("\n"):
        key, inner = "", line
        if m := re.match(r"\s*([^\s:\[\]-][^:\[\]]*):(.*)", line):
            key, inner = m[1], m[2].strip()
            if not inner.startswith("[") and inner.count(",") <= RUN_ITEMS:
                key, inner = line, ""
        if words := WORD.findall(key.lower()):
            out.append(Segment(words, "none"))
        for part in inner.split(","):
            if words := WORD.findall(part.lower()):
                out.append(Segment(words, "item" if _size(words, part) <= ITEM_WORDS else "clause", "front"))
    return out


def _listed(sentence: str, words: list[str]) -> bool:
    """Whether a segment is cut by separators into pieces too short to be clauses."""
    pieces = [p for p in _PARTS.split(_TARGET.sub("", sentence)) if p.strip()]
    return len(pieces) > RUN_ITEMS and _size(words, sentence) / len(pieces) < ITEM_WORDS


def _symbols(parts: list[Segment]) -> tuple[list[int], list[int]]:
    """The page's words as numbers, all numerals alike, with a mark of its own after each segment; and the places of words."""
    number: dict[str, int] = {}
    out: list[int] = []
    places = []
    for s in parts:
        for w in (*s.words, *s.target):
            places.append(len(out))
            out.append(number.setdefault("0" if w.isdigit() else w, len(number)))
        # no repeat reaches across
        out.append(-len(out) - 1)
    return out, places


def _dense(symbols: list[int], places: list[int]) -> list[bool]:
    """For each word whether ``DENSE_TIMES`` occurrences of it, this one among them, lie within ``NEAR_WORDS`` words."""
    seen: dict[int, list[int]] = {}
    dense = [False] * len(places)
    for i, at in enumerate(places):
        mine = seen.setdefault(symbols[at], [])
        mine.append(i)
        if len(mine) >= DENSE_TIMES and i - mine[-DENSE_TIMES] < NEAR_WORDS:
            for j in mine[-DENSE_TIMES:]:
                dense[j] = True
    return dense


def _settle(parts: list[Segment]) -> None:
    """Takes clause structure from segments that say the same words again and again, and short items from sentences.

    A sentence said twice is judged once, so that a repeated sentence is not taken for keywords.
    """
    told: dict[tuple, Segment] = {}
    first = [s for s in parts if s.kind != "none" and told.setdefault((s.kind, *s.words, *s.target), s) is s]
    symbols, places = _symbols(first)
    dense, at = _dense(symbols, places), 0
    times = Counter(symbols)
    for s in first:
        n = len(s.words) + len(s.target)
        if s.kind == "clause":
            fresh = sum(len(w) for w, d in zip(s.words, dense[at : at + n], strict=False) if not d)
            rare = any(times[symbols[p]] <= RARE_TIMES for p in places[at : at + len(s.words)])
            full = len(s.words) >= (SHORT_WORDS if rare else FULL_WORDS) and len(set(s.words)) >= FULL_DIVERSITY * len(s.words)
            if not full and fresh < CLAUSE_FRESH * sum(map(len, s.words)):
                s.kind = "loose"
        at += n
    for s in parts:
        if s.kind == "clause":
            s.kind = told[("clause", *s.words, *s.target)].kind
    size, told_in = Counter(), Counter()
    for s in parts:
        size[s.block] += sum(map(len, s.words))
        told_in[s.block] += sum(map(len, s.words)) if s.kind == "clause" else 0
    for s in parts:
        # labels, table cells and links beside a sentence belong to it
        if s.kind == "item" and s.block and told_in[s.block] > BESIDE * size[s.block]:
            s.kind = "none"


def measured(text: str, limit: float = 0.5) -> tuple[int, int, float]:
    """(characters of words, covered ones without clause structure, share) of a page, all of its words counted.

    The automata are built only where the share could pass ``limit``: no more than words said ``REPEATS`` times,
    numerals and short items can be covered.
    """
    parts = segments(text)
    total = sum(s.chars for s in parts)
    if not total:
        return 0, 0, 0.0
    counts = Counter(w for s in parts for w in (*s.words, *s.target))
    loose = Counter(w for s in parts if s.kind == "clause" for w in (*s.words, *s.target))
    most = sum(s.chars for s in parts if s.kind == "item") + sum(len(w) * n for w, n in loose.items() if counts[w] >= REPEATS or w.isdigit())
    if most <= limit * total:
        return total, 0, 0.0
    _settle(parts)
    if sum(s.chars for s in parts if s.kind in ("item", "loose")) <= limit * total:
        return total, 0, 0.0
    parts = [s for s in parts if s.kind != "none"]
    listed = _covered(repeat_lengths([-i - 1 if s.kind != "item" else sum(map(ord, s.layout)) for i, s in enumerate(parts)], REPEATS), RUN_ITEMS)
    symbols, _ = _symbols(parts)
    said = _covered(repeat_lengths(symbols, REPEATS), 1)
    stuffed = at = 0
    for s, in_list in zip(parts, listed, strict=True):
        words = (*s.words, *s.target)
        if s.kind != "clause":
            stuffed += s.chars if in_list else sum(len(w) for w, c in zip(words, said[at : at + len(words)], strict=True) if c)
        at += len(words) + 1
    return total, stuffed, stuffed / total


def _covered(ends: list[int], least: int) -> list[bool]:
    """Which places lie in repeated strings of at least ``least`` symbols, given the longest one that ends at each."""
    out, reach = [False] * len(ends), 0
    for i in range(len(ends) - 1, -1, -1):
        if ends[i] >= least:
            reach = max(reach, ends[i])
        out[i] = reach > 0
        reach = max(0, reach - 1)
    return out


def stuffed_pages(documents: DataFrame, id_column: str, text_column: str, limit: float = 0.5) -> DataFrame:
    """(id, n_chars, n_covered, share): pages of whose words' characters more than ``limit`` is stuffed.

    A link beside a sentence, a table or list of sentences and a links section below a note do not count. Null and
    empty texts give no rows; a repeated row is judged again; extra columns are ignored. No shuffle: each page is
    judged alone, whatever its length.
    """
    texts = documents.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).filter(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, stuffed, share = measured(text, limit)
                if share > limit:
                    out.append((name, total, stuffed, share))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema=schema)

    schema = pa.schema([("id", pa.string()), ("n_chars", pa.int32()), ("n_covered", pa.int32()), ("share", pa.float64())])
    return texts.mapInArrow(run, "id string, n_chars int, n_covered int, share double")
