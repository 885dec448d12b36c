"""Words and word-shingle hashes, vectorised over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """Word -> 64-bit hash, filled on first use and emptied when it has grown past ``limit``."""

    def __init__(self, limit: int = 500_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    out = values ^ (values >> np.uint64(29))
    out = out * np.uint64(_MIX[3])
    return out ^ (out >> np.uint64(32))


def shingles(lists: Sequence[list[str]], width: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word sequences of every list, and the list each came from (ascending)."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    total = int(sizes.sum())
    flat = np.fromiter((hashes[w] for one in lists for w in one), dtype=np.uint64, count=total)
    if total < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    acc = np.zeros(total - width + 1, dtype=np.uint64)
    for i in range(width):
        acc = mixed(acc * np.uint64(_MIX[4]) + flat[i : total - width + 1 + i] * np.uint64(_MIX[i % 3]))
    inside = owner[: total - width + 1] == owner[width - 1 :]
    return acc[inside], owner[: total - width + 1][inside]
