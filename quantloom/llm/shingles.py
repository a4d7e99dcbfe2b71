"""Word shingles of whole texts as sorted distinct 64-bit hashes, computed on byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quantloom.llm.common import HASH_A, U64, byte_blocks, mixed

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP = U64(0x9FB21C651E98DF25)


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+, and the index of each row's first word."""
    solid = ~IS_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at[(at < len(raw))]] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z lower-cased, and the index of each row's first word."""
    if not len(raw):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    start, end, first = word_bounds(raw, at)
    prefix = HASH_A.prefix(LOWER[raw])
    return HASH_A.ranges(prefix, start, end), first


def joined(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each start."""
    out = words[starts]
    for k in range(1, n):
        out = mixed(out * STEP + words[starts + k])
    return out


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row.

    Shingles are n words; a text of fewer words has its whole word sequence as its one shingle, a text without words none.
    """
    for lo, hi, raw, at in byte_blocks(column):
        words, first = word_hashes(raw, at)
        grams = joined(words, np.arange(max(0, len(words) - n + 1)), n)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= n:
                yield lo + i, np.unique(grams[a : b - n + 1])
            elif b > a:
                yield lo + i, joined(words, np.array([a]), int(b - a)) ^ U64(int(b - a))
            else:
                yield lo + i, np.zeros(0, U64)
