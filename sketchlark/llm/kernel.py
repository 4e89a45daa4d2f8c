"""Numpy kernels over the bytes of many texts at once, read straight from Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together until they hold this many bytes; a longer text comes alone and whole.
CHUNK = 1 << 18
#: Running sums over bytes are held for this many at once, whatever the text's length.
BLOCK = 1 << 16
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False)


def _powers(p: int) -> np.ndarray:
    x = np.full(BLOCK + 1, p, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


_POWER, _INVERSE = _powers(_P), _powers(_P_INV)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_sums(n: int, values: Callable[[int, int], np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each [start, end) of 0..n, the sum of value j times P to the (j - start): equal values give equal sums anywhere.

    ``values(a, b)`` gives values a to b - 1. Starts don't decrease, nor do ends, so one pass in blocks serves all; it
    holds one block and what it returns, whatever n is.
    """
    low, high, scale = (np.zeros(len(start), np.uint64) for _ in range(3))
    carry = np.zeros(1, np.uint64)
    for at in range(0, n + 1, BLOCK):
        some = values(at, min(n, at + BLOCK))
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some * _POWER[: len(some)], out=sums[1:])
        sums = sums * np.uint64(pow(_P, at, 1 << 64)) + carry
        carry = sums[-1:]
        here = slice(*np.searchsorted(start, [at, at + BLOCK]))
        place = start[here] - at
        low[here], scale[here] = sums[place], _INVERSE[place] * np.uint64(pow(_P_INV, at, 1 << 64))
        here = slice(*np.searchsorted(end, [at, at + BLOCK]))
        high[here] = sums[end[here] - at]
    return (high - low) * scale


class Chunk:
    """Some texts' bytes, each followed by a space, with the words and lines in them found on demand."""

    def __init__(self, texts: list, fold: np.ndarray = SAME):
        self.n = len(texts)
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.fold = fold

    def words(self) -> None:
        """Sets word_start, word_end (byte positions), word_doc, doc_word (index of each text's first word, and the end)."""
        gap = _SPACE[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate([[0], edge])
        self.word_start, self.word_end = edge[0::2], edge[1::2]
        self.doc_word = np.searchsorted(self.word_start, np.append(self.starts, len(self.data)))
        self.word_doc = np.repeat(np.arange(self.n), np.diff(self.doc_word))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the folded bytes in each [start, end); neither starts nor ends may decrease."""
        table = _BYTE[self.fold]
        raw = range_sums(len(self.data), lambda a, b: table[self.data[a:b]], start, end)
        return mix64(raw ^ (mix64((end - start).astype(np.uint64) + np.uint64(77))))


def chunks(column: pa.Array, fold: np.ndarray = SAME) -> Iterator[tuple[int, Chunk]]:
    """(index of the first text, Chunk) over a string column; a null text counts as empty.

    Texts are read from the column's own buffer, and only one chunk's are copied at a time.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, places, data = column.buffers()
    ends = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(data if data is not None else b"").cast("B")
    at = 0
    while at < len(column):
        # As many texts as fit with a space each, one at least.
        end = int(np.searchsorted(ends[at + 1 :] + np.arange(1, len(column) - at + 1), ends[at] + CHUNK, side="right")) + at
        end = max(end, at + 1)
        yield at, Chunk([data[a:b] for a, b in zip(ends[at:end].tolist(), ends[at + 1 : end + 1].tolist())], fold)
        at = end


def grams(word_hash: np.ndarray, doc_word: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n words in a row within a text, and the text of each. short: fewer words count as one gram."""
    counts = np.diff(doc_word)
    total = len(word_hash)
    size = np.maximum(0, counts - n + 1)
    parts = []
    if total >= n and size.sum():
        acc = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            acc += mix64(word_hash[k : total - n + 1 + k] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(2 * k + 3)
        doc = np.repeat(np.arange(len(counts)), counts)[: total - n + 1]
        inside = np.arange(total - n + 1) <= doc_word[1:][doc] - n
        parts.append((mix64(acc[inside]), doc[inside]))
    if short:
        for d in np.flatnonzero((counts > 0) & (counts < n)):
            acc = np.array([counts[d]], np.uint64)
            for h in word_hash[doc_word[d] : doc_word[d + 1]]:
                acc = mix64(acc ^ h) * np.uint64(0x9E3779B97F4A7C15)
            parts.append((acc, np.array([d])))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
