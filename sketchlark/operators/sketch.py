"""Sampled canonical k-mers of sequences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a sequence that are hashed at once, and k-mers that a task gives away together.
BLOCK, TOGETHER = 1 << 20, 200_000
#: Places whose turns are kept, a multiple of 64.
PLACES = (1 << 16) + 256

#: Published seeds of a rolling nucleotide hash.
SEEDS = {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456}
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}


def rotated(x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Each 64-bit value rotated left by n bits."""
    n = np.asarray(n, np.uint64) & np.uint64(63)
    return (x << n) | (x >> ((np.uint64(64) - n) & np.uint64(63)))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    forward, reverse, known = np.zeros(256, np.uint64), np.zeros(256, np.uint64), np.zeros(256, bool)
    for base in "ACGT":
        for c in (base, base.lower()):
            forward[ord(c)], reverse[ord(c)], known[ord(c)] = SEEDS[base], SEEDS[COMPLEMENT[base]], True
    return forward, reverse, known


_FORWARD, _REVERSE, _KNOWN = _tables()
#: What a letter adds at each place of 64: row by place, then letter.
_FORWARD_AT = np.concatenate([rotated(_FORWARD, 64 - i) for i in range(64)])
_REVERSE_AT = np.concatenate([rotated(_REVERSE, i) for i in range(64)])


def threshold(ratio: float) -> int:
    """Hashes up to this are sampled."""
    return (1 << 64) - 1 if ratio >= 1 else int(ratio * 2.0**64)


@lru_cache(maxsize=8)
def _places(k: int) -> tuple[np.ndarray, ...]:
    """For each of many places: its row in the tables above, and how far both strands' windows that begin there turn left and right."""
    at = np.arange(PLACES)
    turns = [(by & 63).astype(np.uint64) for by in (at + k - 1, 64 - at - k + 1, 64 - at, at)]
    return ((at & 63) << 8, *turns)


def _upto(v: np.ndarray, n: int) -> np.ndarray:
    return v[:n] if n <= len(v) else np.resize(v, n)


def kmers(seq: bytes, k: int, ratio: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the last base, hash, strand) of the sampled k-mers; those with other letters than ACGT are left out.

    Both strands' hashes of all windows come from two running exclusive-ors, each base rotated by its place in the
    sequence, which a window's place undoes.
    """
    s = np.frombuffer(seq, np.uint8)
    n = len(s) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    row, fw_left, fw_right, rc_left, rc_right = _places(k)
    row = _upto(row, len(s)) | s
    x, y = np.zeros(len(s) + 1, np.uint64), np.zeros(len(s) + 1, np.uint64)
    np.bitwise_xor.accumulate(_FORWARD_AT[row], out=x[1:])
    np.bitwise_xor.accumulate(_REVERSE_AT[row], out=y[1:])
    turn = lambda v, left, right: (v << _upto(left, n)) | (v >> _upto(right, n))
    fw = turn(x[k:] ^ x[:n], fw_left, fw_right)
    rc = turn(y[k:] ^ y[:n], rc_left, rc_right)
    h = fw ^ rc
    keep = np.flatnonzero(h <= np.uint64(threshold(ratio)))
    bad = np.concatenate([[0], np.cumsum(~_KNOWN[s], dtype=np.int64)])
    keep = keep[bad[keep + k] == bad[keep]]
    return keep + k - 1, h[keep], fw[keep] > rc[keep]


def sketch(df: DataFrame, key: str, seq: str, k: int, ratio: float, block: int = BLOCK) -> DataFrame:
    """(key, tpos, r, h, strand): one row per sampled k-mer, tpos counting them from 0 within a sequence.

    A sequence stays in its task, so nothing is shuffled; a null or short sequence gives no row. A sequence of any length
    is read in blocks of ``block`` letters that share k - 1, so a task holds one block's arrays and the letters.
    """
    kind = df.schema[key].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for i, s in enumerate(batch.column(1)):
                letters, tpos = (s.as_py() or "").encode("latin-1", "replace"), 0
                for at in range(0, max(len(letters) - k + 1, 0), block):
                    r, h, strand = kmers(letters[at : at + block + k - 1], k, ratio)
                    rows.append((np.full(len(r), i), np.arange(tpos, tpos + len(r)), r + at, h, strand))
                    tpos += len(r)
                    held += len(r)
                    if held > TOGETHER:
                        yield pack(batch, rows)
                        rows, held = [], 0
            if held:
                yield pack(batch, rows)

    def pack(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        i, tpos, r, h, strand = (np.concatenate(x) for x in zip(*rows))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(tpos.astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(strand)], [key, "tpos", "r", "h", "strand"])

    return df.select(key, seq).mapInArrow(make, f"`{key}` {kind}, tpos int, r int, h long, strand boolean")


def sketch_stats(kmers_df: DataFrame, segments: DataFrame, seq: str) -> DataFrame:
    """sequences, bases and sampled k-mers."""
    a = segments.agg(F.count("*").alias("sequences"), F.coalesce(F.sum(F.length(seq)), F.lit(0)).alias("bases"))
    return a.crossJoin(kmers_df.agg(F.count("*").alias("kmers"), F.countDistinct("h").alias("distinct_kmers")))
