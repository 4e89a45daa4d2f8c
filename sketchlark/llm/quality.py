"""Operator 4: base rules and a hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlark.llm.kernel import CHUNK, Chunk, chunks, grams
from sketchlark.plans.names import neutral, with_fields

N_BUCKETS, GRAM, THRESHOLD, SMOOTHING = 1 << 16, 3, -0.1, 1.0
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
SCALE = 1 << 32
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>")).astype(np.uint8)
#: First bytes of characters other than white space.
_WORD_CHAR = ((np.arange(256) & 0xC0 != 0x80) & ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])).astype(np.uint8)


def _buckets(c: Chunk, n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text of each run of GRAM bytes within a text, the space after the text included, in parts of CHUNK."""
    for at in range(0, len(c.data) - GRAM + 1, CHUNK):
        b = c.data[at : at + CHUNK + GRAM - 1].astype(np.uint32)
        n = len(b) - GRAM + 1
        x = b[:n].copy()
        for k in range(1, GRAM):
            x *= np.uint32(257)
            x += b[k : n + k]
        x *= np.uint32(0x9E3779B1)
        x >>= np.uint32(32 - int(n_buckets).bit_length() + 1)
        # The last GRAM - 1 places of a text start no run within it.
        lengths = np.clip(c.ends - GRAM + 1, at, at + n) - np.clip(c.starts, at, at + n)
        inside = np.ones(n, bool)
        for k in range(1, GRAM):
            last = c.ends - k
            inside[last[(last >= at) & (last < at + n)] - at] = False
        yield x[inside], np.repeat(np.arange(c.n), np.maximum(lengths, 0))


def gram_counts(docs: DataFrame, trusted: DataFrame, n_buckets: int = N_BUCKETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, trusted_n, raw_n: counts of hashed byte n-grams over every whole text, and over those of trusted keys.

    Texts meet the trusted keys in a merge join at every size, as no bound is known for these; each task then sums its
    own texts before anything else is shuffled.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    good = trusted.select(F.col(key).alias("_good")).where("_good is not null").distinct().hint("merge")
    rows = rows.join(good, F.col("_key") == F.col("_good"), "left").select("_text", F.col("_good").isNotNull().alias("_trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n_buckets), np.int64)
        for batch in batches:
            flag = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for at, c in chunks(batch.column(0)):
                for x, doc in _buckets(c, n_buckets):
                    sums[1] += np.bincount(x, minlength=n_buckets)
                    sums[0] += np.bincount(x[flag[at : at + c.n][doc]], minlength=n_buckets)
        some = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0][some]), pa.array(sums[1][some])], ["bucket", "trusted_n", "raw_n"])

    made = rows.mapInArrow(count, "bucket long, trusted_n long, raw_n long")
    return made.groupBy("bucket").agg(F.sum("trusted_n").alias("trusted_n"), F.sum("raw_n").alias("raw_n"))


def log_ratios(counts: DataFrame, n_buckets: int = N_BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | raw) with added ``smoothing``; at most n_buckets rows come to the driver."""
    t, r = np.zeros(n_buckets), np.zeros(n_buckets)
    for bucket, a, b in counts.collect():
        t[bucket], r[bucket] = a, b
    if not t.sum():
        return np.zeros(n_buckets)
    # The raw counts are scaled to the trusted total, so that a bucket without any trusted count weighs by its raw rate.
    r = r * (t.sum() / r.sum())
    return np.log(t + smoothing) - np.log(r + smoothing)


def _repeats(c: Chunk, words: np.ndarray) -> np.ndarray:
    """Per text, the words in WINDOW-word windows that occur twice or more in it."""
    g, doc = grams(words, c.doc_word, WINDOW, False)
    hit = np.zeros(len(words) + 1, np.int64)
    if len(g):
        first = np.flatnonzero(np.arange(len(words)) <= c.doc_word[1:][c.word_doc] - WINDOW)
        own = g + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(g), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = first[twice]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1] > 0)])
    return covered[c.doc_word[1:]] - covered[c.doc_word[:-1]]


def _dup_lines(c: Chunk) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    ends = np.union1d(np.flatnonzero(c.data == 10), c.ends - 1)
    starts = np.concatenate([[0], ends[:-1] + 1])
    with_word = np.searchsorted(c.word_start, ends) > np.searchsorted(c.word_start, starts)
    starts, ends = starts[with_word], ends[with_word]
    doc = np.searchsorted(c.ends, starts, side="right")
    own = c.hashes(starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first = np.unique(own, return_index=True)
    again = np.ones(len(own), bool)
    again[first] = False
    return np.bincount(doc[again], minlength=c.n)


def scored(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed and kept.

    llr is the mean log ratio over a text's byte n-grams (0 if it has none); ratios are summed as whole multiples of
    1 / SCALE, so it doesn't depend on what texts are read together. kept is false if the base rules fail, else
    llr >= threshold. A null text counts as empty; columns that clash with the added ones are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]
    rows, (body,), back = neutral(docs, text, without=[*added, "base_failed", "kept"])
    where = rows.columns.index(body)
    whole, n_buckets = np.rint(ratios * SCALE).astype(np.int64), len(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(batch.num_rows, np.int64) for _ in added[:-1]] + [np.zeros(batch.num_rows)]
            for at, c in chunks(batch.column(where)):
                c.words()
                per_text = lambda x, c=c: np.add.reduceat(x, c.starts, dtype=np.int64)
                n, total = np.zeros(c.n, np.int64), np.zeros(c.n, np.int64)
                for x, doc in _buckets(c, n_buckets):
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    if len(first):
                        n[doc[first]] += np.diff(np.append(first, len(doc)))
                        total[doc[first]] += np.add.reduceat(whole[x], first)
                values = [np.diff(c.doc_word), per_text(_WORD_CHAR[c.data]), per_text(_SYMBOL[c.data]), _dup_lines(c), _repeats(c, c.hashes(c.word_start, c.word_end)), total / np.maximum(n, 1) / SCALE]
                for f, v in zip(found, values):
                    f[at : at + c.n] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*batch.schema.names, *added])

    out = rows.mapInArrow(score, with_fields(rows, ", ".join(f"{a} long" for a in added[:-1]) + ", llr double"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return back(out, *added, failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"))


def trusted_keys(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys labelled as of high quality and not toxic in some row."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(key)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``docs`` with the columns of ``scored``, by ratios counted over all of ``docs`` and all trusted rows of ``labels``.

    Without trusted rows all ratios are 0 and the base rules decide alone. Keys that are null are never trusted. The
    result doesn't depend on row order or partitions: counts are integers. An empty table gives an empty result.
    """
    return scored(docs, log_ratios(gram_counts(docs, trusted_keys(labels), n_buckets), n_buckets), threshold)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))
