"""Operator 10: packing into optimal length buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlark.llm.mixing import WORD
from sketchlark.plans.running import running_sums
from sketchlark.plans.scratch import settle

MAX_LEN, N_BUCKETS, TOKEN_BUDGET = 2048, 16, 65_536


def boundaries(histogram: dict[int, int], n_buckets: int = N_BUCKETS) -> list[int]:
    """Upper lengths of at most ``n_buckets`` buckets with the least padding over the histogram, by dynamic programming.

    Padding is the sum over sequences of their bucket's upper length minus their own. Only lengths that occur can be
    boundaries of an optimum. Ties go to the lower boundary.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(n)] for n in lengths], np.float64)
    many = np.concatenate([[0], np.cumsum(counts)])
    n = len(lengths)
    # best[j]: least padded tokens (not yet less the tokens themselves) for the first j lengths.
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(n_buckets, n)):
        cost = best[None, :n] + (many[1:, None] - many[None, :n]) * lengths[:, None]
        cost[np.arange(n)[None, :] > np.arange(n)[:, None]] = np.inf
        came = np.argmin(cost, axis=1)
        best = np.concatenate([[np.inf], cost[np.arange(n), came]])
        back.append(came)
    out, j = [], n
    for came in reversed(back):
        out.append(int(lengths[j - 1]))
        j = int(came[j - 1])
    return out[::-1]


def pack(docs: DataFrame, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sequence: the key, piece, first_token, n_tokens, bucket, bucket_len, padding, batch, slot.

    Tokens are the text's words (runs other than space and x09-x0D). A text of more than ``max_len`` tokens is cut into
    pieces of ``max_len`` and a rest, so every token is in exactly one sequence. The histogram of sequence lengths over
    all rows has at most ``max_len`` entries; dynamic programming over it on the driver chooses bucket lengths with the
    least padding. A batch of bucket b holds floor(budget / bucket_len) sequences (at least one), filled in the order of
    key, text hash and piece; batch counts from 0 within a bucket and slot within a batch, both without gaps.

    Null texts and texts without words give no sequence. Repeated rows are packed as often as they occur. Other columns
    are ignored. An empty table gives an empty result.
    """
    if max_len < 1 or n_buckets < 1 or budget < 1:
        raise ValueError("max_len, n_buckets and budget must be at least 1")
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    whole = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), words.alias("_n"))
    # Counted once: histogram, range bounds and ranges all read the counts.
    whole = settle(whole, "words").where("_n > 0")
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / max_len).cast("long"))))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(max_len).cast("long"), F.col("_n") - F.col("piece") * max_len))
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    ends = boundaries(histogram, n_buckets)
    index = F.size(F.filter(F.array(*(F.lit(e) for e in ends[:-1])), lambda e: e < F.col("n_tokens"))) if len(ends) > 1 else F.lit(0)
    pieces = pieces.withColumns({"bucket": index, "_one": F.lit(1).cast("long")})
    pieces = running_sums(pieces, [F.col("_key"), F.col("_hash"), F.col("piece")], {"_rank": "_one"}, ["bucket"])
    ends = ends or [max_len]
    length = F.element_at(F.array(*(F.lit(e).cast("long") for e in ends)), F.col("bucket") + 1)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / length).cast("long"))
    return pieces.withColumns({"bucket_len": length, "_room": room}).select(
        F.col("_key").alias(key),
        "piece",
        (F.col("piece") * max_len).alias("first_token"),
        "n_tokens",
        "bucket",
        "bucket_len",
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        F.floor(F.col("_rank") / F.col("_room")).alias("batch"),
        (F.col("_rank") % F.col("_room")).alias("slot"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
