"""Operator 1: shards of equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlark.plans.running import running_sums

N_SHARDS = 8


def shard(docs: DataFrame, n_shards: int = N_SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, size, text_crc32, shard, slot and first_byte.

    Size is the text's UTF-8 bytes plus 1 (null text: 1). Rows are ordered by the key (nulls first), then the text's
    checksum, hash and size, which makes ties differ only between rows that are the same. Running sums of size over this
    order come from totals per range; the running sum's middle of a row, times the shards, divided by all bytes, is its
    shard. Shards are thus contiguous in the key and each is within half of its outermost rows of the equal target.
    slot counts a shard's rows from 0 without gaps. The text itself isn't shuffled, only its size and sums.

    Nulls, empty and repeated rows are rows like others; an empty table gives an empty result; other columns are
    ignored. A row larger than a shard's target stays whole, which can leave a shard empty.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("_hash"),
        F.lit(1).cast("long").alias("_one"),
    )
    order = [F.col("_key"), F.col("text_crc32"), F.col("_hash"), F.col("size")]
    rows = running_sums(rows, order, {"first_byte": "size", "_row": "_one"})
    total = rows.agg(F.sum("size")).first()[0] or 1
    middle = F.col("first_byte").cast("decimal(38,0)") * 2 + F.col("size")
    cut = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(2 * total).cast("decimal(38,0)")).cast("int"))
    rows = rows.withColumn("shard", cut)
    first = F.broadcast(rows.groupBy("shard").agg(F.min("_row").alias("_first")).withColumnRenamed("shard", "_shard"))
    rows = rows.join(first, F.col("shard") == F.col("_shard"))
    return rows.select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"), "first_byte")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
