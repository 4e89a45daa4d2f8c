"""Joins with a table of one row per key, where a few keys may hold most rows of the other side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / HEAVY of all rows, and more than LEAST, is looked up by broadcast: of these there are fewer than HEAVY.
HEAVY, LEAST = 1000, 64


def lookup(left: DataFrame, right: DataFrame, keys: list[str], value: str, times: str, spread: list[Column], total: int | None = None) -> DataFrame:
    """``left`` with the column ``value`` of the row of ``right`` that has the same long ``keys``, or null.

    ``right`` has one row per key, and in ``times`` how many rows of left have it; it is read three times. No task gets
    more than about 1 / HEAVY of left's rows by a key: rows of heavier keys have their value by then, and are dealt by a
    hash of ``spread`` instead, which only has to differ between them.
    """
    if total is None:
        total = right.agg(F.sum(times)).first()[0] or 0
    least = max(LEAST, -(-total // HEAVY))
    heavy = right.where(F.col(times) > least).select(*(F.col(k).alias(f"heavy_{i}") for i, k in enumerate(keys)), F.col(value).alias("heavy_value"), F.lit(True).alias("is_heavy"))
    light = right.where(F.col(times) <= least).select(*(F.col(k).alias(f"light_{i}") for i, k in enumerate(keys)), F.col(value).alias("light_value"))
    same = lambda side, of: [F.col(f"{side}_{i}") == of(k, i) for i, k in enumerate(keys)]
    rows = left.join(F.broadcast(heavy), same("heavy", lambda k, i: F.col(k)), "left")
    rows = rows.withColumns({f"dealt_{i}": F.when(F.col("is_heavy"), F.xxhash64(F.lit(i), *spread)).otherwise(F.col(k)) for i, k in enumerate(keys)})
    rows = rows.join(light, same("light", lambda k, i: F.col(f"dealt_{i}")), "left")
    found = F.when(F.col("is_heavy"), F.col("heavy_value")).otherwise(F.col("light_value"))
    return rows.select(*(F.col(c) for c in left.columns), found.alias(value))
