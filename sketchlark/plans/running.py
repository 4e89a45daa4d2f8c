"""Global running sums without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchlark.plans.scratch import settle


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], group: list[str] = (), late: dict[str, Column] | None = None) -> DataFrame:
    """Add, for each ``name: column`` of ``sums``, the sum of ``column`` over all rows before this one.

    Rows are ordered by ``order`` within the columns ``group`` (all rows form one group if it is empty); of rows equal in
    all of these any may come first, and they are told apart by where they stand, so that they needn't share a range.
    They are dealt into ranges of (group, order) and written once, so that ranges keep their rows; columns ``late`` are
    computed then, so that finding the ranges doesn't cost them. Totals per range and group are summed up first; they
    are as few as the ranges plus the groups. Each range then adds its own running sum to the total before it. A hot
    group spans as many ranges as its size asks for. Null sums count as 0. Other columns pass through, whatever their
    names; a column named like a sum is replaced.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = [f"o{i}" for i in range(len(order) + 1)]
    made = df.withColumns(late or {})
    at = {c: f"c{i}" for i, c in enumerate(made.columns)}
    # Ranges are dealt before the late columns exist; these get their places after the ones that do.
    rows = df.select("*", *(c.alias(o) for c, o in zip(order, ordered)), F.monotonically_increasing_id().alias(ordered[-1]))
    rows = rows.repartitionByRange(n, *group, *ordered).withColumns(late or {}).withColumn("part", F.spark_partition_id())
    rows = settle(rows.select(*(F.col(f"`{c}`").alias(at[c]) for c in made.columns), *ordered, "part"), "ranges")
    keys, names = [at[g] for g in group], list(sums)
    value = {x: F.coalesce(F.col(at[c]), F.lit(0)) for x, c in sums.items()}
    totals = rows.groupBy("part", *keys).agg(*(F.sum(value[x]).alias(f"t{i}") for i, x in enumerate(names)))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("part").alias("p"), *(F.col(k).alias(f"g{i}") for i, k in enumerate(keys)), *(F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"b{i}") for i in range(len(names))))
    within = Window.partitionBy("part", *keys).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"w{i}": F.coalesce(F.sum(value[x]).over(within), F.lit(0)) for i, x in enumerate(names)})
    on = F.col("p") == F.col("part")
    for i, k in enumerate(keys):
        on = on & F.col(f"g{i}").eqNullSafe(F.col(k))
    rows = rows.join(totals, on)
    return rows.select(*(F.col(c).alias(name) for name, c in at.items() if name not in sums), *((F.col(f"b{i}") + F.col(f"w{i}")).alias(x) for i, x in enumerate(names)))
