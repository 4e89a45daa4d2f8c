"""Operators over half-open intervals (chrom, st, en)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Positions of a chrom that one task may be dealt.
BIN = 1 << 20


def overlap_join(a: DataFrame, b: DataFrame, width: int, chrom: str = "chrom") -> DataFrame:
    """Pairs of intervals of one chrom that share a position; columns of b get the suffix ``_b``.

    Intervals are dealt into bins of ``width``; a pair is kept only in the bin where the later of the two starts, so no
    pair has to be removed again. Empty intervals meet nothing.
    """
    bins = lambda st, en: F.explode(F.sequence(F.floor(F.col(st) / width), F.floor((F.col(en) - 1) / width)))
    a = a.where("st < en").withColumn("_bin", bins("st", "en"))
    b = b.where("st < en").select(*(F.col(c).alias(f"{c}_b") for c in b.columns)).withColumn("_bin_b", bins("st_b", "en_b"))
    on = (F.col(chrom) == F.col(f"{chrom}_b")) & (F.col("_bin") == F.col("_bin_b")) & (F.col("st") < F.col("en_b")) & (F.col("st_b") < F.col("en"))
    on = on & (F.col("_bin") == F.floor(F.greatest("st", "st_b") / width))
    return a.join(b, on).drop("_bin", "_bin_b")


def merge(df: DataFrame, chrom: str = "chrom", bin_size: int = BIN) -> DataFrame:
    """The union of each chrom's intervals; touching ones become one.

    Intervals are dealt by chrom and bin of their start, so that a chrom spans many tasks. A bin learns from the bins
    before how far their intervals reach, and which of them began the island that goes on into it; only one row a bin is
    ordered by chrom for that.
    """
    rows = df.select(chrom, "st", "en", F.floor(F.col("st") / bin_size).alias("_bin"))
    order = Window.partitionBy(chrom, "_bin").orderBy("st", "en")
    bins = Window.partitionBy(F.col("_c")).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    def with_bins(left: DataFrame, summary: DataFrame, *carried: str) -> DataFrame:
        return left.join(summary.select("_c", "_b", *carried), F.col(chrom).eqNullSafe(F.col("_c")) & F.col("_bin").eqNullSafe(F.col("_b"))).drop("_c", "_b")

    tops = rows.groupBy(F.col(chrom).alias("_c"), F.col("_bin").alias("_b")).agg(F.max("en").alias("_top")).withColumn("_carried", F.max("_top").over(bins))
    reach = F.greatest(F.max("en").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    marked = with_bins(rows, tops, "_carried").withColumn("_new", F.when(reach.isNull() | (F.col("st") > reach), 1).otherwise(0))
    marked = marked.withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = marked.groupBy(chrom, "_bin", "_no").agg(F.min("st").alias("st"), F.max("en").alias("en"))
    counts = pieces.groupBy(F.col(chrom).alias("_c"), F.col("_bin").alias("_b")).agg(F.max("_no").alias("_islands"))
    owner = F.last(F.when(F.col("_islands") > 0, F.struct("_b", F.col("_islands").alias("_no"))), ignorenulls=True).over(bins)
    owned = with_bins(pieces, counts.withColumn("_owner", owner), "_owner")
    island = F.when(F.col("_no") > 0, F.struct(F.col("_bin").alias("_b"), "_no")).otherwise(F.col("_owner"))
    return owned.groupBy(chrom, island.alias("_island")).agg(F.min("st").alias("st"), F.max("en").alias("en")).drop("_island")


def depth(df: DataFrame, chrom: str = "chrom", bin_size: int = BIN) -> DataFrame:
    """(chrom, st, en, depth): stretches between interval ends and how many intervals cover each.

    Ends are dealt by chrom and bin; a bin's depth at its start is the sum of the bins before, and its last stretch ends
    where the next bin's first one starts.
    """
    ends = df.where("st < en").select(chrom, F.explode(F.array(F.struct(F.col("st").alias("at"), F.lit(1).alias("d")), F.struct(F.col("en").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(chrom, "e.at").agg(F.sum("e.d").alias("d")).withColumn("_bin", F.floor(F.col("at") / bin_size))
    bins = Window.partitionBy("_c").orderBy("_b")
    summary = steps.groupBy(F.col(chrom).alias("_c"), F.col("_bin").alias("_b")).agg(F.sum("d").alias("_d"), F.min("at").alias("_first"))
    summary = summary.select("_c", "_b", F.coalesce(F.sum("_d").over(bins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(bins).alias("_next"))
    order = Window.partitionBy(chrom, "_bin").orderBy("at")
    rows = steps.join(summary, F.col(chrom).eqNullSafe(F.col("_c")) & (F.col("_bin") == F.col("_b")))
    out = rows.select(chrom, F.col("at").alias("st"), F.coalesce(F.lead("at").over(order), F.col("_next")).alias("en"), (F.col("_before") + F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("depth"))
    return out.where("en is not null and depth > 0")


def covered_once(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    return depth(df, chrom).groupBy(chrom).agg(F.sum(F.when(F.col("depth") == 1, F.col("en") - F.col("st")).otherwise(0)).alias("once"), F.sum(F.col("en") - F.col("st")).alias("covered"))


def length_quantiles(df: DataFrame, group: str, length: str, share: float = 0.5) -> DataFrame:
    """(group, n50, total): the length at which the longest rows hold ``share`` of all."""
    order = Window.partitionBy(group).orderBy(F.col(length).desc())
    by_length = df.groupBy(group, length).agg((F.count("*") * F.col(length)).alias("_sum"))
    total = by_length.groupBy(group).agg(F.sum("_sum").alias("total"))
    running = by_length.withColumn("_run", F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(total, group)
    return running.where(F.col("_run") >= share * F.col("total")).groupBy(group, "total").agg(F.max(length).alias("n50"))


def sensitivity(found: DataFrame, wanted: DataFrame, width: int, chrom: str = "chrom") -> DataFrame:
    """(shared, found, wanted, sn, sp) in positions, both sides merged first."""
    a, b = merge(found, chrom), merge(wanted, chrom)
    both = overlap_join(a, b, width, chrom).agg(F.coalesce(F.sum(F.least("en", "en_b") - F.greatest("st", "st_b")), F.lit(0)).alias("shared"))
    size = lambda d, n: d.agg(F.coalesce(F.sum(F.col("en") - F.col("st")), F.lit(0)).alias(n))
    rows = both.select("shared", F.lit(0).alias("found"), F.lit(0).alias("wanted")).union(size(a, "found").select(F.lit(0), "found", F.lit(0))).union(size(b, "wanted").select(F.lit(0), F.lit(0), "wanted"))
    out = rows.agg(*(F.sum(c).alias(c) for c in ("shared", "found", "wanted")))
    return out.withColumns({"sn": F.round(F.try_divide("shared", "wanted"), 6), "sp": F.round(F.try_divide("shared", "found"), 6)})


def gaps(df: DataFrame, group: str) -> DataFrame:
    """The spaces between neighbouring intervals of a group, as introns lie between exons."""
    order = Window.partitionBy(group).orderBy("st", "en")
    return df.select(group, F.lag("en").over(order).alias("st"), F.col("st").alias("en")).where("st < en")


def quality_curve(df: DataFrame, quality: str = "mapq", wrong: str = "wrong") -> DataFrame:
    """(mapq, n, n_err, rate, total): errors by quality, accumulated from the highest down.

    A row starts at the first quality and at each with errors; qualities without errors join the row before.
    """
    per = df.groupBy(quality).agg(F.count("*").alias("n"), F.sum(F.col(wrong).cast("int")).alias("e"))
    down = Window.orderBy(F.col(quality).desc())
    per = per.withColumn("_first", (F.row_number().over(down) == 1) | (F.col("e") > 0))
    per = per.withColumn("_row", F.sum(F.col("_first").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    rows = per.groupBy("_row").agg(F.min(quality).alias(quality), F.sum("n").alias("n"), F.sum("e").alias("n_err"))
    up_to = Window.orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"total": F.sum("n").over(up_to), "_err": F.sum("n_err").over(up_to)})
    return out.select(quality, "n", "n_err", F.round(F.col("_err") / F.col("total"), 9).alias("rate"), "total")
