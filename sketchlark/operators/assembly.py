"""Summaries of alignments and assemblies: counts, gaps, joins in the wrong place, coverage and length quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchlark.operators.evaluation import cigar_steps
from sketchlark.operators.formats import cigar_ops
from sketchlark.operators.intervals import covered_once, merge, overlap_join

#: Lower ends of the classes of gap lengths.
GAPS = [0, 50, 100, 300, 400, 1000]


def _total(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def alignment_stats(alignments: DataFrame) -> DataFrame:
    """One row of counts over (query_id, P_sz, P_start, P_end, cigar, nm, nn, is_primary).

    Sequences and their bases count once however many alignments they have; ``covered`` is the union of a query's primary
    intervals. Substitutions are nm without gaps and ambiguous letters, never below 0. Alignments without a CIGAR are left out.
    """
    second = alignments.where(~F.col("is_primary")).agg(F.count("*").alias("secondary"))
    rows = alignments.where(F.col("is_primary") & F.col("cigar").isNotNull()).withColumn("_ops", cigar_ops("cigar"))
    letters = lambda kinds: F.aggregate(F.filter("_ops", lambda x: x.op.isin(*kinds)), F.lit(0), lambda a, x: a + x.n)

    def gaps(kind: str, low: int, high: int | None) -> Column:
        return F.size(F.filter("_ops", lambda x: (x.op == kind) & (x.n >= low) & (x.n < high if high else F.lit(True))))

    subs = F.greatest(F.col("nm") - letters("ID") - F.coalesce("nn", F.lit(0)), F.lit(0))
    counts = {f"{name}_{low}": gaps(kind, low, high) for name, kind in (("ins", "I"), ("del", "D")) for low, high in zip(GAPS, [*GAPS[1:], None])}
    sums = rows.agg(F.count("*").alias("primary"), F.count(F.when(F.size("_ops") > 65535, 1)).alias("long_cigars"), _total(subs).alias("substitutions"), *(_total(c).alias(n) for n, c in counts.items()))
    lengths = rows.groupBy("query_id").agg(F.max("P_sz").alias("n")).agg(F.count("*").alias("sequences"), _total("n").alias("bases"))
    spans = merge(rows.select("query_id", F.col("P_start").alias("st"), F.col("P_end").alias("en")), "query_id")
    covered = spans.agg(_total(F.col("en") - F.col("st")).alias("covered"))
    return sums.crossJoin(second).crossJoin(lengths).crossJoin(covered)  # one row each


def read_errors(alignments: DataFrame) -> DataFrame:
    """(query_id, aligned, substitutions, inserted, deleted, error) over a query's primary alignments (query_id, cigar, nm, nn).

    aligned are letters against letters; error is all differences over these and the gaps.
    """
    rows = alignments.withColumn("_ops", cigar_ops("cigar"))
    letters = lambda kinds: F.aggregate(F.filter("_ops", lambda x: x.op.isin(*kinds)), F.lit(0), lambda a, x: a + x.n)
    subs = F.greatest(F.col("nm") - letters("ID") - F.coalesce("nn", F.lit(0)), F.lit(0))
    sums = rows.groupBy("query_id").agg(_total(letters("M=X")).alias("aligned"), _total(subs).alias("substitutions"), _total(letters("I")).alias("inserted"), _total(letters("D")).alias("deleted"))
    gaps = F.col("inserted") + F.col("deleted")
    return sums.withColumn("error", F.try_divide((F.col("substitutions") + gaps).cast("double"), F.col("aligned") + gaps))


def long_gaps(alignments: DataFrame, least: int, key: str = "aln_id") -> DataFrame:
    """(key, op, n, q_at, t_at): insertions and deletions of ``least`` letters or more, with the place where they begin."""
    steps = cigar_steps(alignments, key, F.col("P_start"), F.col("T_l"))
    return steps.where(F.col("op").isin("I", "D") & (F.col("n") >= least)).select(key, "op", "n", "q_at", "t_at")


def _in_regions(blocks: DataFrame, regions: DataFrame, width: int, ratio: float) -> DataFrame:
    """Segment intervals (segm_name, st, en) that share ``ratio`` of their length or more with the regions (chrom, st, en)."""
    named = regions.select(F.col("chrom").alias("segm_name"), "st", "en")
    own = blocks.select("segm_name", F.col("T_l").alias("st"), F.col("T_r").alias("en")).distinct()
    shared = overlap_join(own, named, width, "segm_name").groupBy("segm_name", "st", "en").agg(F.sum(F.least("en", "en_b") - F.greatest("st", "st_b")).alias("_shared"))
    return shared.where(F.col("_shared") >= ratio * (F.col("en") - F.col("st"))).select(F.col("segm_name").alias("_s"), F.col("st").alias("_l"), F.col("en").alias("_r"))


def misjoins(alignments: DataFrame, min_len: int = 1_000_000, max_gap: int = 1_000_000, regions: DataFrame | None = None, width: int = 1_000_000, ratio: float = 0.5) -> DataFrame:
    """(query_id, P_start, kind, in_region): where a query's neighbouring long alignments don't continue each other.

    Neighbours are by P_start. ``segment``: on different segments; ``gap``: on one strand, with distances on query and
    target that differ by more than max_gap; ``inversion``: on the other strand, and the next is back on the first, which
    then isn't looked at itself; ``end``: on the other strand without that. in_region: one of the two lies in ``regions``.
    Of a run of possible inversions every other one counts. Queries with one long alignment have no row.
    """
    a = alignments.where(F.col("blk_len") >= min_len).select("query_id", "P_start", "P_end", "strand", "segm_name", "T_l", "T_r")
    if regions is None:
        a = a.withColumn("_in", F.lit(False))
    else:
        found = _in_regions(a, regions, width, ratio)
        a = a.join(found, (F.col("segm_name") == F.col("_s")) & (F.col("T_l") == F.col("_l")) & (F.col("T_r") == F.col("_r")), "left").withColumn("_in", F.col("_s").isNotNull()).drop("_s", "_l", "_r")
    order = Window.partitionBy("query_id").orderBy("P_start", "P_end", "segm_name", "T_l", "T_r", "strand")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    last = {c: F.lag(c).over(order) for c in ("P_end", "strand", "segm_name", "T_l", "T_r", "_in")}
    a = a.withColumns({f"_{c}": v for c, v in last.items()} | {"_next": F.lead("strand").over(order), "_i": F.row_number().over(order)})
    turned = (F.col("segm_name") == F.col("_segm_name")) & (F.col("strand") != F.col("_strand"))
    a = a.withColumn("_turn", F.coalesce(turned & (F.col("_next") == F.col("_strand")), F.lit(False)))
    a = a.withColumn("_run", F.col("_i") - F.max(F.when(~F.col("_turn"), F.col("_i"))).over(up_to))
    a = a.withColumn("_taken", F.coalesce(F.lag("_turn").over(order) & (F.pmod(F.lag("_run").over(order), F.lit(2)) == 1), F.lit(False)))
    on_target = F.when(F.col("strand") == "+", F.col("T_l") - F.col("_T_r")).otherwise(F.col("_T_l") - F.col("T_r"))
    far = F.abs(on_target - (F.col("P_start") - F.col("_P_end"))) > max_gap
    kind = F.when(F.col("segm_name") != F.col("_segm_name"), "segment").when(F.col("strand") == F.col("_strand"), F.when(far, "gap")).when(F.col("_turn"), "inversion").otherwise("end")
    out = a.where((F.col("_i") > 1) & ~F.col("_taken")).select("query_id", "P_start", kind.alias("kind"), (F.col("_in") | F.col("__in")).alias("in_region"))
    return out.where("kind is not null")


def _quantiles(lengths: DataFrame, total: int, shares: dict[str, float], area: str | None = None) -> DataFrame:
    """One row: per name the length at which the longest rows pass a share of ``total``; ``area``: mean length at a position of it.

    Rows are counted per length first; one task orders distinct lengths only.
    """
    per = lengths.groupBy("n").agg((F.count("*") * F.col("n")).alias("_sum"))
    up_to = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = per.withColumn("_run", F.sum("_sum").over(up_to))
    cols = [F.max(F.when(F.col("_run") > share * total, F.col("n"))).alias(name) for name, share in shares.items()]
    if area:
        used = F.greatest(F.least(F.col("_run"), F.lit(total)) - (F.col("_run") - F.col("_sum")), F.lit(0))
        cols.append(F.round(F.coalesce(F.sum(used * F.col("n")), F.lit(0)) / total, 3).alias(area))
    return run.agg(*cols)


def assembly_stats(contigs: DataFrame, alignments: DataFrame, target_len: int, min_len: int = 10_000, max_diff: float = 0.01) -> DataFrame:
    """One row of measures of an assembly (query_id, P_sz) by its primary alignments to a target of target_len letters.

    Alignments are (query_id, P_start, P_end, strand, segm_name, T_l, T_r, diff); those shorter than min_len on the query or
    with a larger diff are left out (a null diff isn't). A block that overlaps the one before counts from its end, and not
    at all if it ends sooner. ``breaks`` are blocks after a query's first; ``breaks_500`` those of 500 letters or more, and
    ``breaks_10k`` those of them whose distances to the block before differ by 10,000 or more between query and target, or
    that lie on another segment or strand. ``aunga`` is the mean block length over target positions.
    """
    kept = alignments.where((F.col("P_end") - F.col("P_start") >= min_len) & (F.coalesce("diff", F.lit(0.0)) <= max_diff))
    order = Window.partitionBy("query_id").orderBy("P_start", "P_end", "segm_name", "T_l", "T_r", "strand")
    before = F.lag("P_end").over(order)
    blocks = kept.withColumn("_before", before)
    overlaps = F.coalesce(F.col("P_start") < F.col("_before"), F.lit(False))
    blocks = blocks.withColumn("n", F.when(~overlaps, F.col("P_end") - F.col("P_start")).when(F.col("P_end") >= F.col("_before"), F.col("P_end") - F.col("_before"))).where("n is not null")
    last = {c: F.lag(c).over(order) for c in ("P_end", "strand", "segm_name", "T_l", "T_r")}
    blocks = blocks.withColumns({f"_{c}": v for c, v in last.items()})
    on_target = F.when(F.col("strand") == "+", F.col("T_l") - F.col("_T_r")).otherwise(F.col("_T_l") - F.col("T_r"))
    same = (F.col("strand") == F.col("_strand")) & (F.col("segm_name") == F.col("_segm_name"))
    gap = F.when(same, F.abs(F.col("P_start") - F.col("_P_end") - on_target)).otherwise(1_000_000_000)
    inner = F.col("_P_end").isNotNull()
    breaks = blocks.agg(F.count(F.when(inner, 1)).alias("breaks"), F.count(F.when(inner & (F.col("n") >= 500), 1)).alias("breaks_500"), F.count(F.when(inner & (F.col("n") >= 500) & (gap >= 10_000), 1)).alias("breaks_10k"))
    size = contigs.agg(_total("P_sz").alias("length"))
    on_query = merge(kept.select("query_id", F.col("P_start").alias("st"), F.col("P_end").alias("en")), "query_id").agg(_total(F.col("en") - F.col("st")).alias("_q"))
    target = covered_once(kept.select("segm_name", F.col("T_l").alias("st"), F.col("T_r").alias("en")), "segm_name").agg(_total("once").alias("_once"), _total("covered").alias("covered"))
    ng = _quantiles(contigs.select(F.col("P_sz").alias("n")), target_len, {"ng75": 0.75, "ng50": 0.5})
    nga = _quantiles(blocks.select("n"), target_len, {"nga50": 0.5}, "aunga")
    out = size.crossJoin(target).crossJoin(on_query).crossJoin(ng).crossJoin(nga).crossJoin(breaks)  # one row each
    percent = lambda a, b: F.round(100 * F.try_divide(a, b), 2)
    out = out.withColumns({"r_cov": percent(F.col("covered"), F.lit(target_len)), "r_dup": percent(F.col("covered") - F.col("_once"), F.col("covered")), "q_cov": percent(F.col("_q"), F.col("length"))})
    return out.drop("_once", "_q")
