"""Mapping of reads onto segments: seeds, buckets, windows, best and runner-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchlark.functions.sequences import mapq, overlap_ratio, seed_bound, sigmas, unsigned
from sketchlark.params import Metric, Params


def hit_counts(ref: DataFrame, max_matches: int | None = None) -> DataFrame:
    """(h, n): hits of each reference k-mer, without those of more than ``max_matches`` hits."""
    out = ref.groupBy("h").agg(F.count("*").alias("n"))
    return out if max_matches is None else out.where(F.col("n") <= max_matches)


def index_stats(ref: DataFrame, max_matches: int | None = None) -> DataFrame:
    n = ref.groupBy("h").agg(F.count("*").alias("n"))
    gone = F.lit(False) if max_matches is None else F.col("n") > max_matches
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.count("*").alias("kmers"), F.max("n").alias("most_hits"), count(F.col("n") == 1).alias("single"), count(gone).alias("blacklisted_kmers"), F.coalesce(F.sum(F.when(gone, F.col("n")).otherwise(0)), F.lit(0)).alias("blacklisted_hits"))


def seeds(reads: DataFrame, counts: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, h, strand, occs, pmatches, hits, m): the distinct k-mers of each read, m being all its sampled k-mers.

    strand is that of the leftmost occurrence; pmatches are the positions, rightmost first; hits is 0 if the reference
    has none. Only counts of k-mers that reads hold reach the join.
    """
    own = reads.groupBy(key, "h").agg(F.min_by("strand", "r").alias("strand"), F.count("*").cast("int").alias("occs"), F.sort_array(F.collect_list("r"), asc=False).alias("pmatches"))
    own = own.withColumn("m", F.sum("occs").over(Window.partitionBy(key)).cast("int"))
    return own.join(counts, "h", "left").withColumn("hits", F.coalesce("n", F.lit(0))).drop("n")


def seeded(reads: DataFrame, ref: DataFrame, params: Params, key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(ordered seeds, the reference's k-mers that may be used): see ``seed_order``; frequent k-mers count as missing."""
    counts = hit_counts(ref, params.max_matches)
    usable = ref if params.max_matches is None else ref.join(counts.select("h"), "h", "left_semi")
    return seed_order(seeds(reads, counts, key), params, key), usable


def seed_order(found: DataFrame, params: Params, key: str = "query_id") -> DataFrame:
    """Seeds with their rank by rarity, the occurrences before them, and whether they are within the budget.

    A bucket with containment of theta2 or more shares a k-mer with the seeds within the budget.
    """
    order = Window.partitionBy(key).orderBy("hits", unsigned("h"))
    before = F.coalesce(F.sum("occs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.floor((F.lit(1.0) - F.lit(params.theta2)) * F.col("m")).cast("int") + 1
    return found.withColumns({"rank": F.row_number().over(order), "before": before, "budget": budget}).withColumn("used", F.col("before") < F.col("budget"))


def bucketed(hits: DataFrame) -> DataFrame:
    """Each hit in the one or two buckets [b m, (b + 2) m) that hold its tpos."""
    b = F.floor(F.col("tpos") / F.col("m")).cast("int")
    return hits.withColumn("b", F.explode(F.when(b > 0, F.array(b - 1, b)).otherwise(F.array(b))))


def bucket_matches(ordered: DataFrame, ref: DataFrame, params: Params, key: str = "query_id", segment: str = "segm_id") -> DataFrame:
    """(key, segment, b, m, matches, codirection, r_min, r_max, sh) of the candidate buckets with sh >= theta2.

    Seeds within the budget name the candidates; all seeds' hits in those are then counted, capped by the read's own
    occurrences of each k-mer.
    """
    slim = ordered.where("hits > 0").select(key, "h", F.col("strand").alias("q_strand"), "occs", "m", "used")
    hits = bucketed(slim.join(ref, "h"))
    group = [key, segment, "b"]
    codir = F.when(F.col("q_strand") == F.col("strand"), 1).otherwise(-1)
    per_seed = hits.groupBy(*group, "h", "m", "occs").agg(F.count("*").alias("c"), F.sum(codir).alias("codirection"), F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.max("used").alias("used"))
    out = per_seed.groupBy(*group, "m").agg(F.sum(F.least("c", "occs")).alias("matches"), F.sum("codirection").alias("codirection"), F.min("r_min").alias("r_min"), F.max("r_max").alias("r_max"), F.max("used").alias("candidate"))
    out = out.where("candidate").drop("candidate").withColumn("sh", seed_bound(F.col("m"), F.col("m"), F.col("matches")))
    return out.where(F.col("sh") >= params.theta2)


def window_sweep(x: np.ndarray, h: np.ndarray, occs: np.ndarray, codir: np.ndarray, begin: int, end: int, m: int, use_jaccard: bool) -> tuple[int, int, int, float]:
    """(l, shared, strand sum, score) of the first best window [l, min(l + m, end)) over the hits of a bucket, sorted by x.

    A hit counts for the windows that hold it but not its occs-th earlier hit of the same k-mer.
    """
    n = end - begin
    order = np.lexsort((x, h))
    xs, hs, os = x[order], h[order], occs[order]
    at = np.arange(len(xs)) - os
    same = (at >= 0) & (hs[np.maximum(at, 0)] == hs)
    prev = np.where(same, xs[np.maximum(at, 0)], -1)
    change = np.zeros(n + 1, np.int64)
    low = np.maximum(np.maximum(prev + 1, xs - m + 1), begin)
    live = low <= xs
    np.add.at(change, low[live] - begin, 1)
    np.add.at(change, xs[live] + 1 - begin, -1)
    shared = np.cumsum(change)[:n]
    change[:] = 0
    np.add.at(change, np.maximum(x - m + 1, begin) - begin, codir)
    np.add.at(change, x + 1 - begin, -codir)
    strands = np.cumsum(change)[:n]
    size = np.minimum(np.arange(begin, end) + m, end) - np.arange(begin, end)
    score = shared / (m + size - shared) if use_jaccard else shared / m
    i = int(np.argmax(score))
    return begin + i, int(shared[i]), int(strands[i]), float(score[i])


def lcs_score(seq: list[list[int]]) -> int:
    """The longer of the longest strictly increasing runs (not necessarily adjacent) of the joined lists, read either way."""
    import bisect

    def increasing(values):
        tails: list[int] = []
        for v in values:
            i = bisect.bisect_left(tails, v)
            tails[i : i + 1] = [v]
        return len(tails)

    flat = [v for part in seq for v in part]
    return max(increasing(flat), increasing(flat[::-1])) if flat else 0


def _per_bucket(batch: pa.RecordBatch, at: dict[str, int], theta2: float) -> Iterator[tuple]:
    """(row, m, b, matches, sh, its hits' fields) of the buckets that hold a hit of a used seed and reach theta2."""
    lists = batch.column(at["hits"])
    value = lists.flatten()
    names = [f.name for f in value.type]
    field = {n: (value.field(i) if n == "pmatches" else value.field(i).to_numpy(zero_copy_only=False)) for i, n in enumerate(names)}
    size = lists.value_lengths().to_numpy()
    end = np.cumsum(size)
    bucket = np.repeat(np.arange(len(size)), size)
    # Hits of a k-mer count up to the read's own number of it.
    order = np.lexsort((field["h"], bucket))
    h, of = field["h"][order], bucket[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, np.int64)
    capped = np.minimum(np.diff(np.append(first, len(h))), field["occs"][order][first])
    matches = np.bincount(of[first], weights=capped, minlength=len(size)).astype(np.int64)
    used = np.bincount(bucket, weights=field["used"], minlength=len(size)) > 0
    ms, bs = batch.column(at["m"]).to_numpy(), batch.column(at["b"]).to_numpy()
    sh = 1.0 - (ms - matches) / ms
    for i in np.flatnonzero(used & (sh >= theta2)):
        part = slice(end[i] - size[i], end[i])
        yield int(i), int(ms[i]), int(bs[i]), int(matches[i]), float(sh[i]), {n: v[part] for n, v in field.items()}


def scored_buckets(ordered: DataFrame, ref: DataFrame, params: Params, key: str = "query_id", segment: str = "segm_id") -> DataFrame:
    """(key, segment, b, m, matches, codirection, r_min, r_max, sh, l, shared, strands, score, T_l, T_r, s) of the candidate
    buckets of ``bucket_matches``, with their best window by the metric.

    A bucket holds at most 2 m sketch positions, so its collected hits are bounded by the read. Reads meet the reference
    once: hits are dealt by bucket, counted, bounded and swept in one pass. Only a window's ends are looked up after.
    """
    group, windows = [key, segment, "b"], params.metric in (Metric.CONTAINMENT, Metric.JACCARD)
    lcs = params.metric is Metric.BUCKET_LCS
    slim = ordered.where("hits > 0").select(key, "h", F.col("strand").alias("q_strand"), "occs", "m", "used", *(["pmatches"] if lcs else []))
    codir = F.when(F.col("q_strand") == F.col("strand"), 1).otherwise(-1).alias("codir")
    hit = F.struct("tpos", "r", "h", "occs", codir, "used", *(["pmatches"] if lcs else []))
    rows = bucketed(slim.join(ref, "h")).groupBy(*group).agg(F.first("m").alias("m"), F.sort_array(F.collect_list(hit)).alias("hits"))
    sizes = ref.groupBy(segment).agg((F.max("tpos") + 1).alias("t_size"))
    use_jaccard = params.metric is Metric.JACCARD
    # Without the segment's size a window may reach beyond its end, which only Jaccard's own size of it would notice.
    rows = rows.join(sizes, segment) if use_jaccard else rows.withColumn("t_size", F.lit((1 << 31) - 1))
    plain = [*group, "m", "t_size"]
    rows, theta2 = rows.select(*plain, "hits"), params.theta2
    made = {"matches": "long", "codirection": "long", "r_min": "int", "r_max": "int", "sh": "double", "l": "int", "shared": "long", "strands": "long", "score": "double"}
    at = {c: i for i, c in enumerate(rows.columns)}

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, found = [], []
            sizes = batch.column(at["t_size"]).to_numpy()
            for i, m, b, matches, sh, f in _per_bucket(batch, at, theta2):
                own = (matches, int(f["codir"].sum()), int(f["r"].min()), int(f["r"].max()), sh)
                if windows:
                    best = window_sweep(f["tpos"], f["h"], f["occs"], f["codir"], b * m, min(int(sizes[i]), (b + 2) * m), m, use_jaccard)
                else:
                    best = (None, own[0], own[1], lcs_score(f["pmatches"].to_pylist()) / m if lcs else sh)
                take.append(i)
                found.append((*own, *best))
            cols = list(zip(*found)) or [()] * len(made)
            kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(take, pa.int64())) for c in batch.columns[: len(group) + 1]), *(pa.array(c, kinds[k]) for c, k in zip(cols, made.values()))], [*group, "m", *made])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(sweep, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*group, "m")), *(f"{c} {k}" for c, k in made.items())]))
    if not windows:
        return out.withColumns({"T_l": F.col("r_min"), "T_r": F.col("r_max"), "s": F.col("r_max") - F.col("r_min")})
    last = F.least(F.col("l") + F.col("m"), "t_size", (F.col("b") + 2) * F.col("m")) - 1
    ends = out.join(sizes, segment).withColumn("tpos", F.explode(F.array("l", last))).drop("t_size")
    rest = [c for c in out.columns if c not in group]
    placed = ends.join(ref.select(segment, "tpos", "r"), [segment, "tpos"]).groupBy(*group).agg(*(F.first(c).alias(c) for c in rest), F.min("r").alias("T_l"), F.max("r").alias("T_r"))
    return placed.withColumn("s", F.col("T_r") - F.col("T_l") + 1)


def map_seeds(ordered: DataFrame, usable: DataFrame, params: Params, key: str = "query_id", segment: str = "segm_id") -> DataFrame:
    """``map_reads`` from the results of ``seeded``, with ``final_buckets``: the read's buckets that score above theta."""
    return best_and_second(scored_buckets(ordered, usable, params, key, segment), params, key, segment)


def best_and_second(scored: DataFrame, params: Params, key: str = "query_id", segment: str = "segm_id") -> DataFrame:
    """The best of each read's scored buckets, with the runner-up, qualities and ``final_buckets``."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), segment, "b")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fine = (F.col("score") > params.theta) & (F.col("sh") >= params.theta)
    mine = [c for c in scored.columns if c != key]
    rows = scored.withColumn("_best", F.first(F.when(fine, F.struct(*mine)), ignorenulls=True).over(whole)).where("_best is not null")
    apart = overlap_ratio(F.col(segment), F.col("T_l"), F.col("T_r"), F.col(f"_best.{segment}"), F.col("_best.T_l"), F.col("_best.T_r")) < params.max_overlap
    other = (F.col("score") > F.col("_best.score") * (1 - params.min_diff)) & apart & F.lit(params.max_overlap > 0)
    rank = F.struct((-F.col("score")).alias("a"), F.col(segment).alias("g"), F.col("b").alias("b"))
    second = F.min(F.when(other, F.struct(rank.alias("rank"), F.col("shared").alias("shared"), F.col("score").alias("score"))))
    rows = rows.groupBy(key).agg(F.first("_best").alias("_best"), second.alias("_second"), F.sum(F.when(F.col("score") > params.theta, 1).otherwise(0)).alias("final_buckets"))
    out = rows.select(key, "_best.*", F.col("_second.rank.g").alias(f"{segment}2"), F.col("_second.rank.b").alias("b2"), F.col("_second.shared").alias("shared2"), F.col("_second.score").alias("score2"), "final_buckets")
    quality = mapq(F.col("score"), F.col("score2"), F.col("strands"), F.col("shared"), params.theta2, params.min_diff)
    lost = F.when(F.col("shared2").isNull(), -1).otherwise(F.col("shared2"))
    return out.withColumns({"strand": F.when(F.col("strands") > 0, "+").otherwise("-"), "mapq": quality, "shared_diff": F.col("shared") - lost, "sigma_diff": F.when(F.col("shared2").isNull(), -1.0).otherwise(sigmas(F.col("shared"), F.col("shared2")))})


def map_reads(reads: DataFrame, ref: DataFrame, params: Params, key: str = "query_id", segment: str = "segm_id") -> DataFrame:
    """One row per mapped read: the best bucket, the runner-up's b2, segment2, shared2, score2, and mapq.

    The best has the highest score above theta and sh >= theta; ties go to the lower segment, then bucket. The runner-up
    has the highest score above best * (1 - min_diff) whose interval overlaps the best's by less than max_overlap. ``ref``
    should be a written index (see ``write_index``): its hashes, its hits and the windows' ends are read from it.
    """
    return map_seeds(*seeded(reads, ref, params, key), params, key, segment)


def read_counters(ordered: DataFrame, usable: DataFrame, key: str = "query_id", segment: str = "segm_id") -> DataFrame:
    """One row per read with k-mers: kmers, kmers_unique, kmers_notmatched, seeds (its budget), possible_matches (hits of all
    its k-mers), seed_matches and max_seed_matches (hits of those within the budget), seeded_buckets (buckets with such a
    hit). Counts are the read's own, not running totals.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    used = F.when(F.col("used"), F.col("hits")).otherwise(0)
    out = ordered.groupBy(key).agg(F.first("m").cast("long").alias("kmers"), F.count("*").alias("kmers_unique"), total(F.when(F.col("hits") == 0, F.col("occs")).otherwise(0)).alias("kmers_notmatched"), F.first("budget").cast("long").alias("seeds"), total("hits").alias("possible_matches"), total(used).alias("seed_matches"), F.max(used).cast("long").alias("max_seed_matches"))
    hits = bucketed(ordered.where("used and hits > 0").select(key, "h", "m").join(usable.select("h", segment, "tpos"), "h"))
    touched = hits.select(key, segment, "b").distinct().groupBy(key).agg(F.count("*").alias("seeded_buckets"))
    return out.join(touched, key, "left").withColumn("seeded_buckets", F.coalesce("seeded_buckets", F.lit(0)))


def with_unmapped(reads: DataFrame, mapped: DataFrame, key: str = "query_id") -> DataFrame:
    """A row for each read: its mapping, or nulls."""
    return reads.select(key).distinct().join(mapped, key, "left")


def unmapped(reads: DataFrame, mapped: DataFrame, key: str = "query_id") -> DataFrame:
    return reads.join(mapped.select(key), key, "left_anti")


def run_stats(reads: DataFrame, mapped: DataFrame, counters: DataFrame, key: str = "query_id", length: str = "P_sz") -> DataFrame:
    """One row of a run's measures: reads (key, length), those mapped, and means and shares over their counters.

    Shares are percentages; a measure over nothing is null. lost_on_seeding are reads without a seeded bucket,
    lost_on_pruning those with one and without a mapping; match_inefficiency is seed matches over the shared k-mers of
    the reported mappings, possible_ratio possible matches over seed matches. Reads without k-mers have no counters.
    """
    rows = reads.select(key, F.col(length).alias("_length")).join(counters, key, "left").join(mapped.select(key, "score", "shared", "mapq", "final_buckets"), key, "left")
    names = ["kmers", "kmers_unique", "kmers_notmatched", "seeds", "possible_matches", "seed_matches", "seeded_buckets"]
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    found = F.col("score").isNotNull()
    seen = F.coalesce("seeded_buckets", F.lit(0)) > 0
    sums = rows.agg(
        F.count("*").alias("reads"), F.sum("_length").alias("read_len"), count(found).alias("mapped"), count(~seen).alias("lost_on_seeding"), count(seen & ~found).alias("lost_on_pruning"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), F.max("max_seed_matches").alias("max_seed_matches"), F.coalesce(F.sum("shared"), F.lit(0)).alias("reported_matches"), F.coalesce(F.sum("final_buckets"), F.lit(0)).alias("final_buckets"),
        F.avg("score").alias("mean_score"), count(F.col("mapq") == 60).alias("mapq60"), count(F.col("mapq") == 0).alias("mapq0"),
    )
    per = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    share = lambda a, b: F.round(100 * F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    return sums.select(
        "reads", "mapped", "lost_on_seeding", "lost_on_pruning", "mapq60", "mapq0", "max_seed_matches", F.round("mean_score", 6).alias("mean_score"), per("read_len", "reads").alias("read_length"),
        share("mapped", "reads").alias("mapped_pc"), share("lost_on_seeding", "reads").alias("lost_on_seeding_pc"), share("lost_on_pruning", "reads").alias("lost_on_pruning_pc"), share("mapq60", "mapped").alias("mapq60_pc"), share("mapq0", "mapped").alias("mapq0_pc"),
        *(per(c, "reads").alias(f"{c}_per_read") for c in [*names, "reported_matches"]), *(share(c, "kmers").alias(f"{c}_pc") for c in ("kmers_unique", "kmers_notmatched", "seeds")),
        per("final_buckets", "mapped").alias("final_buckets_per_mapping"), per("seed_matches", "reported_matches").alias("match_inefficiency"), per("possible_matches", "seed_matches").alias("possible_ratio"),
    )


def run_warnings(stats: DataFrame) -> DataFrame:
    """(warning, value) of the thresholds that a run's statistics miss; those on times of single steps are ``time_warnings``."""
    rules = {
        "mapped_reads": (F.col("mapped") < 0.95 * F.col("reads"), F.try_divide(F.col("mapped").cast("double"), F.col("reads"))),
        "possible_matches": (F.col("possible_ratio") < 10, F.col("possible_ratio")),
        "mapq": (F.col("mapq60") < F.col("mapq0"), F.col("mapq60").cast("double")),
    }
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("warning"), F.round(v, 6).alias("value"))) for k, (c, v) in rules.items())))
    return stats.select(F.explode(found).alias("x")).select("x.*")


#: Which step takes more than which percentage of which other's time.
TIME_RULES = (("match_seeds", "mapping", 90.0), ("match_rest", "mapping", 90.0), ("match_rest_for_best2", "match_rest", 40.0))


def time_warnings(seconds: dict[str, float]) -> list[tuple[str, float]]:
    """(step, percentage) of the steps that take more than their share, from seconds by step (see ``plans.meters``)."""
    shares = ((a, 100 * seconds[a] / seconds[b], most) for a, b, most in TIME_RULES if a in seconds and seconds.get(b))
    return [(a, x) for a, x, most in shares if x > most]
