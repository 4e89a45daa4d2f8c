"""Comparison of mappings with the truth, with each other and with annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchlark.functions.sequences import any_truth, overlap_ratio, reverse_complement_iupac
from sketchlark.operators.formats import cigar_length, cigar_ops
from sketchlark.operators.intervals import merge, overlap_join, quality_curve


def against_truth(mapped: DataFrame, least: float = 0.1, name: str = "query_id") -> DataFrame:
    """``mapped`` with ``wrong``: the segment, strand or place (shared over spanned length at most ``least``) isn't the one in the name.

    Needs segm_name, strand, T_l, T_r. Names are those of single or paired reads. Rows whose name holds no truth are left out.
    """
    rows = mapped.withColumn("_t", any_truth(name)).where("_t is not null")
    near = overlap_ratio(F.col("segm_name"), F.col("T_l"), F.col("T_r"), F.col("_t.segment"), F.col("_t.start"), F.col("_t.end")) > least
    return rows.withColumn("wrong", ~((F.col("segm_name") == F.col("_t.segment")) & (F.col("strand") == F.col("_t.strand")) & near)).drop("_t")


def judged_reads(mapped: DataFrame, least: float = 0.1, mode: str = "longest", at: str | None = None, cap_short: bool = False) -> DataFrame:
    """One judged row (the columns of ``mapped``, wrong) per read. Of its mappings count

    longest: that with the longest interval, then the first by segment and start; first: the first by column ``at``;
    all: the wrong one of highest quality, or else the right one of highest. With ``cap_short`` no quality is above the
    longest's.
    """
    if mode not in ("longest", "first", "all"):
        raise ValueError("mode must be longest, first or all")
    longest = [(F.col("T_r") - F.col("T_l")).desc(), "segm_name", "T_l"]
    rows = against_truth(mapped, least)
    if cap_short:
        rows = rows.withColumn("mapq", F.least("mapq", F.first("mapq").over(Window.partitionBy("query_id").orderBy(*longest))))
    order = {"longest": longest, "first": [at or "T_l"], "all": [F.col("wrong").desc(), F.col("mapq").desc(), *longest]}[mode]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("_n = 1").drop("_n")


def mapping_errors(mapped: DataFrame, least: float = 0.1, mode: str = "longest", at: str | None = None, cap_short: bool = False) -> DataFrame:
    """Errors by mapping quality over ``judged_reads``, accumulated from the highest down."""
    return quality_curve(judged_reads(mapped, least, mode, at, cap_short))


def error_rows(judged: DataFrame, quality: int = 0) -> DataFrame:
    """The wrong rows of ``judged_reads`` of at least a mapping quality."""
    return judged.where(F.col("wrong") & (F.col("mapq") >= quality))


def simulated_pairs(sam: DataFrame) -> DataFrame:
    """(name, comment, seq, qual): reads with their origin in the name, from rows (query_id, flag, segm_name, pos, cigar, seq, qual, errors, snps, indels).

    pos is 0-based. Reversed rows are turned back. Two mates of a name are named by both places and numbered; a read
    without a mate by its own. A leading ``simulated.`` goes. Two rows of a name that aren't mates raise an error.
    """
    minus = F.col("flag").bitwiseAND(16) != 0
    strand = F.when(minus, "-").otherwise("+")
    mate = F.when(F.col("flag").bitwiseAND(0xC0) == 0x40, 1).when(F.col("flag").bitwiseAND(0xC0) == 0x80, 2).otherwise(0)
    seq = F.when(minus, reverse_complement_iupac("seq")).otherwise(F.col("seq"))
    read = F.struct(mate.alias("mate"), "segm_name", "pos", (F.col("pos") + cigar_length("cigar", "MDN")).alias("stop"), strand.alias("strand"), seq.alias("seq"), F.when(minus, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"), F.concat_ws(":", "errors", "snps", "indels").alias("comment"))
    rows = sam.select(F.regexp_replace("query_id", "^simulated.", "").alias("id"), read.alias("r"))
    both = rows.groupBy("id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    a, b = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    alone = F.concat_ws("!", "id", a.segm_name, a.pos, a["stop"], a.strand)
    paired = F.concat_ws("!", "id", a.segm_name, F.concat_ws("_", a.pos, b.pos), F.concat_ws("_", a["stop"], b["stop"]), F.concat(a.strand, b.strand))
    fine = (F.size("r") == 1) | ((F.size("r") == 2) & (a.mate == 1) & (b.mate == 2))
    name = F.when(~fine, F.raise_error(F.concat(F.lit("mates don't match: "), "id")).cast("string")).when(F.size("r") == 1, alone)
    out = both.select(name.alias("one"), paired.alias("two"), F.explode("r").alias("x"))
    return out.select(F.coalesce("one", F.concat_ws("/", "two", "x.mate")).alias("name"), "x.comment", "x.seq", "x.qual")


def compare_mappings(base: DataFrame, test: DataFrame, order: str, min_len: int = 5000, min_mapq: int = 10, share: float = 0.5) -> DataFrame:
    """(query_id, verdict) of each read that ``base`` maps once, with min_len letters and a quality of min_mapq or more.

    Both hold primary mappings (query_id, P_sz, segm_name, T_l, T_r, mapq). Of ``test`` the first by ``order`` counts, if
    the read has min_len letters there. ``hit``: on the same segment, and from the later start to the end of the mapping
    that starts first it is at least ``share`` of the length from the earlier start to the end of the other; ``wrong``: a
    test mapping that isn't a hit; ``missing``: none.
    """
    own = base.groupBy("query_id").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("P_sz", "segm_name", "T_l", "T_r", "mapq")))
    own = own.where((F.col("n") == 1) & (F.col("P_sz") >= min_len) & (F.col("mapq") >= min_mapq))
    found = test.groupBy("query_id").agg(F.min_by(F.struct("P_sz", "segm_name", "T_l", "T_r"), order).alias("o")).where(F.col("o.P_sz") >= min_len)
    both = own.join(found, "query_id", "left")
    base_first = F.col("T_l") < F.col("o.T_l")
    first_end, second_end = F.when(base_first, F.col("T_r")).otherwise(F.col("o.T_r")), F.when(base_first, F.col("o.T_r")).otherwise(F.col("T_r"))
    low, high = F.least("T_l", "o.T_l"), F.greatest("T_l", "o.T_l")
    hit = (F.col("segm_name") == F.col("o.segm_name")) & (first_end > high) & (first_end - high >= share * (second_end - low))
    return both.select("query_id", F.when(F.col("o").isNull(), "missing").when(hit, "hit").otherwise("wrong").alias("verdict"))


def overlapping_reads(mapped: DataFrame, min_len: int, width: int, chrom: str = "chrom", read: str = "read") -> DataFrame:
    """(a, b): pairs of different reads, a < b, whose intervals on a chrom share min_len positions or more."""
    long = mapped.where(F.col("en") - F.col("st") >= min_len).select(chrom, "st", "en", read)
    pairs = overlap_join(long, long, width, chrom).where((F.col(read) < F.col(f"{read}_b")) & (F.least("en", "en_b") - F.greatest("st", "st_b") >= min_len))
    return pairs.select(F.col(read).alias("a"), F.col(f"{read}_b").alias("b")).distinct()


def overlap_sensitivity(inferred: DataFrame, reported: DataFrame) -> DataFrame:
    """(overlaps, missing, sensitivity in percent) of reported pairs, in either order, against inferred ones (a < b)."""
    seen = reported.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("seen", F.lit(1))
    out = inferred.join(seen, ["a", "b"], "left").agg(F.count("*").alias("overlaps"), F.count(F.when(F.col("seen").isNull(), 1)).alias("missing"))
    return out.withColumn("sensitivity", F.round(100 * (1 - F.try_divide("missing", "overlaps")), 2))


def covered_targets(targets: DataFrame, regions: DataFrame, width: int, keys: list[str], chrom: str = "chrom", exclude: DataFrame | None = None) -> DataFrame:
    """(keys, size, covered): positions of each target that the union of the regions covers; targets without any have 0.

    Targets that meet an interval of ``exclude`` are left out.
    """
    named = targets.select(chrom, "st", "en", *keys)
    if exclude is not None:
        met = overlap_join(named, exclude.select(chrom, "st", "en"), width, chrom).select(*keys).distinct()
        named = named.join(met, keys, "left_anti")
    shared = overlap_join(named, merge(regions.where("st < en"), chrom), width, chrom)
    found = shared.groupBy(*keys).agg(F.sum(F.least("en", "en_b") - F.greatest("st", "st_b")).alias("covered"))
    return named.select(*keys, (F.col("en") - F.col("st")).alias("size")).join(found, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def allele_counts(variants: DataFrame) -> DataFrame:
    """One row of counts over (ref string, alts array): substitutions, transitions and transversions, insertions, deletions by size.

    Symbolic alleles (``<`` first, or ``>`` second) are left out. Letters are compared place by place up to the shorter end.
    """
    rows = variants.select("ref", F.explode("alts").alias("alt")).where(~F.startswith("alt", F.lit("<")) & (F.substring("alt", 2, 1) != ">"))
    n = F.least(F.length("ref"), F.length("alt"))
    letters = lambda c: F.split(F.left(F.col(c), n), "")
    changes = F.filter(F.zip_with(letters("ref"), letters("alt"), lambda a, b: F.concat(a, b)), lambda p: F.left(p, F.lit(1)) != F.right(p, F.lit(1)))
    ts = F.filter(changes, lambda p: p.isin("AG", "GA", "CT", "TC"))
    rows = rows.select(F.size(changes).alias("sub"), F.size(ts).alias("ts"), (F.length("alt") - F.length("ref")).alias("d"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sizes = {"1": (1, 1), "2": (2, 2), "50": (3, 49), "1k": (50, 999), "7k": (1000, 6999), "inf": (7000, None)}

    def class_count(sign: int, low: int, high: int | None) -> Column:
        d = F.col("d") * sign
        return F.count(F.when((d >= low) & (d <= high if high is not None else F.lit(True)), 1))

    signs = {"ins": 1, "del": -1}
    return rows.agg(
        total("sub").alias("sub"), total("ts").alias("ts"), (total("sub") - total("ts")).alias("tv"),
        *(class_count(s, 1, None).alias(k) for k, s in signs.items()),
        *(class_count(s, low, high).alias(f"{k}{label}") for k, s in signs.items() for label, (low, high) in sizes.items()),
    )


def cigar_steps(alignments: DataFrame, key: str, q_start: Column, t_start: Column, cigar: str = "cigar") -> DataFrame:
    """(key, n, op, q_at, t_at): each move of an alignment with the query and target position where it begins."""
    uses = lambda ops: F.when(F.instr(F.lit(ops), F.col("x.op")) > 0, F.col("x.n")).otherwise(0)
    moves = alignments.select(key, q_start.alias("_q"), t_start.alias("_t"), F.posexplode(cigar_ops(cigar)).alias("_i", "x"))
    before = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda ops: F.coalesce(F.sum(uses(ops)).over(before), F.lit(0))
    return moves.select(key, "x.n", "x.op", (F.col("_q") + at("MIS=X")).alias("q_at"), (F.col("_t") + at("MDN=X")).alias("t_at"))


def usable_alignments(alignments: DataFrame, min_mapq: int = 5, min_len: int = 50_000, max_diff: float = 1.0) -> DataFrame:
    """Primary alignments of a quality, length on the target and share of differences (a null diff counts as none) or better."""
    fine = F.col("is_primary") & (F.col("mapq") >= min_mapq) & (F.col("T_r") - F.col("T_l") >= min_len) & (F.coalesce("diff", F.lit(0.0)) <= max_diff)
    return alignments.where(fine)


def lift_over(alignments: DataFrame, regions: DataFrame, key: str = "aln_id") -> DataFrame:
    """(key, segm_name, st, en, name, strand): regions of queries carried over to the targets of their alignments.

    Alignments are (key, query_id, P_sz, P_start, P_end, strand, segm_name, T_l, T_r, cigar), regions (query_id, st, en).
    A region has a row for each alignment whose query interval it meets. Where one of its ends lies outside of the
    aligned part, the target's end takes its place and the name gets ``_t5`` or ``_t3``. Each position is looked up in the
    move that begins last before it, in one sort per alignment.
    """
    alignments = alignments.withColumn("_q", F.when(F.col("strand") == "+", F.col("P_start")).otherwise(F.col("P_sz") - F.col("P_end")))
    met = alignments.join(regions, "query_id").where((F.col("st") < F.col("P_end")) & (F.col("P_start") < F.col("en")) & (F.col("st") < F.col("en")))
    forward = F.col("strand") == "+"
    met = met.withColumns({"_low": F.when(forward, F.col("st")).otherwise(F.col("P_sz") - F.col("en")), "_high": F.when(forward, F.col("en") - 1).otherwise(F.col("P_sz") - F.col("st") - 1)})
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("_low").alias("q")), F.struct(F.lit(1).alias("end"), F.col("_high").alias("q"))))
    points = met.select(key, "st", "en", ends.alias("e")).select(key, "st", "en", "e.end", F.col("e.q").cast("long").alias("q"), F.lit(None).cast("struct<q:bigint,t:bigint,n:int,op:string>").alias("move"))
    steps = cigar_steps(alignments, key, F.col("_q"), F.col("T_l")).where("op in ('M', 'I', '=', 'X')")
    move = F.struct(F.col("q_at").cast("long").alias("q"), F.col("t_at").cast("long").alias("t"), F.col("n"), F.col("op"))
    starts = steps.select(key, F.lit(None).cast(points.schema["st"].dataType).alias("st"), F.lit(None).cast(points.schema["en"].dataType).alias("en"), F.lit(-1).alias("end"), F.col("q_at").cast("long").alias("q"), move.alias("move"))
    order = Window.partitionBy(key).orderBy("q", "end").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(points).withColumn("move", F.last("move", ignorenulls=True).over(order)).where("end >= 0")
    place = F.when(F.col("q") < F.col("move.q") + F.col("move.n"), F.when(F.col("move.op") == "I", F.col("move.t")).otherwise(F.col("move.t") + F.col("q") - F.col("move.q")))
    lifted = found.groupBy(key, "st", "en").agg(F.max(F.when(F.col("end") == 0, place)).alias("low"), F.max(F.when(F.col("end") == 1, place)).alias("high"))
    out = lifted.join(alignments, key)
    name = F.concat(F.concat_ws("_", "query_id", "st", "en"), F.when(F.col("low").isNull(), "_t5").otherwise(""), F.when(F.col("high").isNull(), "_t3").otherwise(""))
    return out.select(key, "segm_name", F.coalesce("low", "T_l").alias("st"), F.coalesce(F.col("high") + 1, F.col("T_r")).alias("en"), name.alias("name"), "strand")


def introns(alignments: DataFrame, key: str = "aln_id") -> DataFrame:
    """(key, st, en): the stretches of the target that an alignment's ``N`` moves skip."""
    steps = cigar_steps(alignments, key, F.lit(0), F.col("T_l"))
    return steps.where("op = 'N'").select(key, F.col("t_at").alias("st"), (F.col("t_at") + F.col("n")).alias("en"))


def exon_blocks(alignments: DataFrame, key: str = "aln_id") -> DataFrame:
    """(key, st, en): the stretches of the target between ``N`` moves, one per exon."""
    steps = cigar_steps(alignments, key, F.lit(0), F.col("T_l")).where("op in ('M', 'D', 'N', '=', 'X')")
    order = Window.partitionBy(key).orderBy("t_at", "n").rowsBetween(Window.unboundedPreceding, 0)
    exons = steps.withColumn("_exon", F.sum(F.when(F.col("op") == "N", 1).otherwise(0)).over(order)).where("op <> 'N'")
    return exons.groupBy(key, "_exon").agg(F.min("t_at").alias("st"), F.max(F.col("t_at") + F.col("n")).alias("en")).drop("_exon")
