"""Difference strings and variants: what alignments differ in, calls, selection by length, comparison of call sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchlark.operators.intervals import depth, overlap_join


def cs_moves(cs: Column | str) -> Column:
    """A difference string as an array of (op, arg, n): n letters matched (``:`` ``=``), replaced (``*``), inserted or deleted."""

    def one(x: Column) -> Column:
        op, arg = F.left(x, F.lit(1)), F.substr(x, F.lit(2))
        n = F.when(op == ":", arg.try_cast("int")).when(op == "*", 1).otherwise(F.length(arg))
        return F.struct(op.alias("op"), arg.alias("arg"), n.alias("n"))

    return F.transform(F.regexp_extract_all(cs, F.lit(r"([:=*+-](?:\d+|[A-Za-z]+))"), 1), one)


def cs_sequence(cs: Column | str, query: bool) -> Column:
    """The aligned letters of the query or the target, of a long difference string; null for the short form, which lacks them."""
    letter = F.lit(2 if query else 1)
    gone = "-" if query else "+"
    part = lambda x: F.when(x.op == "=", x.arg).when(x.op == gone, "").when(x.op == "*", F.upper(F.substr(x.arg, letter, F.lit(1)))).otherwise(F.upper(x.arg))
    moves = cs_moves(cs)
    return F.when(~F.exists(moves, lambda x: x.op == ":"), F.array_join(F.transform(moves, part), ""))


def cs_variants(alignments: DataFrame, key: str = "aln_id") -> DataFrame:
    """(key, place, segm_name, st, en, mapq, ref, alt, query_id, q_st, q_en, strand): one row for each difference.

    Alignments are (key, query_id, P_start, P_end, strand, segm_name, T_l, mapq, cs). ``-`` stands for no letters. Letters
    replaced by or replacing ``n`` are left out. A null cs has no differences.
    """
    kept = [key, "query_id", "P_start", "P_end", "strand", "segm_name", "T_l", "mapq"]
    moves = alignments.select(*kept, F.posexplode(cs_moves("cs")).alias("place", "x")).select(*kept, "place", "x.*")
    moves = moves.withColumns({"_on_t": F.when(F.col("op") != "+", F.col("n")).otherwise(0), "_on_q": F.when(F.col("op") != "-", F.col("n")).otherwise(0)})
    before = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    found = moves.withColumns({"st": F.col("T_l") + at("_on_t"), "_q": at("_on_q")}).where("op in ('*', '+', '-')")
    q_st = F.when(F.col("strand") == "-", F.col("P_end") - F.col("_q") - F.col("_on_q")).otherwise(F.col("P_start") + F.col("_q"))
    swap = F.col("op") == "*"
    ref = F.when(swap, F.substr("arg", F.lit(1), F.lit(1))).when(F.col("op") == "+", "-").otherwise(F.col("arg"))
    alt = F.when(swap, F.substr("arg", F.lit(2), F.lit(1))).when(F.col("op") == "-", "-").otherwise(F.col("arg"))
    found = found.where(~swap | ~F.lower("arg").contains("n"))
    return found.select(key, "place", "segm_name", "st", (F.col("st") + F.col("_on_t")).alias("en"), "mapq", ref.alias("ref"), alt.alias("alt"), "query_id", q_st.alias("q_st"), (q_st + F.col("_on_q")).alias("q_en"), "strand")


def usable_alignments(paf: DataFrame, min_len: int = 10_000, min_mapq: int = 5) -> DataFrame:
    """Rows of ``parse_paf`` that calls rest on: mapped, long and sure enough, primary; ``cs`` is taken from the tags."""
    tag = lambda n: F.try_element_at("tags", F.lit(n))
    secondary = F.coalesce(tag("tp").isin("S", "i"), F.lit(False)) | (tag("s1").isNotNull() & tag("s2").isNull())
    return paf.where((F.col("segm_name") != "*") & (F.col("blk_len") >= min_len) & (F.col("mapq") >= min_mapq) & ~secondary).withColumn("cs", tag("cs"))


def call_variants(usable: DataFrame, width: int, min_var_len: int = 50_000, key: str = "aln_id") -> DataFrame:
    """``cs_variants`` of alignments of min_var_len columns or more, with ``depth``: usable alignments there, the own included.

    Another alignment counts if it begins at or before the variant and, when it begins before the variant's own alignment,
    ends behind the variant's start, else reaches its end. Calls to trust have a depth of 1. Alignments meet variants in
    bins of ``width`` positions and are counted per variant, so no task holds a whole segment.
    """
    found = cs_variants(usable.where(F.col("blk_len") >= min_var_len), key)
    own = usable.select(F.col(key).alias("_key"), F.col("T_l").alias("_own"))
    points = found.join(own, F.col(key) == F.col("_key")).select("segm_name", "st", (F.col("st") + 1).alias("en"), F.col("en").alias("_end"), key, "place", "_own")
    spans = usable.select("segm_name", F.col("T_l").alias("st"), (F.col("T_r") + 1).alias("en"), key)
    met = overlap_join(points, spans, width, "segm_name").where(F.col(key) != F.col(f"{key}_b"))
    earlier = F.struct(F.col("st_b"), F.col(f"{key}_b")) < F.struct(F.col("_own"), F.col(key))
    met = met.where(F.when(earlier, F.col("en_b") - 1 > F.col("st")).otherwise(F.col("_end") < F.col("en_b")))
    others = met.groupBy(key, "place").agg(F.count("*").alias("_others"))
    return found.join(others, [key, "place"], "left").withColumn("depth", 1 + F.coalesce("_others", F.lit(0))).drop("_others")


def called_regions(usable: DataFrame, width: int, min_var_len: int = 50_000) -> DataFrame:
    """(segm_name, st, en): stretches that exactly one usable alignment covers, that one having min_var_len columns or more."""
    spans = usable.select("segm_name", F.col("T_l").alias("st"), F.col("T_r").alias("en"), "blk_len")
    once = depth(spans, "segm_name").where("depth = 1").drop("depth")
    return overlap_join(once, spans.where(F.col("blk_len") >= min_var_len), width, "segm_name").select("segm_name", "st", "en")


def vcf_lines(called: DataFrame, before: Column) -> DataFrame:
    """(segm_name, pos, line): VCF rows of calls with a depth of 1; ``before`` is the target's letter in front of ``st``."""
    swap = (F.col("ref") != "-") & (F.col("alt") != "-")
    bare = lambda c: F.when(F.col(c) == "-", "").otherwise(F.upper(c))
    rows = called.where((F.col("depth") == 1) & (swap | (F.col("st") > 0)))
    pos = F.when(swap, F.col("st") + 1).otherwise(F.col("st"))
    allele = lambda c: F.when(swap, F.upper(c)).otherwise(F.concat(F.upper(before), bare(c)))
    info = F.concat(F.lit("QNAME="), "query_id", F.lit(";QSTART="), (F.col("q_st") + 1).cast("string"), F.lit(";QSTRAND="), "strand")
    line = F.concat_ws("\t", "segm_name", pos.cast("string"), F.lit("."), allele("ref"), allele("alt"), F.col("mapq").cast("string"), F.lit("."), info, F.lit("GT"), F.lit("1/1"))
    return rows.select("segm_name", pos.alias("pos"), line.alias("line"))


def allele_lengths(ref: str = "ref", alts: str = "alts", info: str = "info") -> dict[str, Column]:
    """change, least and most: how alleles differ in length from the reference's, by ``SVLEN`` and by spelled-out alleles.

    ``change`` is SVLEN unless a spelled-out allele differs by more; of several alleles the first that differs most. It is
    null if nothing differs; ``least`` is null and ``most`` 0 without any SVLEN or spelled-out allele.
    """
    given = F.nullif(F.regexp_extract(info, r"(?:^|;)SVLEN=(-?\d+)", 1).try_cast("int"), F.lit(0))
    spelled = F.filter(alts, lambda a: ~a.rlike(r"^<\S+>$"))
    diffs = F.transform(spelled, lambda a: F.length(a) - F.length(ref))
    sizes = F.transform(diffs, F.abs)
    most = F.array_max(sizes)
    first = F.get(F.filter(diffs, lambda d: F.abs(d) == most), 0)
    return {
        "change": F.when(most > F.coalesce(F.abs(given), F.lit(0)), first).otherwise(given),
        "least": F.least(F.abs(given), F.array_min(sizes)),
        "most": F.greatest(F.abs(given), most, F.lit(0)),
    }


def select_variants(variants: DataFrame, min_len: int = 0, max_len: int | None = None) -> DataFrame:
    """Variants (ref, alts, info) whose alleles differ in length by min_len or more, and not all by more than max_len."""
    found = variants.withColumns({f"_{k}": v for k, v in allele_lengths().items()}).where(F.col("_most") >= min_len)
    if max_len is not None:
        found = found.where(F.col("_least") <= max_len)
    return found.drop("_change", "_least", "_most")


def structural(variants: DataFrame, min_len: int = 30, max_len: int = 100_000) -> DataFrame:
    """(chrom, st, en, change, n): long variants (chrom, pos, ref, alts, info) and how many rows each has; no inversions or joins."""
    alt = F.array_join("alts", ",")
    rows = variants.where(~alt.isin("<INV>", "<INVDUP>") & ~alt.rlike(r"[\[\]]")).withColumn("change", allele_lengths()["change"])
    rows = rows.where(F.abs("change").between(min_len, max_len)).withColumn("st", F.col("pos") - 1)
    said = F.regexp_extract("info", r"(?:^|;)END=(\d+)", 1).try_cast("bigint")
    end = F.coalesce(said, F.when(F.col("change") < 0, F.col("st") - F.col("change")), F.col("st") + F.length("ref"))
    rows = rows.withColumn("en", F.greatest(end, F.col("st")))
    empty = F.col("st") == F.col("en")
    rows = rows.select("chrom", F.when(empty, F.col("st") - 1).otherwise(F.col("st")).alias("st"), F.when(empty, F.col("en") + 1).otherwise(F.col("en")).alias("en"), "change")
    return rows.groupBy("chrom", "st", "en", "change").agg(F.count("*").alias("n"))


def matched_structural(these: DataFrame, others: DataFrame, width: int, min_len: int = 50, window: int = 500, ratio: float = 0.5) -> DataFrame:
    """(n, matched) over variants of ``structural`` with a length of min_len or more.

    A variant is matched by others of its kind (longer or shorter) in its window: by a single one only if their lengths
    differ by less than min_len or less than ``ratio`` of its own; by several always.
    """
    own = these.where(F.abs("change") >= min_len)
    reach = F.lit(window) + F.floor(F.abs("change") / 2)
    around = own.select("chrom", F.greatest(F.col("st") - reach, F.lit(0)).alias("st"), (F.col("en") + reach).alias("en"), F.col("change"), F.struct("chrom", "st", "en", "change").alias("_id"))
    met = overlap_join(around, others, width).where(F.signum("change") == F.signum("change_b"))
    met = met.groupBy("_id").agg(F.sum("n_b").alias("_many"), F.max("change_b").alias("_one"))
    both = own.withColumn("_id", F.struct("chrom", "st", "en", "change")).join(met, "_id", "left")
    off = F.abs(F.abs("_one") - F.abs("change"))
    hit = (F.col("_many") > 1) | ((F.col("_many") == 1) & ((off < min_len) | (off < ratio * F.abs("change"))))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(total("n").alias("n"), total(F.when(hit, F.col("n"))).alias("matched"))


def compare_structural(base: DataFrame, calls: DataFrame, width: int = 10_000, **limits) -> DataFrame:
    """(measure, n, matched, share): sensitivity ``SN`` over base variants, precision ``PC`` over calls; share is null over none."""
    a, b = structural(base), structural(calls)
    rows = [matched_structural(x, y, width, **limits).select(F.lit(name).alias("measure"), "n", "matched") for name, x, y in (("SN", a, b), ("PC", b, a))]
    return rows[0].union(rows[1]).withColumn("share", F.round(F.try_divide("matched", "n"), 6))
