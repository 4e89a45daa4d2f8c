"""Expressions over sequences, strands, scores and intervals."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = string.ascii_uppercase + string.ascii_lowercase
PROJECTED = "".join("ACGT"[i % 4] for i in range(26)) * 2
#: Complements of the IUPAC nucleotide codes.
IUPAC, IUPAC_COMPLEMENT = "ACGTUMRWSYKVHDBN", "TGCAAKYWSRMBDHVN"


def dna(text: Column | str) -> Column:
    """A text as a nucleotide sequence: letters cyclically to ACGT by their place in the alphabet, all else left out."""
    return F.regexp_replace(F.translate(text, LETTERS, PROJECTED), "[^ACGT]", "")


def reverse_complement(seq: Column | str) -> Column:
    """Of an upper-case sequence; whatever is not ACGT becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def reverse_complement_iupac(seq: Column | str) -> Column:
    """With ambiguity codes, in either case."""
    return F.reverse(F.translate(seq, IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower()))


def unsigned(h: Column | str) -> Column:
    """A key that orders 64-bit hashes as unsigned numbers."""
    return F.col(h).bitwiseXOR(F.lit(-(1 << 63))) if isinstance(h, str) else h.bitwiseXOR(F.lit(-(1 << 63)))


def containment(shared: Column, m: Column) -> Column:
    return F.try_divide(shared.cast("double"), m)


def jaccard(shared: Column, m: Column, size: Column) -> Column:
    return F.try_divide(shared.cast("double"), m + size - shared)


def seed_bound(m: Column, seeds: Column, matches: Column) -> Column:
    """The largest containment that a bucket can reach after ``seeds`` seeds with ``matches`` matches."""
    return 1.0 - (seeds - matches) / m


def sigmas(x: Column, y: Column) -> Column:
    """|x - y| in deviations of their sum; -1 for either counts as 0."""
    x, y = F.when(x == -1, 0).otherwise(x), F.when(y == -1, 0).otherwise(y)
    return F.try_divide(F.abs(x - y).cast("double"), F.sqrt((x + y).cast("double")))


def overlap_ratio(seg_a: Column, l_a: Column, r_a: Column, seg_b: Column, l_b: Column, r_b: Column) -> Column:
    """Shared length over spanned length; 0 on different segments, 1 where both are the same point."""
    shared = F.greatest(F.lit(0), F.least(r_a, r_b) - F.greatest(l_a, l_b))
    span = F.greatest(r_a, r_b) - F.least(l_a, l_b)
    return F.when(seg_a != seg_b, 0.0).when(span == 0, 1.0).otherwise(shared / span)


def intervals_meet(seg_a: Column, l_a: Column, r_a: Column, seg_b: Column, l_b: Column, r_b: Column) -> Column:
    return (seg_a == seg_b) & (l_a <= r_b) & (l_b <= r_a)


def mapq(score: Column, score2: Column, strands: Column, shared: Column, theta2: float, min_diff: float) -> Column:
    """60 for a score clear of the runner-up's and of theta2, 5 where strands disagree, else 0."""
    cap = F.when(F.abs(strands) < F.floor(shared / 2), 5).otherwise(60)
    return F.when(1 - F.greatest(F.coalesce(score2, F.lit(-1.0)), F.lit(theta2)) / score > min_diff, cap).otherwise(0).cast("int")


def truth(name: Column | str) -> Column:
    """``id!segment!start!end!strand`` as a struct; null unless there are five parts and numeric positions."""
    part = F.split(name, "!")
    start, end = part[2].try_cast("bigint"), part[3].try_cast("bigint")
    fine = (F.size(part) == 5) & start.isNotNull() & end.isNotNull()
    return F.when(fine, F.struct(part[0].alias("id"), part[1].alias("segment"), start.alias("start"), end.alias("end"), part[4].alias("strand")))


def suffixed_number(text: Column | str) -> Column:
    """1.5k, 2M, 3g as whole numbers, halves rounded up."""
    number = F.regexp_extract(text, r"^([0-9]*\.?[0-9]+)[kKmMgG]?$", 1)
    unit = F.lower(F.regexp_extract(text, r"([kKmMgG]?)$", 1))
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return F.when(number != "", F.floor(number.cast("double") * factor + 0.499)).cast("bigint")


def paired_truth(name: Column | str) -> Column:
    """``id!segment!start1_start2!end1_end2!<strand1><strand2>/1`` (or ``/2``) as a struct for that mate; else null."""
    name = F.col(name) if isinstance(name, str) else name
    pattern = r"^(\S+)!(\S+)!(\d+)_(\d+)!(\d+)_(\d+)!([+-])([+-])/([12])$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    of = lambda i, j: F.when(part(9) == "1", part(i)).otherwise(part(j))
    return F.when(F.rlike(name, F.lit(pattern)), F.struct(part(1).alias("id"), part(2).alias("segment"), of(3, 4).try_cast("bigint").alias("start"), of(5, 6).try_cast("bigint").alias("end"), of(7, 8).alias("strand")))


def any_truth(name: Column | str) -> Column:
    """``truth``, or else ``paired_truth``."""
    return F.coalesce(paired_truth(name), truth(name))


def point_in(x: Column, low: Column, high: Column) -> Column:
    """Whether low <= x < high."""
    return (x >= low) & (x < high)
