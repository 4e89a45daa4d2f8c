"""Text formats: PAF rows, CIGAR strings, BED blocks, variant alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchlark.params import Metric, Params


def paf_lines(mapped: DataFrame, params: Params, counters: DataFrame | None = None) -> DataFrame:
    """(query_id, line): twelve columns and tags of each mapping; needs P_sz, segm_name and segm_sz beside ``map_reads``'s columns.

    With ``counters`` (``mapping.read_counters``) the tags of the read's own counts follow. Windows by containment or
    Jaccard end k letters before the read does, buckets at its last letter. A tag without a value, such as t (there is no
    clock per read) and the gt tags, is -1.
    """
    number = lambda c, n=5: F.format_string(f"%.{n}f", F.coalesce(c, F.lit(-1.0)).cast("double"))
    whole = lambda c: F.coalesce(c, F.lit(-1)).cast("string")
    windows = params.metric in (Metric.CONTAINMENT, Metric.JACCARD)
    end = F.col("P_sz") - (params.k + 1 if windows else 1)
    # A runner-up counts as at least theta2, as for the mapping quality.
    score2 = F.greatest(F.coalesce("score2", F.lit(-1.0)), F.lit(params.theta2))
    plain = ["query_id", "P_sz", F.lit(0), end, "strand", "segm_name", "segm_sz", "T_l", "T_r", "P_sz", "P_sz", "mapq"]
    tags = {"p:i": whole(F.col("m")), "s:i": whole(F.col("s")), "I:i": whole(F.col("shared")), "I2:i": whole(F.col("shared2")), "Idiff:i": whole(F.col("shared") - F.coalesce("shared2", F.lit(-1))), "Isdiff:f": number(F.col("sigma_diff")), "J:f": number(F.col("score")), "J2:f": number(score2), "Jdiff:f": number(F.col("score") - score2), "sh:f": number(F.col("sh")), "strand:i": whole(F.col("strands")), "t:f": number(F.lit(-1.0))}
    place = lambda g, b: F.concat_ws(",", whole(F.col(g)), whole(F.col(b)))
    tags |= {"b:s": place("segm_id", "b"), "b2:s": place("segm_id2", "b2")}
    if counters is not None:
        mapped = mapped.join(counters, "query_id", "left")
        tags |= {"k:i": F.lit(str(params.k)), **{f"gt_{x}:f": number(F.lit(-1.0), 3) for x in ("J", "C", "C_bucket")}, **{f"{c}:i": whole(F.col(c)) for c in ("seeds", "max_seed_matches", "seed_matches")}}
        tags |= {"total_matches:i": whole(F.col("seed_matches")), "match_inefficiency:f": number(F.try_divide(F.col("seed_matches").cast("double"), F.col("shared")), 3), **{f"{c}:i": whole(F.col(c)) for c in ("seeded_buckets", "final_buckets")}, "FPTP:f": number(F.lit(-1.0), 3)}
    columns = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in plain]
    return mapped.select("query_id", F.concat_ws("\t", *columns, *(F.concat(F.lit(f"{k}:"), v) for k, v in tags.items())).alias("line"))


def sam_lines(aligned: DataFrame) -> DataFrame:
    """(query_id, line): a SAM row with CIGAR of each mapping (query_id, strand, segm_name, T_l, mapq, read, distance, cigar).

    ``read`` is the read as it lies on the target, so reversed for strand -; T_l is 0-based, and distance the NM tag. A
    null cigar (no alignment) is written as *, without the tag.
    """
    flag = F.when(F.col("strand") == "-", 16).otherwise(0)
    tag = F.when(F.col("cigar").isNotNull(), F.concat(F.lit("NM:i:"), F.col("distance")))
    columns = ["query_id", flag, "segm_name", F.col("T_l") + 1, "mapq", F.coalesce("cigar", F.lit("*")), F.lit("*"), F.lit(0), F.lit(0), "read", F.lit("*")]
    return aligned.select("query_id", F.concat_ws("\t", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in columns), tag).alias("line"))


def parse_paf(lines: DataFrame, column: str = "value") -> DataFrame:
    """The twelve columns, typed, and the tags as a map from name to value."""
    part = F.split(column, "\t")
    names = {"query_id": "string", "P_sz": "int", "P_start": "int", "P_end": "int", "strand": "string", "segm_name": "string", "segm_sz": "int", "T_l": "int", "T_r": "int", "n_match": "int", "blk_len": "int", "mapq": "int"}
    cols = [F.get(part, i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(names.items())]
    pair = lambda t: F.struct(F.split(t, ":", 3)[0].alias("key"), F.split(t, ":", 3)[2].alias("value"))
    tags = F.map_from_entries(F.transform(F.filter(F.slice(part, 13, F.greatest(F.size(part) - 12, F.lit(0))), lambda t: F.size(F.split(t, ":", 3)) == 3), pair))
    return lines.select(*cols, tags.alias("tags"))


def cigar_ops(cigar: Column | str) -> Column:
    """A CIGAR as an array of (n, op)."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHPX=])"), 1)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def cigar_length(cigar: Column | str, ops: str) -> Column:
    """Letters that the moves in ``ops`` cover."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: F.lit(ops).contains(x.op)), F.lit(0), lambda a, x: a + x.n)


def bed_blocks(df: DataFrame) -> DataFrame:
    """BED12 rows (chrom, st, en, name, sizes, starts) as one row per block."""
    ints = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))
    zipped = F.arrays_zip(ints("sizes").alias("n"), ints("starts").alias("at"))
    out = df.select("chrom", "st", "name", F.explode(zipped).alias("z"))
    return out.select("chrom", (F.col("st") + F.col("z.at")).alias("st"), (F.col("st") + F.col("z.at") + F.col("z.n")).alias("en"), "name")


def variant_class(ref: Column, alt: Column) -> Column:
    """ts, tv, mnp, or ins/del with a size class, by the lengths and letters of two alleles."""
    n = F.length(alt) - F.length(ref)
    size = F.when(F.abs(n) == 1, "1").when(F.abs(n) == 2, "2").when(F.abs(n) < 50, "3-49").when(F.abs(n) < 1000, "50-999").otherwise("1000+")
    pair = F.concat(F.upper(ref), F.upper(alt))
    snp = F.when(pair.isin("AG", "GA", "CT", "TC"), "ts").otherwise("tv")
    return F.when(n > 0, F.concat(F.lit("ins:"), size)).when(n < 0, F.concat(F.lit("del:"), size)).when(F.length(ref) == 1, snp).otherwise("mnp")
