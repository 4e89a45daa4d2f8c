"""Alignments in other text formats: SAM, delta files of genome aligners, MAF of simulated reads."""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sketchlark.functions.sequences import reverse_complement
from sketchlark.operators.formats import cigar_length, cigar_ops
from sketchlark.sources.fasta import _text


def difference(seq: str, cigar: str, changes: str, long: bool = False) -> str | None:
    """The difference string of a read, by its CIGAR and MD tag; None if the two don't fit each other.

    The MD tag is laid out as one target letter per aligned column (None: as in the read) and a list of deleted runs;
    the CIGAR then takes columns, read letters and runs in its order.
    """
    columns, runs = [], []
    for same, run, letter in re.findall(r"(\d+)|\^([A-Za-z]+)|([A-Za-z])", changes):
        if run:
            runs.append(run)
        else:
            columns += [None] * int(same) if same else [letter]
    out, at, column, deleted = [], 0, 0, iter(runs)
    moves = [(int(n), "M" if op in "=X" else op) for n, op in re.findall(r"(\d+)([MIDNS=X])", cigar)]
    for op, group in itertools.groupby(moves, key=lambda m: m[1]):
        n = sum(x for x, _ in group)
        if op == "M":
            part = columns[column : column + n]
            if len(part) < n:
                return None
            for same, places in itertools.groupby(range(n), key=lambda i: part[i] is None):
                places = list(places)
                if not same:
                    out += [f"*{part[i]}{seq[at + i]}" for i in places]
                else:
                    out.append(f"={seq[at + places[0] : at + places[-1] + 1]}" if long else f":{len(places)}")
            column += n
        elif op == "I":
            out.append(f"+{seq[at : at + n]}")
        elif op == "D":
            run = next(deleted, "")
            if len(run) != n:
                return None
            out.append(f"-{run}")
        at += n if op in "MIS" else 0
    return "".join(out) if column == len(columns) and next(deleted, None) is None else None


def sam_to_paf(lines: DataFrame, column: str = "value", primary_only: bool = False, long: bool = False) -> DataFrame:
    """The columns of ``parse_paf`` for SAM text: mapped rows, lengths of segments from ``@SQ`` lines.

    Tags: tp, mm, gn, go, cg without clips, and cs (given, or made from MD). Mismatches are counted by X moves if the CIGAR has
    no M, else as NM without gaps, else taken as 0. Rows whose segment has no length, that end behind it, or whose
    sequence doesn't fit the CIGAR are left out.
    """
    header = lines.where(F.startswith(column, F.lit("@SQ")))
    sizes = header.select(F.regexp_extract(column, r"\tSN:(\S+)", 1).alias("segm_name"), F.regexp_extract(column, r"\tLN:(\d+)", 1).try_cast("int").alias("segm_sz")).distinct()
    part = F.split(column, "\t")
    tag = lambda name, kind: F.nullif(F.regexp_extract(column, rf"\t{name}:{kind}:(\S+)", 1), F.lit(""))
    rows = lines.where(~F.startswith(column, F.lit("@")) & (F.size(part) >= 11))
    rows = rows.select(F.get(part, 0).alias("name"), F.get(part, 1).try_cast("int").alias("flag"), F.get(part, 2).alias("segm_name"), (F.get(part, 3).try_cast("int") - 1).alias("T_l"), F.get(part, 4).try_cast("int").alias("mapq"), F.get(part, 5).alias("cigar"), F.get(part, 9).alias("seq"), tag("NM", "i").try_cast("int").alias("nm"), tag("MD", "Z").alias("md"), tag("cs", "Z").alias("given"))
    has = lambda bit: F.col("flag").bitwiseAND(bit) != 0
    rows = rows.where((F.col("segm_name") != "*") & (F.col("cigar") != "*") & ~has(4))
    if primary_only:
        rows = rows.where(~has(0x100))
    clip = lambda pattern: F.coalesce(F.regexp_extract("cigar", pattern, 1).try_cast("int"), F.lit(0))
    count = lambda ops: F.size(F.filter(cigar_ops("cigar"), lambda x: x.op.isin(*ops)))
    rows = rows.withColumns({"_first": clip(r"^(?:\d+H)?(\d+)S") + clip(r"^(\d+)H"), "_last": clip(r"(?<=[A-Z=])(\d+)S(?:\d+H)?$") + clip(r"(?<=[A-Z=])(\d+)H$"), "_M": cigar_length("cigar", "M=X"), "_X": cigar_length("cigar", "X"), "_gaps": cigar_length("cigar", "ID"), "_I": cigar_length("cigar", "I"), "_on_t": cigar_length("cigar", "M=XDN"), "_soft": cigar_length("cigar", "S"), "_opened": count("ID")})
    exact = (count("=X") > 0) & (count("M") == 0)
    rows = rows.withColumn("_mm", F.when(exact, F.col("_X")).otherwise(F.greatest(F.coalesce(F.col("nm") - F.col("_gaps"), F.lit(0)), F.lit(0))))
    told = exact | F.col("nm").isNotNull()
    rows = rows.join(sizes, "segm_name").withColumn("T_r", F.col("T_l") + F.col("_on_t"))
    rows = rows.where((F.col("T_r") <= F.col("segm_sz")) & ((F.col("seq") == "*") | (F.length("seq") == F.col("_M") + F.col("_I") + F.col("_soft"))))

    @F.pandas_udf("string")
    def made(seq: pd.Series, cigar: pd.Series, md: pd.Series) -> pd.Series:
        return pd.Series([None if m is None or s == "*" else difference(s, c, m, long) for s, c, m in zip(seq, cigar, md)], dtype=object)

    mate = F.when(has(1) & has(0x40), "/1").when(has(1) & has(0x80), "/2").otherwise("")
    size = F.col("_M") + F.col("_I") + F.col("_first") + F.col("_last")
    minus = has(16)
    tags = {"tp": F.when(has(0x100), "S").otherwise("P"), "mm": F.when(told, F.col("_mm").cast("string")), "gn": F.col("_gaps").cast("string"), "go": F.col("_opened").cast("string"), "cg": F.regexp_replace("cigar", r"\d+[SH]", ""), "cs": F.when(F.col("seq") != "*", F.coalesce("given", made("seq", "cigar", "md")))}
    tags = F.map_filter(F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    start = F.when(minus, F.col("_last")).otherwise(F.col("_first"))
    return rows.select(F.concat("name", mate).alias("query_id"), size.alias("P_sz"), start.alias("P_start"), (start + F.col("_M") + F.col("_I")).alias("P_end"), F.when(minus, "-").otherwise("+").alias("strand"), "segm_name", "segm_sz", "T_l", "T_r", (F.col("_M") - F.col("_mm")).alias("n_match"), (F.col("_M") + F.col("_gaps")).alias("blk_len"), "mapq", tags.alias("tags"))


@F.pandas_udf(StringType())
def _delta_cigar(steps: pd.Series, length: pd.Series) -> pd.Series:
    """Distances between gaps (positive: a letter of the target only) and the target's length -> CIGAR."""

    def one(distances, total: int) -> str:
        moves = []
        for d in distances:
            moves += [("M", abs(int(d)) - 1), ("D" if d > 0 else "I", 1)]
        used = sum(n for op, n in moves if op != "I")
        moves.append(("M", int(total) - used))
        runs = itertools.groupby((m for m in moves if m[1]), key=lambda m: m[0])
        return "".join(f"{sum(n for _, n in group)}{op}" for op, group in runs)

    return pd.Series([one(d, n) for d, n in zip(steps, length)], dtype=object)


def read_delta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The columns of ``parse_paf`` for delta files, tags NM and cg; mapq is 0. Each pair of sequences is one record."""
    piece = _text(spark, paths, "\n>").select(F.regexp_replace("value", r"\r", "").alias("p"))
    head = lambda i: F.regexp_extract("p", r"^>?(\S+)\s+(\S+)\s+(\d+)\s+(\d+)[^\n]*(?:\n|$)", i)
    rows = piece.select(*(head(i).alias(n) for i, n in enumerate(("segm_name", "query_id", "segm_sz", "P_sz"), 1)), F.explode(F.regexp_extract_all("p", F.lit(r"(?<=\n)(\d+ \d+ \d+ \d+ \d+ \d+ \d+(?:\n-?\d+(?=\n|$))*)"), 1)).alias("a")).where("segm_sz <> ''")
    line = F.split("a", "\n")
    x = F.transform(F.split(line[0], " "), lambda v: v.cast("int"))
    steps = F.filter(F.transform(F.slice(line, 2, F.size(line)), lambda v: v.cast("int")), lambda v: v != 0)
    rows = rows.select("segm_name", "query_id", F.col("segm_sz").cast("int").alias("segm_sz"), F.col("P_sz").cast("int").alias("P_sz"), x.alias("x"), steps.alias("steps"))
    ends = {"T_l": F.least(F.col("x")[0], F.col("x")[1]) - 1, "T_r": F.greatest(F.col("x")[0], F.col("x")[1]), "P_start": F.least(F.col("x")[2], F.col("x")[3]) - 1, "P_end": F.greatest(F.col("x")[2], F.col("x")[3])}
    rows = rows.withColumns(ends).withColumn("cg", _delta_cigar("steps", F.col("T_r") - F.col("T_l")))
    rows = rows.withColumn("blk_len", F.col("T_r") - F.col("T_l") + F.size(F.filter("steps", lambda v: v < 0)))
    same = (F.col("x")[0] < F.col("x")[1]) == (F.col("x")[2] < F.col("x")[3])
    tags = F.create_map(F.lit("NM"), F.col("x")[4].cast("string"), F.lit("cg"), F.col("cg"))
    return rows.select("query_id", "P_sz", "P_start", "P_end", F.when(same, "+").otherwise("-").alias("strand"), "segm_name", "segm_sz", "T_l", "T_r", (F.col("blk_len") - F.col("x")[4]).alias("n_match"), "blk_len", F.lit(0).alias("mapq"), tags.alias("tags"))


def read_simulated_maf(spark: SparkSession, paths: str | list[str], segments: DataFrame) -> DataFrame:
    """(name, seq) of simulated reads with their origin in the name, from MAF blocks of a reference and a read line.

    ``segments`` are (number, segm_name); a read named ``S2_7`` comes from number 2. Reads with two N in a row are left
    out, and so are those of a number without a name. A read of another length than its block says raises an error.
    """
    blocks = _text(spark, paths, "\na").select(F.regexp_extract_all("value", F.lit(r"(?:^|\n)s\s+([^\n]+)"), 1).alias("s")).where(F.size("s") >= 2)
    fields = lambda i: F.split(F.trim(F.get("s", i)), r"\s+")
    rows = blocks.select(fields(0).alias("r"), fields(1).alias("q"))
    seq: Column = F.replace(F.col("q")[5], F.lit("-"), F.lit(""))
    start = F.col("r")[1].cast("int")
    rows = rows.select(F.regexp_extract(F.col("q")[0], r"S(\d+)_\d+", 1).try_cast("int").alias("_number"), F.col("q")[0].alias("read"), start.alias("st"), (start + F.col("r")[2].cast("int")).alias("en"), F.col("q")[3].alias("strand"), seq.alias("seq"), F.col("q")[4].cast("int").alias("size"))
    rows = rows.join(segments, F.col("_number") == F.col("number")).where(~F.contains("seq", F.lit("NN")))
    broken = F.raise_error(F.concat(F.lit("length of read "), F.col("read"))).cast("string")
    own = F.when(F.length("seq") != F.col("size"), broken).when(F.col("strand") == "-", reverse_complement("seq")).otherwise(F.col("seq"))
    return rows.select(F.concat_ws("!", "read", "segm_name", "st", "en", "strand").alias("name"), own.alias("seq"))
