"""Alignments as text to look at: pairs of padded lines, MAF blocks, and rows of moves."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchlark.operators.formats import cigar_ops

_STEP = re.compile(r"([:=*+-])(\d+|[A-Za-z]+)")


def padded(cs: str) -> tuple[str, str, str]:
    """(target, signs, query) of a difference string, gaps as -, equal letters of a short string as =; a sign | marks equal letters."""
    target, signs, query = [], [], []
    for kind, what in _STEP.findall(cs):
        if kind in ":=":
            what = "=" * int(what) if kind == ":" else what
            parts = what, "|" * len(what), what
        elif kind == "*":
            parts = what[0], " ", what[1]
        else:
            gap, blank = "-" * len(what), " " * len(what)
            parts = (gap, blank, what) if kind == "+" else (what, blank, gap)
        for out, p in zip((target, signs, query), parts):
            out.append(p)
    return "".join(target), "".join(signs), "".join(query)


def pair_lines(cs: str, t_start: int, q_start: int, q_end: int, strand: str, width: int = 80) -> list[str]:
    """Blocks of ``width`` columns: the target with its first and last position (from 1), the signs, and the query.

    On strand - the query's positions fall from its end. A block without letters of a side shows the place before it.
    """
    target, signs, query = padded(cs)
    out: list[str] = []
    t, q = t_start, 0
    for at in range(0, len(target), width):
        a, s, b = (x[at : at + width] for x in (target, signs, query))
        n_t, n_q = len(a) - a.count("-"), len(b) - b.count("-")
        first, last = (q_start + q + 1, q_start + q + n_q) if strand == "+" else (q_end - q, q_end - q - n_q + 1)
        out += [*([""] if out else []), f"Ref+: {t + 1:>10} {a} {t + n_t:<10}", f"{'':17}{s}", f"Qry{strand}: {first:>10} {b} {last:<10}"]
        t, q = t + n_t, q + n_q
    return out


def maf_lines(r: dict) -> list[str]:
    """A MAF block of a PAF row with a long difference string."""
    target, _, query = padded(r["cs"])
    wide = max(len(r["query_id"]), len(r["segm_name"]))
    start = r["P_start"] if r["strand"] == "+" else r["P_sz"] - r["P_end"]
    row = lambda name, at, n, strand, size, text: f"s {name:<{wide}} {at:>10} {n:>10} {strand} {size:>10} {text}"
    return [f"a {r['score'] or 0}", row(r["segm_name"], r["T_l"], r["T_r"] - r["T_l"], "+", r["segm_sz"], target), row(r["query_id"], start, r["P_end"] - r["P_start"], r["strand"], r["P_sz"], query), ""]


def _summary(cs: str) -> str:
    steps = _STEP.findall(cs)
    many = lambda kind: [len(w) for k, w in steps if k == kind]
    return f"mm:i:{len(many('*'))}\toi:i:{len(many('+'))}\tei:i:{sum(many('+'))}\tod:i:{len(many('-'))}\ted:i:{sum(many('-'))}"


def view(rows: DataFrame, style: str = "aln", width: int = 80, key: str = "aln_id") -> DataFrame:
    """(key, n, line): the lines of each PAF row (key, the columns of ``parse_paf``) in style aln, maf or moves.

    aln: a summary after >, padded pairs in blocks of ``width`` (0: one block), and // at the end; maf: blocks, needs long
    difference strings; moves: one line of intervals and CIGAR moves. Rows without the tag that a style needs are left out.
    """
    if style not in ("aln", "maf", "moves"):
        raise ValueError("style must be aln, maf or moves")
    score = F.col("tags")["AS"]
    if style == "moves":
        moves = F.array_join(F.transform(cigar_ops(F.col("tags")["cg"]), lambda x: F.concat_ws(" ", x.op, x.n.cast("string"))), " ")
        fixed = [F.lit("cigar:"), "query_id", "P_start", "P_end", "strand", "segm_name", "T_l", "T_r", F.lit("+"), F.coalesce(score, F.lit("0")), moves]
        return rows.where(F.col("tags")["cg"].isNotNull()).select(key, F.lit(0).alias("n"), F.concat_ws(" ", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in fixed)).alias("line"))
    names = ["query_id", "P_sz", "P_start", "P_end", "strand", "segm_name", "segm_sz", "T_l", "T_r", "n_match", "blk_len", "mapq"]
    rows = rows.where(F.col("tags")["cs"].isNotNull()).select(key, *names, F.col("tags")["cs"].alias("cs"), score.alias("score"))

    def lines(r: dict) -> list[str]:
        if style == "maf":
            if ":" in r["cs"]:
                raise ValueError("MAF needs long difference strings")
            return maf_lines(r)
        head = "\t".join(str(r[n]) for n in names)
        return [f">{head}\t{_summary(r['cs'])}", *pair_lines(r["cs"], r["T_l"], r["P_start"], r["P_end"], r["strand"], width or 1 << 31), "//"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, n, line) for i, r in enumerate(batch.to_pylist()) for n, line in enumerate(lines(r))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([m[0] for m in made], pa.int64())), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.string())], [key, "n", "line"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n int, line string")
