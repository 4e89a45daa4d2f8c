"""Transcripts and genes: BED and GFF rows, and predicted introns and exons against an annotation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchlark.operators.evaluation import exon_blocks
from sketchlark.operators.intervals import overlap_join, sensitivity
from sketchlark.sources.tables import attribute

#: Colours of transcript types.
COLORS = {"protein_coding": "0,128,255", "mRNA": "0,128,255", "lincRNA": "0,192,0", "snRNA": "0,192,0", "miRNA": "0,192,0", "misc_RNA": "0,192,0"}
OTHER_COLOR = "196,196,196"


def transcript_parts(features: DataFrame, tag: str | None = None) -> DataFrame:
    """(id, type, gene, transcript, chrom, strand, feature, st, en): the exon and CDS rows of ``parse_gff`` with their transcript.

    The type is transcript_type, or else the biotype; missing names are N/A. With ``tag`` only rows with that tag. Rows
    without a transcript_id raise an error.
    """
    rows = features.where("feature in ('exon', 'CDS')")
    if tag is not None:
        rows = rows.where(F.exists("attrs", lambda a: (a.key == "tag") & (a.value == tag)))
    known = F.coalesce(attribute("transcript_id"), F.raise_error(F.concat(F.lit("no transcript_id at "), "chrom", F.lit(":"), F.col("st").cast("string"))).cast("string"))
    kind = F.coalesce(F.nullif(attribute("transcript_type"), F.lit("")), attribute("transcript_biotype", "gbkey"), F.lit(""))
    return rows.select(known.alias("id"), kind.alias("type"), F.coalesce(attribute("gene_name", "gene_id"), F.lit("N/A")).alias("gene"), F.coalesce(attribute("transcript_name"), F.lit("N/A")).alias("transcript"), "chrom", "strand", "feature", "st", "en")


def _label(short: bool) -> Column:
    return F.concat_ws("|", "transcript", "type") if short else F.concat_ws("|", "id", "type", "gene")


def transcripts_bed12(parts: DataFrame, short: bool = False) -> DataFrame:
    """A BED12 row (chrom, st, en, name, score, strand, thick_st, thick_en, color, n_blocks, sizes, starts) for each transcript with exons.

    Names, chrom and strand are those of its first exon by place. The thick part spans its CDS, or all without one; one
    that reaches out of the exons raises an error.
    """
    exon = F.col("feature") == "exon"
    first = F.min_by(F.struct("chrom", "strand", "type", "gene", "transcript"), F.when(exon, F.struct("st", "en")))
    rows = parts.groupBy("id").agg(first.alias("f"), F.sort_array(F.collect_list(F.when(exon, F.struct("st", "en")))).alias("x"), F.min(F.when(~exon, F.col("st"))).alias("c0"), F.max(F.when(~exon, F.col("en"))).alias("c1"))
    rows = rows.where(F.size("x") > 0).select("id", "f.*", "x", F.col("x")[0].st.alias("st"), F.array_max(F.transform("x", lambda e: e.en)).alias("en"), "c0", "c1")
    out_of = (F.col("c0") < F.col("st")) | (F.col("c1") > F.col("en"))
    thick = lambda c, whole: F.when(out_of, F.raise_error(F.concat(F.lit("coding part outside of transcript "), "id")).cast("bigint")).otherwise(F.coalesce(c, whole))
    listed = lambda f: F.concat(F.array_join(F.transform("x", f), ","), F.lit(","))
    color = F.coalesce(F.create_map(*(F.lit(x) for kv in COLORS.items() for x in kv))[F.col("type")], F.lit(OTHER_COLOR))
    return rows.select("chrom", "st", "en", _label(short).alias("name"), F.lit(1000).alias("score"), "strand", thick("c0", F.col("st")).alias("thick_st"), thick("c1", F.col("en")).alias("thick_en"), color.alias("color"), F.size("x").alias("n_blocks"), listed(lambda e: (e.en - e.st).cast("string")).alias("sizes"), listed(lambda e: (e.st - F.col("st")).cast("string")).alias("starts"))


def transcript_introns(parts: DataFrame, short: bool = False) -> DataFrame:
    """(chrom, st, en, name, score, strand) of the space between each two neighbouring exons of a transcript."""
    order = Window.partitionBy("id").orderBy("st", "en")
    rows = parts.where("feature = 'exon'").withColumns({"_name": _label(short), "_en": F.lag("en").over(order)})
    return rows.where("_en is not null").select("chrom", F.col("_en").alias("st"), F.col("st").alias("en"), F.col("_name").alias("name"), F.lit(1000).alias("score"), "strand")


def genes_bed(features: DataFrame) -> DataFrame:
    """(chrom, st, en, name, score, strand) of the gene rows of ``parse_gff``, named id|type|name."""
    id_, kind = F.coalesce(attribute("source_gene"), attribute("gene_id"), F.lit("")), F.coalesce(F.nullif(attribute("gene_type"), F.lit("")), attribute("gene_biotype"), F.lit(""))
    name = F.concat_ws("|", id_, kind, F.coalesce(attribute("gene_name"), F.lit("N/A")))
    return features.where("feature = 'gene'").select("chrom", "st", "en", name.alias("name"), F.lit(1000).alias("score"), "strand")


def accession_of(name: Column) -> Column:
    """The accession that a browser's name of a scaffold is made of: no prefix or class, and ``v1`` as ``.1``."""
    classed = F.rlike(name, F.lit("_(random|alt|decoy)$"))
    bare = F.when(classed, F.regexp_replace(F.regexp_replace(name, "_(random|alt|decoy)$", ""), r"^chr\S+_", "")).otherwise(F.regexp_replace(name, "^chrUn_", ""))
    return F.regexp_replace(bare, r"v(\d+)", ".$1")


def renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with the browser's names (name) for chroms that are accessions; unknown accessions become chrUn_ names."""
    known = names.select(F.col("name").alias("_to"), accession_of(F.col("name")).alias("_from")).where("_to <> _from").groupBy("_from").agg(F.max("_to").alias("_to"))
    unknown = F.when(F.rlike("chrom", F.lit(r"^[A-Z]+\d+\.\d+$")), F.regexp_replace("chrom", r"^([A-Z]+\d+)\.(\d+)$", "chrUn_$1v$2")).otherwise(F.col("chrom"))
    return rows.join(known, F.col("chrom") == F.col("_from"), "left").withColumn("chrom", F.coalesce("_to", unknown)).drop("_from", "_to")


def spliced_bed12(alignments: DataFrame, key: str = "aln_id", keep_secondary: bool = False) -> DataFrame:
    """BED12 rows of spliced alignments (key, query_id, segm_name, T_l, strand, score, is_primary, cigar), a block per exon.

    Secondary alignments are left out unless asked for, and coloured apart.
    """
    rows = alignments if keep_secondary else alignments.where("is_primary")
    x = exon_blocks(rows, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("st", "en"))).alias("x"), F.max("en").alias("en"))
    listed = lambda f: F.concat(F.array_join(F.transform("x", f), ","), F.lit(","))
    out = rows.join(x, key)
    color = F.when(F.col("is_primary"), COLORS["mRNA"]).otherwise(OTHER_COLOR)
    return out.select(F.col("segm_name").alias("chrom"), F.col("T_l").alias("st"), "en", F.col("query_id").alias("name"), "score", "strand", F.col("T_l").alias("thick_st"), F.col("en").alias("thick_en"), color.alias("color"), F.size("x").alias("n_blocks"), listed(lambda e: (e.en - e.st).cast("string")).alias("sizes"), listed(lambda e: (e.st - F.col("T_l")).cast("string")).alias("starts"))


def judged(found: DataFrame, annotated: DataFrame, width: int, tolerance: int = 0) -> DataFrame:
    """``found`` (key, chrom, st, en, ...) with ``verdict``: C where an annotated interval (chrom, st, en) that it meets has both
    ends within ``tolerance`` of its own, P where it only meets some, N where it meets none; and ``met``, those it meets.

    Intervals meet if they share a position. Annotated intervals count once however often they are listed.
    """
    own = found.withColumn("_id", F.struct("chrom", "st", "en"))
    spans = own.select("chrom", "st", "en").distinct()
    near = (F.abs(F.col("st") - F.col("st_b")) <= tolerance) & (F.abs(F.col("en") - F.col("en_b")) <= tolerance)
    pairs = overlap_join(spans, annotated.select("chrom", "st", "en").distinct(), width)
    told = pairs.groupBy(F.struct("chrom", "st", "en").alias("_of")).agg(F.max(near).alias("_hit"), F.sort_array(F.collect_list(F.struct(F.col("st_b").alias("st"), F.col("en_b").alias("en")))).alias("met"))
    out = own.join(told, F.col("_id") == F.col("_of"), "left")
    return out.withColumn("verdict", F.when(F.col("_hit"), "C").when(F.col("_of").isNotNull(), "P").otherwise("N")).drop("_id", "_of", "_hit")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """One row (predicted, apart, correct, correct_pc) over the verdicts of ``judged``."""
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    return verdicts.agg(F.count("*").alias("predicted"), count("N").alias("apart"), count("C").alias("correct")).withColumn("correct_pc", F.round(100 * F.try_divide(F.col("correct").cast("double"), "predicted"), 2))


def read_counts(alignments: DataFrame, introns_of: DataFrame, key: str = "aln_id") -> DataFrame:
    """One row (unmapped, mapped, primary, singletons): alignments (key, query_id, segm_name, is_primary); segm_name is null or * if unmapped."""
    rows = alignments.where("is_primary").join(introns_of.select(key).distinct().withColumn("_spliced", F.lit(True)), key, "left")
    lost = F.col("segm_name").isNull() | (F.col("segm_name") == "*")
    return rows.agg(F.count(F.when(lost, 1)).alias("unmapped"), F.count_distinct(F.when(~lost, F.col("query_id"))).alias("mapped"), F.count(F.when(~lost, 1)).alias("primary"), F.count(F.when(~lost & F.col("_spliced").isNull(), 1)).alias("singletons"))


def base_accuracy(found: DataFrame, annotated: DataFrame, width: int) -> DataFrame:
    """(shared, found, wanted, sn, sp) in bases between predicted and annotated exons on the chroms that are annotated."""
    return sensitivity(found.join(annotated.select("chrom").distinct(), "chrom", "left_semi"), annotated, width)


_MOVE = re.compile(r"(\d+)([A-Z=])")


def exons_of(cigar: str, protein: bool = False) -> tuple[list[tuple[int, int, int, int]], int, bool]:
    """((start, end, phase, frameshift) of each exon, letters on the target, whether it has a frameshift) of a spliced CIGAR.

    M, D, = and X cover the target, three letters each for a ``protein``. F, G and R are frameshifts. N parts exons
    between codons; U and V within one, after its first or second letter, and the exons' ends move accordingly.
    """
    out, start, at, phase, shift, broken = [], 0, 0, 0, 0, False
    for n, op in ((int(n), op) for n, op in _MOVE.findall(cigar)):
        if op in "MD=X":
            at += 3 * n if protein else n
        elif op in "FGR":
            at, shift, broken = at + n, 1, True
        elif op in "NUV":
            before, after = {"N": (0, 0), "U": (1, 2), "V": (2, 1)}[op]
            out.append((start, at + before, phase, shift))
            at += n
            start, phase, shift = at - after, after, 0
    out.append((start, at, phase, shift))
    return out, at, broken


def paf_gff(rows: DataFrame, protein: bool = False, key: str = "aln_id") -> DataFrame:
    """(key, n, line): GFF3 rows of spliced PAF rows (key, the columns of ``parse_paf``), the transcript first.

    Needs the tags cg and AS; np, da and do (positives, distances of the start and stop codon) are used if there. Parts
    are CDS, or exons of a pseudogene where the alignment has a frameshift. A query's alignments are numbered by key.
    A CIGAR that doesn't cover the target's interval raises an error.
    """
    number = F.row_number().over(Window.partitionBy("query_id").orderBy(key))
    names = [key, "query_id", "P_sz", "P_start", "P_end", "strand", "segm_name", "T_l", "T_r", "n_match", "blk_len"]
    tag = lambda t: F.col("tags")[t]
    plain = rows.where("segm_name <> '*'").select(*names, number.alias("hit"), tag("cg").alias("cigar"), tag("AS").alias("score"), tag("np").alias("np"), tag("da").cast("int").alias("da"), tag("do").cast("int").alias("do"))

    def lines(r: dict) -> Iterator[str]:
        if r["cigar"] is None or r["score"] is None:
            raise ValueError("the tags cg and AS are needed")
        parts, length, broken = exons_of(r["cigar"], protein)
        if length != r["T_r"] - r["T_l"]:
            raise ValueError("inconsistent cigar")
        name = f"transcript_id={r['query_id']}#{r['hit']};transcript_type={'pseudogene' if broken else 'protein_coding'}"
        facts = [f"identity={r['n_match'] / r['blk_len']:.4f}", *([f"positive={int(r['np']) * 3 / r['blk_len']:.4f}"] if r["np"] else []), f"aa_start={r['P_start']}", f"aa_end={r['P_sz'] - r['P_end']}"]
        facts += [f"dist_{what}_codon={d}" for what, d in (("start", r["da"]), ("stop", r["do"])) if d is not None and d >= 0]
        low, high = r["T_l"], r["T_r"]
        if r["do"] == 0:
            low, high = (low - 3, high) if r["strand"] == "-" else (low, high + 3)
        row = lambda what, a, b, score, phase, rest: "\t".join(map(str, (r["segm_name"], "paf2gff", what, a + 1, b, score, r["strand"], phase, rest)))
        yield row("transcript", low, high, r["score"], ".", f"{name};{';'.join(facts)}")
        whole = [("exon" if broken else "CDS", *p) for p in parts]
        whole = [("start_codon", 0, 3, ".", 0)] * (r["da"] == 0) + whole + [("stop_codon", length, length + 3, ".", 0)] * (r["do"] == 0)
        if protein and r["strand"] == "-":
            whole = [(what, length - b, length - a, phase, shift) for what, a, b, phase, shift in reversed(whole)]
        for what, a, b, phase, shift in whole:
            yield row(what, r["T_l"] + a, r["T_l"] + b, 0, phase, f"{name};frameshift={shift}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, n, line) for i, r in enumerate(batch.to_pylist()) for n, line in enumerate(lines(r))]
            take = pa.array([m[0] for m in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.string())], [key, "n", "line"])

    return plain.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n int, line string")


def gene_completeness(alignments: DataFrame, min_cov: float = 0.99, min_iden: float = 0.99, leave_out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(per gene, counts) of genes' spliced alignments (assembly, query_id, P_sz, P_start, P_end, n_match, blk_len, segm_name, T_l, T_r, at).

    assembly 0 is the reference, whose last alignment by ``at`` places a gene. Alignments of less identity are left out.
    An alignment of min_cov of a gene is a full copy. Of reference genes that overlap on a segment, each run keeps the
    longest, as far as the kept one reaches. Genes with one full copy on the reference are, for each assembly, full_sgl or
    full_dup by their full copies there, else frag, part50, part10 or missing by the covered share; genes with several
    are dup_cnt where they have several too, and dup_sum counts their full copies. ``leave_out`` is a pattern of segments
    whose genes don't count.
    """
    good = alignments.where(F.col("n_match") >= min_iden * F.col("blk_len"))
    order = Window.partitionBy("assembly", "query_id").orderBy("P_start", "P_end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("P_end").over(order), F.lit(0))
    new = F.greatest(F.col("P_end") - F.greatest("P_start", reach), F.lit(0))
    full = F.count(F.when(F.col("P_end") - F.col("P_start") >= min_cov * F.col("P_sz"), 1))
    seen = good.withColumn("_new", new).groupBy("assembly", "query_id").agg(full.alias("copies"), F.try_divide(F.sum("_new").cast("double"), F.max("P_sz")).alias("covered"))
    any_ = alignments.select("assembly", "query_id").distinct().join(seen, ["assembly", "query_id"], "left").withColumns({"copies": F.coalesce("copies", F.lit(0)), "covered": F.coalesce("covered", F.lit(0.0))})
    base = alignments.where("assembly = 0").groupBy("query_id").agg(F.max_by(F.struct("P_sz", "segm_name", "T_l", "T_r"), "at").alias("p")).select("query_id", "p.*")
    places = chosen_genes(base)
    if leave_out is not None:
        places = places.where(~F.rlike("segm_name", F.lit(leave_out)))
    copies = any_.where("assembly = 0 and copies > 0").select("query_id", F.col("copies").alias("on_reference"))
    last = alignments.agg(F.max("assembly")).first()[0] or 0
    genes = places.select("query_id").join(copies, "query_id").withColumn("assembly", F.explode(F.sequence(F.lit(0), F.lit(last))))
    rows = genes.join(any_, ["assembly", "query_id"], "left")
    n, share = F.col("copies"), F.col("covered")
    single = F.when(n.isNull(), "missing").when(n == 1, "full_sgl").when(n > 1, "full_dup").when(share >= min_cov, "frag").when(share >= 0.5, "part50").when(share >= 0.1, "part10").otherwise("missing")
    rows = rows.withColumn("verdict", F.when(F.col("on_reference") == 1, single).when(n > 1, "dup"))
    kinds = ("full_sgl", "full_dup", "frag", "part50", "part10", "missing", "dup")
    counts = rows.groupBy("assembly").agg(*(F.count(F.when(F.col("verdict") == k, 1)).alias(k if k != "dup" else "dup_cnt") for k in kinds), F.coalesce(F.sum(F.when(F.col("on_reference") > 1, n)), F.lit(0)).alias("dup_sum"))
    return rows.select("assembly", "query_id", "on_reference", "copies", "covered", "verdict"), counts


def chosen_genes(places: DataFrame) -> DataFrame:
    """Of genes (query_id, P_sz, segm_name, T_l, T_r) on a segment, by T_l: one stays until the next starts beyond its end; a
    longer one that starts before takes its place. A segment's genes are swept in one pass; they are places, not texts.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = schema = None
        for batch in batches:
            out: list[dict] = []
            schema = batch.schema
            for r in batch.to_pylist():
                if kept is not None and (r["segm_name"] != kept["segm_name"] or r["T_l"] >= kept["T_r"]):
                    out.append(kept)
                    kept = None
                if kept is None or r["P_sz"] > kept["P_sz"]:
                    kept = r
            yield pa.RecordBatch.from_pylist(out, schema)
        if kept is not None:
            yield pa.RecordBatch.from_pylist([kept], schema)

    rows = places.select("query_id", "P_sz", "segm_name", "T_l", "T_r")
    return rows.repartition("segm_name").sortWithinPartitions("segm_name", "T_l", "T_r", "query_id").mapInArrow(sweep, rows.schema)


#: The parts of chromosome X that pair with Y, by genome version.
PAIRED = {"37": [(0, 2699520), (154931043, 155260560)]}


def paired_genotypes(rows: DataFrame, male: bool = False, version: str | None = None) -> DataFrame:
    """(chrom, pos, id, ref, alts, qual, filter, info, format, genotype): two haploid call sets (``parse_vcf``, two samples) as one diploid.

    A sample's genotype a/a gives a; a/b is left open with filter HET1 or HET2, an uncalled one with GAP1 or GAP2. Depths
    are summed up. Other chromosomes than numbers, X and, for a male, Y are left out. Where a male has one copy, the
    other haplotype's gap alone is no reason for a filter.
    """
    if male and version not in PAIRED:
        raise ValueError(f"for a male the version must be one of {sorted(PAIRED)}")
    rows = rows.where(F.rlike("chrom", F.lit(r"^(chr)?([0-9]+|X|Y)$" if male else r"^(chr)?([0-9]+|X)$")))
    pattern = r"^(\.|[0-9]+)/(\.|[0-9]+):(\S+)"

    def part(i: int, g: int) -> Column:
        s = F.get("samples", F.lit(i))
        return F.when(F.rlike(s, F.lit(pattern)), F.regexp_extract(s, pattern, g)).otherwise(F.raise_error(F.concat(F.lit("malformed genotype at "), "chrom", F.lit(":"), F.col("pos").cast("string"))).cast("string"))

    gap = [part(i, 1) == "." for i in (0, 1)]
    het = [~gap[i] & (part(i, 1) != part(i, 2)) for i in (0, 1)]
    called = [F.when(gap[i] | het[i], ".").otherwise(part(i, 1)) for i in (0, 1)]
    reasons = F.array_compact(F.array(*(F.when(gap[i], f"GAP{i + 1}").when(het[i], f"HET{i + 1}") for i in (0, 1))))
    haploid = F.lit(0)
    if male:
        inside = F.lit(False)
        for a, b in PAIRED[version]:
            inside = inside | ((F.col("pos") >= a) & (F.col("pos") + F.length("ref") <= b))
        haploid = F.when(F.rlike("chrom", F.lit("^(chr)?X$")), F.when(inside, 0).otherwise(2)).when(F.rlike("chrom", F.lit("^(chr)?Y$")), 1).otherwise(0)
    other = ((haploid == 2) & (F.get("_r", F.lit(0)) == "GAP1")) | ((haploid == 1) & (F.get("_r", F.lit(0)) == "GAP2"))
    depths = F.array_join(F.transform(F.zip_with(F.split(part(0, 3), ","), F.split(part(1, 3), ","), lambda a, b: F.coalesce(a.try_cast("int"), F.lit(0)) + F.coalesce(b.try_cast("int"), F.lit(0))), lambda x: x.cast("string")), ",")
    out = rows.withColumn("_r", reasons)
    out = out.withColumn("_f", F.when((F.size("_r") == 0) | ((F.size("_r") == 1) & other), ".").otherwise(F.array_join("_r", ";")))
    return out.select("chrom", "pos", "id", "ref", "alts", F.lit(30).alias("qual"), F.col("_f").alias("filter"), "info", "format", F.concat(called[0], F.lit("|"), called[1], F.lit(":"), depths).alias("genotype"))
