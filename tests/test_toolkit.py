import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sketchlark import toolkit  # noqa: F401
from sketchlark.operators import annotation, evaluation, formats, origin, sweeps, views
from sketchlark.params import Params
from sketchlark.sources import tables as text
from sketchlark.sources.fasta import read_long_fastq

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def lines(spark, *rows):
    return spark.createDataFrame([(r.replace("|", "\t"),) for r in rows], "value string")


def same(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, DATA)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    rounded = lambda v: round(v, 9) if isinstance(v, float) else str(v) if isinstance(v, list) else v
    table = lambda rows, at: sorted((tuple(rounded(r[a]) for a in at) for r in rows), key=repr)
    assert table(df.collect(), sorted(names)) == table(found.fetchall(), [names.index(n) for n in sorted(names)])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["map_with_second", "map_jaccard", "map_lcs", "paf_rows", "run_stats", "gff_transcripts", "gene_classes", "paired_vcf", "view_pairs", "promising_intervals", "origin_windows"])
def test_queries_against_their_sql(spark, name):
    same(spark, name)


def test_gff_and_bed(spark):
    rows = text.parse_gff(lines(spark, "#x", 'c|s|exon|11|20|.|+|.|transcript_id "a"; gene_id "g"; gene_name "n; m"; tag "basic"; tag "Ensembl_canonical";', "c|s|exon|31|40|.|+|.|ID=1;transcript_id=a;gbkey=mRNA", "c|s|CDS|15|35|.|+|0|transcript_id=a", "bad|row"))
    parts = annotation.transcript_parts(rows)
    got = annotation.transcripts_bed12(parts).collect()
    assert [tuple(r) for r in got] == [("c", 10, 40, "a||n; m", 1000, "+", 14, 35, "196,196,196", 2, "10,10,", "0,20,")]
    assert [tuple(r)[:3] for r in annotation.transcript_introns(parts).collect()] == [("c", 20, 30)]
    assert annotation.transcript_parts(rows, tag="Ensembl_canonical").count() == 1
    with pytest.raises(Exception, match="coding part"):
        annotation.transcripts_bed12(annotation.transcript_parts(text.parse_gff(lines(spark, "c|s|exon|11|20|.|+|.|transcript_id=a", "c|s|CDS|5|12|.|+|.|transcript_id=a")))).collect()
    with pytest.raises(Exception, match="transcript_id"):
        annotation.transcript_parts(text.parse_gff(lines(spark, "c|s|exon|11|20|.|+|.|ID=a"))).collect()
    bed = text.parse_bed(lines(spark, "c|1|9", "c|5|50|n|7|-|5|50|0|2|5,9,|0,36,", "track x"))
    assert [tuple(r) for r in text.bed_intervals(bed).orderBy("st", "en").collect()] == [("c", 1, 9, None), ("c", 5, 10, "n"), ("c", 41, 50, "n")]


def test_spliced_cigars_of_proteins():
    assert annotation.exons_of("5M10N4M") == ([(0, 5, 0, 0), (15, 19, 0, 0)], 19, False)
    assert annotation.exons_of("2M10U3M", protein=True) == ([(0, 7, 0, 0), (14, 25, 2, 0)], 25, False)
    assert annotation.exons_of("2M10V3M1F", protein=True) == ([(0, 8, 0, 0), (15, 26, 1, 1)], 26, True)


def test_paf_to_gff(spark):
    paf = formats.parse_paf(lines(spark, "q|20|1|9|-|s|500|100|125|20|24|60|AS:i:33|np:i:7|da:i:0|do:i:0|cg:Z:2M10U3M")).withColumn("aln_id", F.lit(1))
    got = [r.line.split("\t") for r in annotation.paf_gff(paf, protein=True).orderBy("n").collect()]
    assert [(r[2], int(r[3]), int(r[4]), r[7]) for r in got] == [("transcript", 98, 125, "."), ("stop_codon", 98, 100, "."), ("CDS", 101, 111, "2"), ("CDS", 119, 125, "0"), ("start_codon", 123, 125, ".")]
    assert got[0][8].endswith("identity=0.8333;positive=0.8750;aa_start=1;aa_end=11;dist_start_codon=0;dist_stop_codon=0")
    with pytest.raises(Exception, match="inconsistent"):
        annotation.paf_gff(paf.withColumn("T_r", F.lit(126)), protein=True).collect()


def test_verdicts_of_introns(spark):
    found = spark.createDataFrame([(1, "c", 10, 20), (2, "c", 11, 22), (3, "c", 40, 50), (4, "d", 1, 2)], "id int, chrom string, st int, en int")
    known = spark.createDataFrame([("c", 10, 20), ("c", 10, 20), ("c", 45, 60)], "chrom string, st int, en int")
    verdicts = {r.id: r.verdict for r in annotation.judged(found, known, 8).collect()}
    assert verdicts == {1: "C", 2: "P", 3: "P", 4: "N"}
    assert {r.id: r.verdict for r in annotation.judged(found, known, 8, tolerance=2).collect()}[2] == "C"
    assert tuple(annotation.verdict_counts(annotation.judged(found, known, 8)).first()) == (4, 1, 1, 25.0)
    alns = spark.createDataFrame([(1, "a", "c", True), (2, "a", "c", False), (3, "b", "*", True), (4, "d", "c", True)], "aln_id int, query_id string, segm_name string, is_primary boolean")
    assert tuple(annotation.read_counts(alns, alns.where("aln_id = 4")).first()) == (1, 2, 2, 1)


def test_genes_that_stay(spark):
    rows = [("a", 9, "s", 0, 10), ("b", 20, "s", 5, 30), ("c", 8, "s", 9, 12), ("d", 5, "s", 30, 40), ("e", 7, "t", 0, 50), ("f", 7, "t", 1, 90)]
    got = annotation.chosen_genes(spark.createDataFrame(rows, "query_id string, P_sz int, segm_name string, T_l int, T_r int")).collect()
    assert sorted(r.query_id for r in got) == ["b", "d", "e"]


def test_views():
    assert views.padded("=AC*ag+tt-c:2") == ("ACa--c==", "||    ||", "ACgtt-==")
    got = views.pair_lines(":3*ag+tt-cc:2", 100, 10, 18, "-", 5)
    assert got == ["Ref+:        101 ===a- 104       ", " " * 17 + "|||  ", "Qry-:         18 ===gt 14        ", "", "Ref+:        105 -cc== 108       ", " " * 17 + "   ||", "Qry-:         13 t--== 11        "]
    block = views.maf_lines({"cs": "=AC*ag", "query_id": "q", "segm_name": "seg", "strand": "-", "P_sz": 10, "P_start": 2, "P_end": 5, "T_l": 7, "T_r": 10, "segm_sz": 99, "score": None})
    assert block == ["a 0", "s seg          7          3 +         99 ACa", "s q            5          3 -         10 ACg", ""]


def test_paired_names_and_modes(spark):
    rows = [("r!s!1_200!101_300!+-/2", "s", "-", 200, 290, 10), ("r!s!1_200!101_300!+-/2", "s", "-", 0, 99, 30), ("x!s!0!100!+", "s", "+", 0, 100, 60), ("none", "s", "+", 0, 1, 5)]
    df = spark.createDataFrame(rows, "query_id string, segm_name string, strand string, T_l int, T_r int, mapq int")
    judged = {m: {r.query_id[0]: (r.wrong, r.mapq) for r in evaluation.judged_reads(df, mode=m, at="T_l").collect()} for m in ("longest", "first", "all")}
    assert judged == {"longest": {"r": (True, 30), "x": (False, 60)}, "first": {"r": (True, 30), "x": (False, 60)}, "all": {"r": (True, 30), "x": (False, 60)}}
    assert evaluation.error_rows(evaluation.judged_reads(df), 31).count() == 0


def test_simulated_pairs_that_do_not_match(spark):
    row = ("simulated.a", 0x40, "c", 5, "3M", "ACG", "xyz", 0, 0, 0)
    schema = "query_id string, flag int, segm_name string, pos int, cigar string, seq string, qual string, errors int, snps int, indels int"
    assert [r.name for r in evaluation.simulated_pairs(spark.createDataFrame([row], schema)).collect()] == ["a!c!5!8!+"]
    with pytest.raises(Exception, match="mates"):
        evaluation.simulated_pairs(spark.createDataFrame([row, row], schema)).collect()


def test_windows_over_hits_by_span():
    hits = [{"r": r, "h": h} for r, h in zip([0, 5, 9, 12, 15, 18, 21, 24, 500, 505], [1, 2, 3, 4, 5, 6, 7, 7, 1, 2])]
    best, second, quality = sweeps.swept(hits, 30, 8)
    assert best == (0, 24, 7, 7 / 9) and second[0] == 500 and quality == 60
    assert sweeps.swept([], 30, 8) == ((-1, -1, 0, 0.0),) * 2 + (0,)


def test_local_theta_and_buckets_that_reach_theta(spark):
    import numpy as np

    from sketchlark.operators import mapping
    from sketchlark.operators.sketch import sketch

    rng = np.random.default_rng(6)
    seq = "".join(rng.choice(list("ACGT"), 3000))
    p = Params(k=11, ratio=0.5, theta=0.5)
    segs = spark.createDataFrame([(0, "s", seq), (1, "t", seq[400:1000])], "segm_id int, segm_name string, seq string")
    reads = spark.createDataFrame([("a!s!500!900!+", seq[500:900]), ("b", "ACGT" * 20)], "query_id string, seq string")
    ref = sketch(segs, "segm_id", "seq", p.k, p.ratio)
    ordered, usable = mapping.seeded(sketch(reads, "query_id", "seq", p.k, p.ratio), ref, p)
    theta = {r.query_id[0]: r.theta for r in sweeps.local_theta(ordered, usable).collect()}
    assert theta["a"] == pytest.approx(0.99) and theta["b"] == -1.0
    sizes = reads.selectExpr("query_id", "length(seq) as P_sz")
    m = ordered.where("query_id like 'a%'").first().m
    origins = spark.createDataFrame([("a!s!500!900!+", m)], "query_id string, span int")
    got = sweeps.reaching_theta(origins, ordered, usable, sizes, 0.5).first()
    assert got.max_C == 1.0 and got.C_n >= 3 and {b.segm_id for b in got.C_buckets} == {0, 1} and got.J_n >= 2
    windows = origin.origin_windows(ordered, sizes, usable, segs.select("segm_id", "segm_name"))
    table = origin.origin_table(windows, ordered, reads, p.theta, sweeps.reaching_theta(origins, ordered, usable, sizes, 0.5))
    assert len(table.columns) == 23
    row = table.first()
    assert row.gt_C_r == 1.0 and row.gt_C_l_lmax == row.gt_C_l and row.P == seq[500:900] and row.C_list.startswith("{(0, ")
    tags = origin.origin_tags(table, mapping.map_seeds(ordered, usable, p)).first().tags
    assert "gt_segm:s:s\tgt_start_nucl:i:500\tgt_end_nucl:i:900" in tags and tags.count("\t") == 17


def test_long_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 some words\nACGT\nACG\n+r1\n@@@@\n+++\n\n@r2\n\n+\n\n@r3\nA\n+\n@\n")
    got = read_long_fastq(spark, str(tmp_path / "a.fq")).orderBy("rec_idx").collect()
    assert [(r.rec_idx, r.name, r.comment, r.seq, r.qual) for r in got] == [(0, "r1", "some words", "ACGTACG", "@@@@+++"), (1, "r2", None, "", ""), (2, "r3", None, "A", "@")]
    for bad in ("@r\nACGT\n+\nII", "ACGT\n", "@r\nAC\n+\nIII\n"):
        (tmp_path / "b.fq").write_text(bad)
        with pytest.raises(Exception, match="broken FASTQ"):
            read_long_fastq(spark, str(tmp_path / "b.fq")).collect()


def test_sam_lines_and_parameters(spark, tmp_path):
    rows = spark.createDataFrame([("r", "-", "s", 9, 60, "ACG", 1, "2=1X"), ("q", "+", "s", 0, 0, "A", None, None)], "query_id string, strand string, segm_name string, T_l int, mapq int, read string, distance int, cigar string")
    got = {r.query_id: r.line for r in formats.sam_lines(rows).collect()}
    assert got["r"].split("\t") == ["r", "16", "s", "10", "60", "2=1X", "*", "0", "0", "ACG", "*", "NM:i:1"] and got["q"].split("\t")[5] == "*"
    p = Params(reads_file="r.fa")
    p.write(spark, str(tmp_path / "p"))
    back = spark.read.csv(str(tmp_path / "p"), sep="\t", header=True).first()
    assert back.k == "15" and back.pFile == "r.fa" and len(back) == 17
    assert p.display().count("\n") == 11 and "               hFrac: 0.050000" in p.listing()
    with pytest.raises(ValueError):
        Params(abs_pos=True)


def test_dominance_and_maxima(spark):
    rows = [("q", 0, 10, 5.0, 3), ("q", 0, 12, 4.0, 3), ("q", 0, 13, 3.0, 3), ("q", 1, 12, 1.0, 3), ("q", 0, 10, 5.0, 3)]
    got = sweeps.dominant(spark.createDataFrame(rows, "query_id string, segm_id int, T_l int, score double, reach int"), "reach")
    assert sorted((r.segm_id, r.T_l, r.score) for r in got.collect()) == [(0, 10, 5.0), (1, 12, 1.0)]
    ranges = spark.createDataFrame([("c", 0, 10), ("c", 5, 8), ("c", 20, 30)], "chrom string, st int, en int")
    asked = spark.createDataFrame([("c", 0, 5, "a"), ("c", 4, 25, "b"), ("c", 11, 15, "d"), ("d", 0, 9, "e")], "chrom string, st int, en int, name string")
    assert {r.name: r.most for r in sweeps.range_maxima(ranges, asked, 7).collect()} == {"a": 1, "b": 2, "d": 0, "e": 0}


def test_maxima_of_rows_read_in_any_order(spark):
    def reordered(batches):
        for batch in batches:
            yield batch.take(pa.array(np.random.default_rng().permutation(batch.num_rows)))

    ranges = spark.createDataFrame([("c", 0, 10 * i + 5) for i in range(40)], "chrom string, st int, en int")
    asked = spark.range(40, numPartitions=1).selectExpr("'c' as chrom", "cast(10 * id as int) as st", "cast(10 * id + 3 as int) as en", "id as name")
    asked = asked.mapInArrow(reordered, asked.schema)
    assert {r.name: r.most for r in sweeps.range_maxima(ranges, asked, 7).collect()} == {i: 40 - i for i in range(40)}
