"""Difference strings, variants, assembly measures and alignment formats on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from sketchlark.operators import assembly, formats, variants
from sketchlark.sources import alignments as A

PAF = "query_id string, P_sz int, P_start int, P_end int, strand string, segm_name string, T_l int, T_r int, blk_len int, mapq int, cs string, aln_id int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_difference_strings(spark):
    df = spark.createDataFrame([("=ACG*ag+tt-c=A",), (":3*ag",), (None,)], "cs string")
    assert df.select(variants.cs_sequence("cs", False).alias("t"), variants.cs_sequence("cs", True).alias("q")).collect()[:2] == [("ACGACA", "ACGGTTA"), (None, None)]


def test_calls_and_depth(spark):
    a = [("q1", 100, 0, 21, "+", "c", 10, 32, 60, 60, ":5*ag+t:5-cc:9", 1), ("q2", 50, 10, 18, "-", "c", 14, 22, 60, 60, ":4*ag:3", 2), ("q3", 50, 0, 5, "+", "c", 15, 17, 20, 60, ":2", 3)]
    df = spark.createDataFrame(a, PAF)
    found = variants.call_variants(df, 8, 50)
    got = rows(found.select("aln_id", "st", "en", "ref", "alt", "q_st", "q_en", "depth"))
    assert got == [(1, 15, 16, "a", "g", 5, 6, 3), (1, 16, 16, "-", "t", 6, 7, 3), (1, 21, 23, "cc", "-", 12, 12, 1), (2, 18, 19, "a", "g", 13, 14, 2)]
    assert rows(variants.called_regions(df, 8, 50)) == [("c", 10, 14), ("c", 22, 32)]
    assert rows(variants.vcf_lines(found, F.lit("t")).select("line")) == [("c\t21\t.\tTCC\tT\t60\t.\tQNAME=q1;QSTART=13;QSTRAND=+\tGT\t1/1",)]


def test_structural_variants(spark):
    schema = "chrom string, pos int, ref string, alts array<string>, info string"
    base = spark.createDataFrame([("1", 1000, "N", ["<INS>"], "SVLEN=100"), ("1", 9000, "N", ["<DEL>"], "END=9100;SVLEN=-100"), ("2", 50, "N", ["<INV>"], "SVLEN=900"), ("2", 90, "A", ["ACCC"], "")], schema)
    calls = spark.createDataFrame([("1", 1100, "N", ["<INS>"], "SVLEN=120"), ("1", 9000, "N", ["<INS>"], "SVLEN=90")], schema)
    assert rows(variants.compare_structural(base, calls)) == [("PC", 2, 1, 0.5), ("SN", 2, 1, 0.5)]
    assert variants.compare_structural(base.limit(0), calls.limit(0)).where("share is null").count() == 2
    assert variants.select_variants(base, 3, 10).count() == 1
    assert rows(base.select(*(v.alias(k) for k, v in variants.allele_lengths().items())))[-1] == (900, 900, 900)


def test_misjoins(spark):
    def aln(start, strand, segm="s", at=0):
        return ("q", 0, start, start + 10, strand, segm, at, at + 10, 10, 60, None, 0)

    turn = [aln(10 * i, s, at=10 * i) for i, s in enumerate("+-+-+-")]
    df = spark.createDataFrame([*turn, aln(60, "-", "t"), aln(70, "-", "t", 500)], PAF)
    got = assembly.misjoins(df, 5, 100)
    assert rows(got.select("P_start", "kind")) == [(10, "inversion"), (30, "inversion"), (50, "end"), (60, "segment"), (70, "gap")]
    marked = assembly.misjoins(df, 5, 100, spark.createDataFrame([("t", 0, 6)], "chrom string, st int, en int"), 50)
    assert rows(marked.where("in_region").select("P_start")) == [(60,), (70,)]
    assert assembly.misjoins(df.limit(0)).count() == 0


def test_alignment_and_assembly_stats(spark):
    schema = "query_id string, P_sz int, P_start int, P_end int, cigar string, nm int, nn int, is_primary boolean"
    df = spark.createDataFrame([("a", 100, 0, 60, "10M50I", 55, None, True), ("a", 100, 50, 80, "30M2D", 1, None, True), ("b", 9, 0, 5, None, None, None, False)], schema)
    got = assembly.alignment_stats(df).first()
    assert (got["primary"], got["secondary"], got["sequences"], got["bases"], got["covered"], got["substitutions"], got["ins_50"], got["del_0"]) == (2, 1, 1, 100, 80, 5, 1, 1)

    contigs = spark.createDataFrame([("a", 100), ("b", 60), ("c", 40)], "query_id string, P_sz int")
    blocks = spark.createDataFrame([("a", 0, 50, "+", "s", 0, 50, 0.0), ("a", 40, 90, "+", "s", 20040, 20090, None), ("a", 45, 80, "+", "s", 0, 35, 0.0), ("b", 0, 60, "-", "s", 30, 90, 0.0), ("c", 0, 40, "+", "s", 0, 40, 0.5)], "query_id string, P_start int, P_end int, strand string, segm_name string, T_l int, T_r int, diff double")
    got = assembly.assembly_stats(contigs, blocks, 200, 30).first()
    # blocks of 60, 50 and 40 (10 letters overlap); the contained one doesn't count, and 60 + 50 pass half of 200
    assert (got["length"], got["ng50"], got["ng75"], got["nga50"], got["breaks"], got["breaks_500"]) == (200, 60, 60, 50, 1, 0)
    assert (got["covered"], got["q_cov"], got["aunga"]) == (140, 75.0, (60 * 60 + 50 * 50 + 40 * 40) / 200)


def test_sam(spark):
    text = ["@SQ\tSN:c\tLN:50", "r\t16\tc\t11\t60\t2S4M1I3M2D2M\t*\t0\t0\tTTACGTAACGTT\t*\tNM:i:4\tMD:Z:2A4^GG2", "r\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*", "x\t0\tc\t49\t9\t5M\t*\t0\t0\tAAAAA\t*"]
    df = spark.createDataFrame([(t,) for t in text], "value string")
    got = A.sam_to_paf(df).collect()
    assert len(got) == 1 and tuple(got[0])[:12] == ("r", 12, 0, 10, "-", "c", 50, 10, 21, 8, 12, 60)
    assert got[0]["tags"] == {"tp": "P", "mm": "1", "gn": "3", "go": "2", "cg": "4M1I3M2D2M", "cs": ":2*AG:1+A:3-GG:2"}
    assert A.difference("ACGT", "4M", "3") is None


def test_delta_and_maf(spark, tmp_path):
    (tmp_path / "x.delta").write_text("a b\nNUCMER\n>ref q 100 80\n1 10 1 9 2 2 0\n3\n0\n20 30 40 30 1 1 0\n-2\n-1\n1\n1\n0\n")
    got = rows(A.read_delta(spark, str(tmp_path / "x.delta")).select("query_id", "P_start", "P_end", "strand", "T_l", "T_r", "n_match", "blk_len", F.col("tags.cg")))
    assert got == [("q", 0, 9, "+", 0, 10, 8, 10, "2M1D7M"), ("q", 29, 40, "-", 19, 30, 12, 13, "1M2I2D8M")]
    (tmp_path / "x.maf").write_text("a\ns ref 5 4 + 50 ACGT\ns S1_1 0 3 - 3 A-GT\n\na\ns ref 9 4 + 50 ACGT\ns S1_2 0 4 + 4 ANNT\n")
    names = spark.createDataFrame([(1, "chr1")], "number int, segm_name string")
    assert rows(A.read_simulated_maf(spark, str(tmp_path / "x.maf"), names)) == [("S1_1!chr1!5!9!-", "ACT")]


def test_tags_reach_calls(spark):
    line = "q\t100\t0\t9\t+\tc\t90\t10\t19\t9\t60\t60\t{}cs:Z::4*ag:4"
    df = spark.createDataFrame([(1, line.format("tp:A:P\t")), (2, line.format("tp:A:S\t")), (3, line.format("s1:i:4\t"))], "aln_id int, value string")
    parsed = formats.parse_paf(df).withColumn("aln_id", F.lit(1))
    assert variants.usable_alignments(parsed, 50).count() == 1
