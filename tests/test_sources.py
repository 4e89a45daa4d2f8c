import gzip

import duckdb
import pytest
from pyspark.sql import functions as F

from sketchlark import catalog
from sketchlark.operators import evaluation
from sketchlark.operators.mapping import map_reads
from sketchlark.operators.sketch import sketch
from sketchlark.params import Params
from sketchlark.sources import fasta
from sketchlark.streaming.mapper import map_stream, stream_fasta

SMALL = "/root/testdata/sf0.001"


def test_fasta_in_small_splits(spark, tmp_path):
    want = [(f"s{i}", "about >this" if i % 3 == 0 else None, "ACGT" * (i % 7)) for i in range(200)]
    text = "".join(f">{n}{' ' + c if c else ''}\r\n" + "".join(s[j : j + 9] + "\n" for j in range(0, len(s), 9)) for n, c, s in want)
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write("junk\n>last x\nAC\nGT\n")
    (tmp_path / "c.fa").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        rows = fasta.read_fasta(spark, [str(tmp_path / n) for n in ("a.fa", "b.fa.gz", "c.fa")]).orderBy("rec_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.name, r.comment, r.seq) for r in rows] == [*want, ("last", "x", "ACGT")]
    fasta.write_fasta(spark.createDataFrame(want, "name string, comment string, seq string").coalesce(1), str(tmp_path / "out"))
    again = fasta.read_fasta(spark, str(tmp_path / "out")).orderBy("rec_idx").collect()
    assert [(r.name, r.seq) for r in again] == [(n, s) for n, _, s in want]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("".join(f"@r{i} c\nACG\n+\n@I{i % 10}\n" for i in range(50)))
    rows = fasta.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("rec_idx").collect()
    assert [(r.name, r.seq, r.qual) for r in rows] == [(f"r{i}", "ACG", f"@I{i % 10}") for i in range(50)]
    (tmp_path / "b.fq").write_text("@r\nACG\n+\nII")
    with pytest.raises(Exception, match="broken FASTQ record"):
        fasta.read_fastq(spark, str(tmp_path / "b.fq")).collect()


def test_stream_equals_batch(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    seq = "".join(rng.choice(list("ACGT"), 4000))
    p = Params(k=11, ratio=0.5, theta=0.5)
    ref = fasta.write_index(sketch(spark.createDataFrame([(0, seq)], "segm_id int, seq string"), "segm_id", "seq", p.k, p.ratio), str(tmp_path / "index"))
    (tmp_path / "in").mkdir()
    reads = [(f"r{i}", seq[i * 300 : i * 300 + 250]) for i in range(10)]
    for n, part in enumerate((reads[:4], reads[4:])):
        (tmp_path / "in" / f"{n}.fa").write_text("".join(f">{a}\n{b}\n" for a, b in part))
    run = map_stream(stream_fasta(spark, str(tmp_path / "in"), 1), ref, p, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
    assert run.awaitTermination(120)
    batch = map_reads(sketch(spark.createDataFrame(reads, "query_id string, seq string"), "query_id", "seq", p.k, p.ratio), ref, p)
    cols = ["query_id", "segm_id", "T_l", "T_r", "mapq"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()))
    assert len(got) == 10 and got == sorted(map(tuple, batch.select(*cols).collect()))


def test_lift_over_and_introns(spark):
    kinds = "aln_id int, query_id string, P_sz int, P_start int, P_end int, strand string, segm_name string, T_l int, T_r int, cigar string"
    alns = spark.createDataFrame([(1, "q", 100, 10, 40, "+", "t", 1000, 1035, "10M5D10M5I5M5D"), (2, "q", 100, 10, 40, "-", "u", 0, 30, "30M")], kinds)
    regions = spark.createDataFrame([("q", 12, 25), ("q", 0, 20), ("q", 32, 34), ("z", 0, 9)], "query_id string, st int, en int")
    got = {(r.aln_id, r.name): (r.st, r.en) for r in evaluation.lift_over(alns, regions).collect()}
    assert got == {(1, "q_12_25"): (1002, 1020), (1, "q_0_20_t5"): (1000, 1010), (1, "q_32_34"): (1025, 1026), (2, "q_12_25"): (15, 28), (2, "q_0_20_t3"): (20, 30), (2, "q_32_34"): (6, 8)}
    spliced = spark.createDataFrame([(1, 100, "10M50N5M2D3M20N4M")], "aln_id int, T_l int, cigar string")
    assert sorted((r.st, r.en) for r in evaluation.introns(spliced).collect()) == [(110, 160), (170, 190)]
    assert sorted((r.st, r.en) for r in evaluation.exon_blocks(spliced).collect()) == [(100, 110), (160, 170), (190, 194)]


def test_truth(spark):
    rows = [("a!s!0!100!+", "s", "+", 0, 100, 60), ("b!s!0!100!-", "s", "+", 0, 100, 60), ("c!s!0!100!+", "t", "+", 0, 100, 0), ("d", "s", "+", 0, 1, 0)]
    df = spark.createDataFrame(rows, "query_id string, segm_name string, strand string, T_l int, T_r int, mapq int")
    assert {r.query_id[0]: r.wrong for r in evaluation.against_truth(df).collect()} == {"a": False, "b": True, "c": True}


@pytest.mark.parametrize("name", ["pafcmp", "ov_eval", "bedcov", "vcfstat"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SMALL)
    want = con.execute(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(d[0] for d in want.description)
    at = {d[0]: i for i, d in enumerate(want.description)}
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*cols).collect()), key=key) == sorted((tuple(r[at[c]] for c in cols) for r in want.fetchall()), key=key)


def test_simulated_reads_map_home(spark):
    rows = catalog.mapeval_simulated(spark, SMALL).orderBy(F.desc("mapq")).collect()
    assert rows and rows[-1].total > 50 and rows[0].rate < 0.2
