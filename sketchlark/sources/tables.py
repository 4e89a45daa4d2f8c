"""Tab-separated annotation text: BED, GTF and GFF3, VCF, and tables of names and lengths. All work on lines (value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value): the lines of text files, gzipped ones included, read in splits."""
    return spark.read.text(paths)


def _fields(lines: DataFrame, comment: str = "#") -> DataFrame:
    return lines.where(~F.startswith("value", F.lit(comment)) & (F.trim("value") != "")).select(F.split("value", "\t").alias("t"))


def _number(i: int) -> Column:
    return F.get("t", F.lit(i)).try_cast("bigint")


def parse_lengths(lines: DataFrame) -> DataFrame:
    """(name, length): the first two columns of an index or length table; rows without a length are left out."""
    return _fields(lines).select(F.get("t", F.lit(0)).alias("name"), _number(1).alias("length")).where("length is not null")


def parse_bed(lines: DataFrame) -> DataFrame:
    """(chrom, st, en, name, score, strand, thick_st, thick_en, color, n_blocks, sizes, starts): BED of three columns or more.

    What a row hasn't is null; track lines and rows without positions are left out.
    """
    texts = {3: "name", 5: "strand", 8: "color", 10: "sizes", 11: "starts"}
    numbers = {1: "st", 2: "en", 4: "score", 6: "thick_st", 7: "thick_en", 9: "n_blocks"}
    columns = {i: F.get("t", F.lit(i)).alias(n) for i, n in texts.items()} | {i: _number(i).alias(n) for i, n in numbers.items()}
    return _fields(lines).select(F.get("t", F.lit(0)).alias("chrom"), *(columns[i] for i in sorted(columns))).where("st is not null and en is not null")


def bed_intervals(rows: DataFrame) -> DataFrame:
    """(chrom, st, en, name): the blocks of rows that have some (see ``parse_bed``), and other rows whole."""
    ints = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("bigint"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("at"), (F.col("en") - F.col("st")).alias("n")))
    parts = F.zip_with(ints("starts"), ints("sizes"), lambda a, n: F.struct(a.alias("at"), n.alias("n")))
    blocks = F.explode(F.when(F.col("n_blocks").isNotNull() & F.col("starts").isNotNull() & F.col("sizes").isNotNull(), parts).otherwise(whole))
    return rows.select("chrom", "st", "name", blocks.alias("z")).select("chrom", (F.col("st") + F.col("z.at")).alias("st"), (F.col("st") + F.col("z.at") + F.col("z.n")).alias("en"), "name")


def parse_gff(lines: DataFrame) -> DataFrame:
    """(chrom, source, feature, st, en, score, strand, phase, attrs): GTF or GFF3 rows, st from 0; attrs are (key, value) in order."""
    pattern = r'(\w+)(?: "([^"]*)"|=([^;]*))'
    pair = lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("key"), F.concat(F.regexp_extract(x, pattern, 2), F.regexp_extract(x, pattern, 3)).alias("value"))
    attrs = F.transform(F.regexp_extract_all(F.get("t", F.lit(8)), F.lit(pattern), 0), pair)
    text = lambda i, n: F.get("t", F.lit(i)).alias(n)
    rows = _fields(lines).select(text(0, "chrom"), text(1, "source"), text(2, "feature"), (_number(3) - 1).alias("st"), _number(4).alias("en"), text(5, "score"), text(6, "strand"), text(7, "phase"), attrs.alias("attrs"))
    return rows.where("st is not null and en is not null")


def attribute(*names: str) -> Column:
    """The value of the last attribute with one of the names, or null."""
    return F.get(F.reverse(F.filter("attrs", lambda a: a.key.isin(*names))), F.lit(0))["value"]


def parse_vcf(lines: DataFrame) -> DataFrame:
    """(chrom, pos, id, ref, alts, qual, filter, info, format, samples): VCF rows; alts and samples are arrays."""
    text = lambda i, n: F.get("t", F.lit(i)).alias(n)
    samples = F.when(F.size("t") > 9, F.slice("t", 10, F.greatest(F.size("t") - 9, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return _fields(lines).select(text(0, "chrom"), _number(1).alias("pos"), text(2, "id"), text(3, "ref"), F.split(F.get("t", F.lit(4)), ",").alias("alts"), text(5, "qual"), text(6, "filter"), text(7, "info"), text(8, "format"), samples.alias("samples")).where("pos is not null")


def vcf_lengths(rows: DataFrame) -> DataFrame:
    """``rows`` with ``change``: for each allele its letters less the reference's, or for symbolic ones SVLEN, else END less pos.

    An SVLEN without a sign takes that of the allele's kind: deletions are negative.
    """
    number = lambda key: F.regexp_extract("info", rf"(?:^|;){key}=(-?\d+)", 1).try_cast("bigint")
    size = F.coalesce(number("SVLEN"), number("END") - F.col("pos"))
    change = F.transform("alts", lambda a: F.when(F.startswith(a, F.lit("<")), F.when(F.startswith(a, F.lit("<DEL")), -F.abs(size)).otherwise(size)).otherwise(F.length(a) - F.length("ref")).cast("bigint"))
    return rows.withColumn("change", change)
