"""FASTA and FASTQ files, plain or gzipped, and tab-separated tables of sequences.

Plain files are read in splits by Spark's text source, whose record separator is set to the start of a header; no file
has to fit into one task, but each record has to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _header(line: Column) -> tuple[Column, Column]:
    """Name and comment: the first word of a header, and what follows it (null if nothing)."""
    line = F.regexp_replace(line, r"\s+$", "")
    rest = F.regexp_replace(line, r"^\S*\s*", "")
    return F.regexp_extract(line, r"^(\S*)", 1), F.when(rest != "", rest)


def _numbered(rows: DataFrame, per_file: bool) -> DataFrame:
    """``rows`` (value, file, block) with ``at``: their place in the order of files, or within their file.

    Rows of a split have consecutive generated ids, so a table with one row per split gives the places; texts are not sorted.
    """
    marked = rows.withColumn("_id", F.monotonically_increasing_id())
    splits = marked.groupBy("file", "block").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"))
    order = Window.partitionBy("file").orderBy("block") if per_file else Window.orderBy("file", "block")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = marked.join(splits.withColumn("_before", before).drop("_n"), ["file", "block"])
    return out.withColumn("at", F.col("_before") + F.col("_id") - F.col("_low")).withColumn("first", (F.col("block") == 0) & (F.col("_id") == F.col("_low"))).drop("_before", "_id", "_low")


def _text(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    rows = spark.read.option("lineSep", separator).text(paths)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def record_fields(piece: Column) -> dict[str, Column]:
    """name, comment and seq of a FASTA record without its leading ``>``; white space within a sequence is left out."""
    name, comment = _header(F.substring_index(piece, "\n", 1))
    body = F.when(F.contains(piece, F.lit("\n")), F.regexp_replace(F.regexp_replace(piece, r"^[^\n]*\n", ""), r"\s", "")).otherwise("")
    return {"name": name, "comment": comment, "seq": body}


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(rec_idx, name, comment, seq): the records of FASTA files, numbered from 0 by file path and place.

    Lines before a file's first header are skipped, an empty file has no records, and a record without letters an empty
    seq. rec_idx counts skipped leading lines as one record, so it is increasing but may have a gap there.
    """
    rows = _numbered(_text(spark, paths, "\n>"), per_file=False)
    rows = rows.where(~F.col("first") | F.startswith("value", F.lit(">")))
    piece = F.when(F.col("first"), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    return rows.select(F.col("at").alias("rec_idx"), piece.alias("piece")).select("rec_idx", *(v.alias(k) for k, v in record_fields(F.col("piece")).items()))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, rec_idx, name, comment, seq, qual): the records of FASTQ files of four lines a record.

    Blank lines at the end are left out. A header without ``@``, or qualities of another length than the sequence (as in
    a file cut short), raise an error.
    """
    lines = _numbered(_text(spark, paths, "\n").withColumn("value", F.regexp_replace("value", r"\s+$", "")), per_file=True)
    line = lambda i: F.max(F.when(F.pmod("at", F.lit(4)) == i, F.col("value")))
    four = lines.groupBy("file", F.floor(F.col("at") / 4).alias("rec_idx")).agg(*(line(i).alias(f"l{i}") for i in range(4)))
    four = four.where(F.concat_ws("", "l0", "l1", "l2", "l3") != "")
    fine = F.startswith("l0", F.lit("@")) & F.startswith(F.coalesce("l2", F.lit("")), F.lit("+")) & (F.length("l1") == F.length(F.coalesce("l3", F.lit(""))))
    name, comment = _header(F.expr("substring(l0, 2)"))
    broken = F.raise_error(F.concat(F.lit("broken FASTQ record "), F.col("rec_idx").cast("string"), F.lit(" of "), F.col("file")))
    return four.select("file", "rec_idx", name.alias("name"), comment.alias("comment"), F.col("l1").alias("seq"), F.when(fine, F.col("l3")).otherwise(broken.cast("string")).alias("qual"))


def read_long_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, rec_idx, name, comment, seq, qual): the records of FASTQ files whose sequences and qualities may span lines.

    Only a file's start tells whether a line that begins with @ or + is a header, so each file is read by one task, line
    by line; a record has as many quality letters as letters. A record cut short, or a line that can't start one, raises an
    error; blank lines between records are skipped. Qualities and sequences lose white space at line ends.
    """
    lines = _numbered(_text(spark, paths, "\n"), per_file=True).select("file", "at", "value")
    schema = "file string, rec_idx long, header string, seq string, qual string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, header, seq, qual, stage, missing = None, 0, "", [], [], "header", 0

        def check() -> None:
            if stage not in ("header",):
                raise ValueError(f"broken FASTQ record {number} of {file}")

        for batch in batches:
            done: list[dict] = []
            for name, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != file:
                    check()
                    file, number = name, 0
                line = line.rstrip()
                if stage == "header":
                    if not line:
                        continue
                    if line[0] != "@":
                        raise ValueError(f"broken FASTQ record {number} of {file}")
                    header, seq, qual, stage = line[1:], [], [], "seq"
                elif stage == "seq" and line[:1] == "+":
                    missing, stage = sum(map(len, seq)), "qual"
                elif stage == "seq":
                    seq.append(line)
                else:
                    qual.append(line)
                    missing -= len(line)
                if stage == "qual" and missing <= 0:
                    if missing < 0:
                        raise ValueError(f"broken FASTQ record {number} of {file}")
                    if qual or not seq:
                        done.append({"file": file, "rec_idx": number, "header": header, "seq": "".join(seq), "qual": "".join(qual)})
                        number, stage = number + 1, "header"
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("rec_idx", pa.int64()), ("header", pa.string()), ("seq", pa.string()), ("qual", pa.string())]))
        check()

    rows = lines.repartition("file").sortWithinPartitions("file", "at").mapInArrow(read, schema)
    name, comment = _header(F.col("header"))
    return rows.select("file", "rec_idx", name.alias("name"), comment.alias("comment"), "seq", "qual")


def write_tsv(records: DataFrame, path: str) -> None:
    """Name and sequence of each record as tab-separated rows under the header ``query_id``, ``sequence``."""
    records.select(F.col("name").alias("query_id"), F.col("seq").alias("sequence")).write.csv(path, sep="\t", header=True)


def write_fasta(records: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    """Two lines per record; null sequences are written as empty."""
    records.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.coalesce(seq, F.lit(""))).alias("value")).write.text(path)


def write_index(ref: DataFrame, path: str) -> DataFrame:
    """The sampled k-mers of a reference as Parquet, sorted by hash so that later look-ups skip row groups; read again."""
    ref.repartition("h").sortWithinPartitions("h", *[c for c in ("segm_id", "tpos") if c in ref.columns]).write.parquet(path)
    return ref.sparkSession.read.parquet(path)
