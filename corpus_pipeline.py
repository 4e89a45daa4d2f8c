"""A corpus pipeline over the ``documents`` table: quality rules, line dedup, near duplicates, mixing, packing.

Every stage but the last takes and returns the columns of documents; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlark.llm.jaccard import one_of_each
from sketchlark.llm.lines import dedup_lines
from sketchlark.llm.mixing import mixed_texts
from sketchlark.llm.packing import pack
from sketchlark.llm.quality import quality
from sketchlark.plans.batches import small_batches
from sketchlark.plans.scratch import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio.

    Null and blank texts go, as they have fewer than ten words. Rows that repeat are judged alike and all stay or go.
    Without trusted labels the base rules decide alone.
    """
    small_batches(spark)
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of repeated runs of lines deleted from their texts.

    A text of which every line occurs earlier becomes empty; null and empty texts stay as they are. Of equal documents
    the one with the smallest key keeps its lines, null keys first; rows equal in key and text lose the same lines.
    """
    small_batches(spark)
    return _documents(dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group by five-word Jaccard similarity of 0.8 or more: the one with the smallest doc_id.

    Documents without a word all stay. A null doc_id is passed over unless a group has no other, and of rows equal in
    doc_id and text any one stays.
    """
    small_batches(spark)
    return one_of_each(docs, n=5, percent=80).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: whole copies, and the words of blocks taken once more as a document of their own.

    Documents without a word go, as nothing of them is taken. A null source is a source like others, ranked last.
    """
    small_batches(spark)
    return _documents(mixed_texts(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and batches; documents without a word give none, repeated ones as often as they occur."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
    return docs
