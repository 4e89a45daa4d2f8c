"""Mapping of reads as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sketchlark.operators.mapping import map_reads
from sketchlark.operators.sketch import sketch
from sketchlark.params import Params
from sketchlark.sources.fasta import record_fields


def stream_fasta(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(query_id, seq): the records of FASTA files added to a folder, as a stream.

    One ``>`` is taken off the start of a record, so a name can't begin with that sign.
    """
    rows = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(folder)
    parts = record_fields(F.regexp_replace("value", "^>", ""))
    return rows.select(parts["name"].alias("query_id"), parts["seq"].alias("seq")).where("query_id <> ''")


def map_stream(reads: DataFrame, ref: DataFrame, params: Params, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Map a stream of (query_id, seq) onto ``ref`` and write each batch's mappings to ``out/batch=N`` as Parquet.

    ``ref`` should be a written index (see ``write_index``), as every batch reads it. A read never spans batches, so no
    state or watermark is kept; a batch that is run again overwrites its own folder, so each mapping is there once.
    """

    def run(batch: DataFrame, number: int) -> None:
        mapped = map_reads(sketch(batch, "query_id", "seq", params.k, params.ratio), ref, params)
        mapped.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = reads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
