"""How much of a table reaches a Python worker at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

LIMIT, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not by 10,000 rows alone: a batch of long texts is held by Spark and by each worker, on the
    way in and out. A session that names a limit keeps it; it counts when a plan is run, so it stays set.
    """
    if spark.conf.get(LIMIT, None) is None:
        spark.conf.set(LIMIT, BYTES)
