"""Streams of pages of observations: written once though a batch runs twice, and counted within a bound of lateness."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_pages(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append each micro-batch to its own partition of ``path``, one row a key.

    A batch that runs again after a failure overwrites its own partition only, so every row is there once. ``path`` and
    ``checkpoint`` lie in storage that all executors share.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = F.struct(*[c for c in batch.columns if c not in keys])
        once = batch.groupBy(*keys).agg(F.min_by(rest, F.to_json(rest)).alias("row")).select(*keys, "row.*")  # the same one when it runs again
        once.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_pages(spark, path: str, keys: list[str]) -> DataFrame:
    """The pages written so far, all columns and the batch; of a key that came in several batches the first one's row."""
    pages = spark.read.parquet(path)
    rest = F.struct(*[c for c in pages.columns if c not in keys])
    return pages.groupBy(*keys).agg(F.min_by(rest, "batch_id").alias("row")).select(*keys, "row.*")


def counts_within(stream: DataFrame, ts: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per window; a row that comes after its window closed (newest time less ``late``) is dropped, any other counts."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
