"""Blocks as a stream: the tables of the batch operators, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratum.operators.state import block_writes
from stratum.schema import KEY


def latest_stream(writes: DataFrame) -> DataFrame:
    """The newest value of each key of a stream of writes (addr, slot, block, seq, value), for complete or update mode. Spark keeps one row of state for each key."""
    order = F.struct("block", "seq")
    return writes.groupBy(*KEY).agg(F.max(order).alias("newest"), F.max_by("value", order).alias("value")).select(*KEY, F.col("newest.block").alias("block"), "value")


def append_blocks(writes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's changes below path. A batch that runs again replaces its own folder, so rows are there once.

    The source must not split a block between batches; block_writes() is by block.
    """

    def write(batch: DataFrame, number: int) -> None:
        block_writes(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return writes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def block_counts(writes: DataFrame, time: str, lateness: str, width: str) -> DataFrame:
    """Writes and keys for each window of event time, with late rows up to a limit."""
    return writes.withWatermark(time, lateness).groupBy(F.window(time, width)).agg(F.count("*").alias("n_writes"), F.approx_count_distinct(F.xxhash64(*KEY)).alias("keys")).select("window.start", "n_writes", "keys")
