"""Going back to an earlier block: by dropping changes, or by keeping the runs that a checkpoint shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks that runs are looked up in together.
STRETCH = 1024


def rewound(changes: DataFrame, blocks: int) -> DataFrame:
    """changes without those of the last blocks."""
    head = changes.agg(F.max("block").alias("head"))
    return changes.join(F.broadcast(head)).where(F.col("block") <= F.col("head") - blocks).drop("head")  # one row


def checkpoint(runs: DataFrame, block: int) -> DataFrame:
    """The runs' block ranges, as a checkpoint at a block."""
    return runs.select(F.lit(block).cast("long").alias("block"), "level", "run", "block_lo", "block_hi")


def plan(runs: DataFrame, saved: DataFrame) -> DataFrame:
    """What to do with each run of a checkpoint: keep it if a current run has the same range, else rebuild it from all current runs that overlap it.

    (level, run, block_lo, block_hi, action, n_sources). Runs are few, so the range join is of two small tables.
    """
    now = runs.select(F.col("block_lo").alias("lo"), F.col("block_hi").alias("hi"))
    both = saved.join(now, (F.col("lo") <= F.col("block_hi")) & (F.col("hi") >= F.col("block_lo")), "left")
    same = F.max(F.coalesce((F.col("lo") == F.col("block_lo")) & (F.col("hi") == F.col("block_hi")), F.lit(False)))
    grouped = both.groupBy("level", "run", "block_lo", "block_hi").agg(same.alias("same"), F.count("lo").alias("n"))
    return grouped.select("level", "run", "block_lo", "block_hi", F.when(F.col("same"), "keep").otherwise("rebuild").alias("action"), F.when(F.col("same"), F.lit(1)).otherwise(F.col("n")).cast("long").alias("n_sources"))


def rebuilt(rows: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows of the checkpoint's runs, from current rows whatever run holds them."""
    stretch = F.explode(F.sequence(F.floor(F.col("block_lo") / STRETCH), F.floor(F.col("block_hi") / STRETCH))).alias("stretch")
    spans = saved.select(F.col("level").alias("to_level"), F.col("run").alias("to_run"), "block_lo", "block_hi", stretch)
    # Joined by stretches of blocks, so that it is no join of ranges, however many runs there are.
    found = rows.withColumn("stretch", F.floor(F.col("block") / STRETCH)).join(spans, "stretch").where(F.col("block").between(F.col("block_lo"), F.col("block_hi")))
    return found.drop("block_lo", "block_hi", "stretch")
