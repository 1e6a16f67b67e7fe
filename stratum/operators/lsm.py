"""Leveled runs: which run and level a change lies in, what merging makes of runs, and their sizes.

A run is `capacity` changes in the order of blocks. A level that has `ratio` runs becomes one run of the next.
Placement follows from the number of flushed runs alone, so it is arithmetic, not a simulation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.plans.scratch import positions
from stratum.schema import KEY

PAGE_ROWS = 46


def with_flush(changes: DataFrame, capacity: int) -> DataFrame:
    """changes with flush, the 0-based number of the flush that writes them: each takes capacity changes."""
    return positions(changes, ["block", *KEY]).withColumn("flush", F.floor(F.col("pos") / capacity)).drop("pos")


def placed(flush: Column, flushes: Column, ratio: int) -> tuple[Column, Column]:
    """Level of a flush's rows after so many flushes, and the number of their run in it, oldest first; -1 while it is not full.

    In base ratio, the digits of flushes count the runs of the levels, and the deepest level holds the oldest.
    """
    # All levels that a long number of flushes can have.
    sizes = [ratio**i for i in range(63) if ratio**i < 1 << 62]
    every = F.array(*(F.lit(n).cast("long") for n in sizes))
    size = F.array_max(F.filter(every, lambda n: (flush < flushes - flushes % n) & (flushes >= n)))
    level = F.coalesce(F.array_position(every, size) - 1, F.lit(-1)).cast("int")
    start = flushes - F.when(size <= sizes[-1] // ratio, flushes % (size * ratio)).otherwise(flushes)
    return level, F.coalesce(F.floor((flush - start) / size), F.lit(-1))


def with_runs(changes: DataFrame, capacity: int, ratio: int) -> DataFrame:
    """changes with flush, level and run after all of them were written."""
    rows = with_flush(changes, capacity)
    total = rows.agg(F.count("*").alias("n")).select(F.floor(F.col("n") / capacity).alias("flushes"))
    level, run = placed(F.col("flush"), F.col("flushes"), ratio)
    return rows.join(F.broadcast(total)).withColumns({"level": level, "run": run}).drop("flushes")  # the total is one row


def runs(rows: DataFrame) -> DataFrame:
    """Each run's rows, keys and block range."""
    return rows.groupBy("level", "run").agg(F.count("*").alias("n_rows"), F.min("block").alias("block_lo"), F.max("block").alias("block_hi"))


def merged(*parts: DataFrame) -> DataFrame:
    """Runs merged into one: each key's latest value, and all its versions in order."""
    every = parts[0].select(*KEY, "block", "value")
    for p in parts[1:]:
        every = every.unionByName(p.select(*KEY, "block", "value"))
    return every.groupBy(*KEY).agg(F.max("block").alias("block"), F.max_by("value", "block").alias("value"), F.array_sort(F.collect_set(F.struct("block", "value"))).alias("versions"))


def merged_each(rows: DataFrame, by: list[str]) -> DataFrame:
    """merged() for each run of by: all runs of a table in one pass."""
    return rows.groupBy(*by, *KEY).agg(F.max("block").alias("block"), F.max_by("value", "block").alias("value"), F.array_sort(F.collect_set(F.struct("block", "value"))).alias("versions"))


def compacted(rows: DataFrame, level: int) -> DataFrame:
    """All rows of a level as one run of the next, behind the runs that it has: the newest there. Rows of other levels stay."""
    here = F.col("level") == level
    behind = rows.agg(F.coalesce(F.max(F.when(F.col("level") == level + 1, F.col("run"))) + 1, F.lit(0)).alias("behind"))
    moved = rows.crossJoin(F.broadcast(behind))  # one row
    return moved.withColumns({"run": F.when(here, F.col("behind").cast("long")).otherwise(F.col("run")), "level": F.when(here, F.lit(level + 1)).otherwise(F.col("level"))}).drop("behind")


def newest_first(rows: DataFrame) -> DataFrame:
    """The runs (level, run) with age, their place in the order in which a search visits them: rows not flushed yet, then shallow levels, and in a level the newest run."""
    return rows.select("level", "run").distinct().withColumn("age", F.row_number().over(Window.orderBy("level", F.desc("run"))))


def runs_probed(rows: DataFrame) -> DataFrame:
    """How many flushes a search for each key visits, newest first, until it finds it, if no flushes are merged."""
    newest = rows.agg(F.max("flush").alias("last"))
    return rows.groupBy(*KEY).agg(F.max("flush").alias("flush")).join(F.broadcast(newest)).select(*KEY, (F.col("last") - F.col("flush") + 1).alias("probed"))  # one row


def runs_visited(rows: DataFrame) -> DataFrame:
    """How many runs of all levels a search for each key visits, newest first, until it finds it, if no filter spares it any."""
    runs = newest_first(rows)
    return rows.join(F.broadcast(runs), ["level", "run"]).groupBy(*KEY).agg(F.min("age").cast("long").alias("probed"))  # a row for each run: as many as levels times ratio


def pages(rows: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Rows of each flush in key order, with the page that holds them. A flush has a bounded number of rows."""
    place = F.row_number().over(Window.partitionBy("flush").orderBy(*KEY, "block")) - 1
    return rows.withColumn("page", F.floor(place / page_rows)).select("flush", *KEY, "block", "page")


def filter_bits(n: Column, error: float) -> Column:
    """Bits of a Bloom filter of n keys at an error rate."""
    return F.ceil(n * (-math.log(error) / math.log(2) ** 2))


def with_filter_budget(run_sizes: DataFrame, error: float = 0.1, budget_bytes: int = 1 << 20) -> DataFrame:
    """Which runs get a filter: newest and smallest levels first, while all filters together keep the budget."""
    size = F.ceil(filter_bits(F.col("n_rows"), error) / 8)
    so_far = F.sum("filter_bytes").over(Window.orderBy("level", F.desc("run")))
    return run_sizes.withColumn("filter_bytes", size).withColumn("has_filter", so_far <= budget_bytes)
