"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share, or in local mode a local folder where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (shared or "file:///tmp/checkpoints").rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once below folder() and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """df with the 0-based rank of each row in the order of the columns, which must tell all rows apart.

    A global sort deals the rows in ranges; a row's rank is its place in its range and the sizes of the ranges
    before. Only these sizes, one number a task, meet in one place.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranged")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")  # a row for each task of the sort
