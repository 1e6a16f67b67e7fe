"""Workload traces as tables of writes and reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The operations of a key-value trace.
KV_LINE = r"^(READ|UPDATE|INSERT) usertable (\S+) \[ ?(?:field\d+=(.*?))? ?\]?$"


def kv_operations(lines: DataFrame, column: str = "value") -> DataFrame:
    """(op, key, value) of trace lines; value is null for a read. Other lines are left out."""
    part = lambda i: F.regexp_extract(column, KV_LINE, i)
    rows = lines.select(part(1).alias("op"), part(2).alias("key"), part(3).alias("value")).where("op <> ''")
    return rows.select("op", "key", F.when(F.col("op") != "READ", F.col("value")).alias("value"))


def transfers(lines: DataFrame, column: str = "value") -> DataFrame:
    """(sender, receiver) of lines with two words."""
    words = F.split(F.trim(column), " +")
    return lines.where(F.size(words) == 2).select(words[0].alias("sender"), words[1].alias("receiver"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def smallbank(spark: SparkSession, n: int, accounts: int, seed: int, block_size: int = 100) -> DataFrame:
    """n random SmallBank transactions (block, seq, op, a, b, amount): the same for the same seed, however they are partitioned."""

    def draw(salt: int, most: int) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(str(salt)), F.col("id").cast("string")), 256)
        return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % most + 1).cast("int")

    rows = spark.range(n)
    return rows.select((F.floor(F.col("id") / block_size) + 1).alias("block"), F.col("id").alias("seq"), draw(1, 6).alias("op"), draw(2, accounts - 1).alias("a"), draw(3, accounts - 1).alias("b"), draw(4, 99).alias("amount"))


def blocks(rows: DataFrame, order: str, size: int = 100) -> DataFrame:
    """Rows with block, in the order of a column that counts up from 0 without gaps."""
    return rows.withColumn("block", F.floor(F.col(order) / size) + 1)
