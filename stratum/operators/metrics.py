"""Measures of a ledger's work: latency, storage, proofs and memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_latency(times: DataFrame) -> DataFrame:
    """One row for the blocks' (start, end): number, mean, median, 99th percentile and longest, in their unit."""
    took = F.col("end") - F.col("start")
    return times.agg(F.count("*").alias("n_blocks"), F.avg(took).alias("mean"), F.percentile_approx(took, 0.5).alias("median"), F.percentile_approx(took, 0.99).alias("p99"), F.max(took).alias("longest"))


def sampled_storage(rows: DataFrame, every: int) -> DataFrame:
    """(block, n_changes): the changes up to each block that is a multiple of every. Blocks are counted first, so only a row a block is ordered."""
    from pyspark.sql import Window

    per_block = rows.groupBy("block").agg(F.count("*").alias("n"))
    per_bucket = per_block.groupBy(F.ceil(F.col("block") / every).alias("bucket")).agg(F.sum("n").alias("n"), F.max("block").alias("head"))
    # Each bucket's total holds until the next one with changes; a row for each of the buckets between.
    order = Window.orderBy("bucket")
    spans = per_bucket.select("bucket", F.sum("n").over(order).alias("n_changes"), (F.coalesce(F.lead("bucket").over(order) - 1, F.floor(F.col("head") / every))).alias("until"))
    return spans.where("bucket <= until").select(F.explode(F.sequence("bucket", "until")).alias("bucket"), "n_changes").select((F.col("bucket") * every).alias("block"), "n_changes")


def storage_by_kind(files: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, bytes) of files (name, bytes), by the prefix of their names; others count as other."""
    kind: Column = F.lit("other")
    for prefix, name in kinds.items():
        kind = F.when(F.col("name").startswith(prefix), name).otherwise(kind)
    return files.groupBy(kind.alias("kind")).agg(F.sum("bytes").alias("bytes"))


def window_proofs(proofs: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, n_proofs, mean_versions, mean_bytes): averages over proofs (window, n_found, proof_bytes) for each of the windows (window); 0 where there is none."""
    means = proofs.groupBy("window").agg(F.count("*").alias("n_proofs"), F.avg("n_found").alias("mean_versions"), F.avg("proof_bytes").alias("mean_bytes"))
    return windows.join(means, "window", "left").select("window", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_proofs", "mean_versions", "mean_bytes")))


def memory(filters: DataFrame) -> DataFrame:
    """Bytes of all filters (memory) that a store keeps in memory."""
    return filters.agg(F.coalesce(F.sum("memory"), F.lit(0)).alias("bytes"))


def windows(head: int, sizes: list[int]) -> list[tuple[int, int, int]]:
    """(size, low, high) of the provenance windows that end at the head."""
    return [(w, head - w + 1, head) for w in sizes]


def window_versions(changes: DataFrame, keys: DataFrame, head: int, sizes: list[int]) -> DataFrame:
    """(window, n_keys, n_versions) for each window size: keys with a version in it, and how many. One pass for all windows."""
    recent = changes.join(keys, ["addr", "slot"], "left_semi").where(F.col("block").between(head - max(sizes) + 1, head))
    each = recent.select("addr", "slot", F.explode(F.array(*map(F.lit, sizes))).alias("window"), "block").where(F.col("block") > head - F.col("window"))
    return each.groupBy("window").agg(F.count_distinct("addr", "slot").alias("n_keys"), F.count("*").alias("n_versions"))
