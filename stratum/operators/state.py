"""Reads of versioned state: latest, as-of, provenance, dense reads, diffs and pruning.

Every read is one aggregation or one window by key; predicates on keys and blocks reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.schema import KEY

#: Neighbouring keys that a task looks at together; a row for each part meets in one place.
PART_KEYS = 1 << 16


def block_writes(writes: DataFrame, seq: str = "seq") -> DataFrame:
    """One change for each key and block: the last write of the block, by seq, counts."""
    return writes.groupBy(*KEY, "block").agg(F.max_by("value", seq).alias("value"))


def latest(changes: DataFrame) -> DataFrame:
    """The newest block and value of each key."""
    return changes.groupBy(*KEY).agg(F.max("block").alias("block"), F.max_by("value", "block").alias("value"))


def as_of(changes: DataFrame, block: int) -> DataFrame:
    """The state at the end of a block."""
    return latest(changes.where(F.col("block") <= block))


def values_of(keys: DataFrame, changes: DataFrame, default: Column) -> DataFrame:
    """The latest value of each of the keys; default where a key was never written. Only the keys' changes are aggregated."""
    wanted = keys.select(*KEY).distinct()
    return wanted.join(latest(changes.join(wanted, KEY, "left_semi")), KEY, "left").select(*KEY, F.coalesce("value", default).alias("value"))


def without_tombstones(state: DataFrame, empty: Column) -> DataFrame:
    """A state without the keys whose value says that they were deleted."""
    return state.where(~F.col("value").eqNullSafe(empty))


def provenance(changes: DataFrame, low: int, high: int) -> DataFrame:
    """Every version of a key from block low to high, both included. Filter changes by key first; the filter is pushed down."""
    return changes.where(F.col("block").between(low, high)).select(*KEY, "block", "value")


def provenance_with_boundary(changes: DataFrame, low: int, high: int) -> DataFrame:
    """As provenance(), and the version that held at low if low wrote none: inside says which rows are in the range."""
    until = changes.where(F.col("block") <= high)
    following = F.lead("block").over(Window.partitionBy(*KEY).orderBy("block"))
    held = until.withColumn("following", following).where((F.col("block") >= low) | F.coalesce(F.col("following") > low, F.lit(True)))
    return held.select(*KEY, "block", "value", (F.col("block") >= low).alias("inside"))


def dense(changes: DataFrame, low: int, high: int) -> DataFrame:
    """The value of each key at each block from low to high; null before its first write.

    Versions are intervals that end where the next begins; each is unfolded, so there is no range join.
    """
    w = Window.partitionBy(*KEY).orderBy("block")
    spans = changes.where(F.col("block") <= high).select(*KEY, "value", "block", (F.coalesce(F.lead("block").over(w), F.lit(high + 1)) - 1).alias("until"), F.lag("block").over(w).isNull().alias("first"))
    own = F.struct(F.greatest("block", F.lit(low)).alias("a"), F.least("until", F.lit(high)).alias("b"), F.col("value").alias("value"))
    unborn = F.struct(F.lit(low).cast("long").alias("a"), (F.col("block") - 1).alias("b"), F.lit(None).cast(changes.schema["value"].dataType).alias("value"))
    every = spans.select(*KEY, F.explode(F.when(F.col("first"), F.array(unborn, own)).otherwise(F.array(own))).alias("s")).where("s.a <= s.b")
    return every.select(*KEY, F.explode(F.sequence("s.a", "s.b")).alias("block"), F.col("s.value").alias("value"))


def history(changes: DataFrame) -> DataFrame:
    """Each key's number of versions and the versions as an ordered array of (block, value)."""
    return changes.groupBy(*KEY).agg(F.count("*").alias("n_versions"), F.array_sort(F.collect_list(F.struct("block", "value"))).alias("versions"))


def diff(changes: DataFrame, old: int, new: int) -> DataFrame:
    """Keys whose value differs between two blocks, with both values; null where a key was not written yet. One pass for both states."""
    at = lambda b: F.max_by("value", F.when(F.col("block") <= b, F.col("block")))
    both = changes.where(F.col("block") <= max(old, new)).groupBy(*KEY).agg(at(old).alias("old_value"), at(new).alias("new_value"), F.min("block").alias("first"))
    both = both.select(*KEY, F.when(F.col("first") <= old, F.col("old_value")).alias("old_value"), F.when(F.col("first") <= new, F.col("new_value")).alias("new_value"))
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def prune_to_latest(changes: DataFrame) -> DataFrame:
    """Exactly the latest version of each key."""
    return latest(changes)


def prune_before(changes: DataFrame, block: int) -> DataFrame:
    """The versions from a block on, and before it the one that held at it."""
    following = F.lead("block").over(Window.partitionBy(*KEY).orderBy("block"))
    return changes.withColumn("following", following).where((F.col("block") >= block) | F.coalesce(F.col("following") > block, F.lit(True))).drop("following")


def _ranked_with(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """(addr, slot, real, asked, pos, part): existing keys and probes sorted together once, by ranges, and dealt in parts of PART_KEYS neighbouring keys."""
    from stratum.plans.scratch import positions

    real = changes.select(*KEY, F.lit(True).alias("real"), F.lit(False).alias("asked"))
    asked = probes.select(*KEY, F.lit(False).alias("real"), F.lit(True).alias("asked"))
    every = real.unionByName(asked).groupBy(*KEY).agg(F.max("real").alias("real"), F.max("asked").alias("asked"))
    return positions(every, KEY).withColumn("part", F.floor(F.col("pos") / PART_KEYS))


def neighbours(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probed key: whether it exists, and the existing keys next to it on both sides.

    The nearest key on each side inside a part comes from a window over it, and across parts from their last and first
    keys. What follows is what precedes in the other order: only frames that grow from their start take one step a row.
    """
    every = _ranked_with(changes, probes)
    key = F.when(F.col("real"), F.struct(*KEY))
    up, down = (Window.partitionBy("part").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("pos", F.desc("pos")))
    rows = every.withColumn("before", F.last(key, True).over(up)).withColumn("after", F.last(key, True).over(down))
    edges = every.groupBy("part").agg(F.max(key).alias("most"), F.min(key).alias("least"))
    up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("part", F.desc("part")))
    edges = edges.select("part", F.last("most", True).over(up).alias("far_before"), F.last("least", True).over(down).alias("far_after"))
    found = rows.where("asked").join(F.broadcast(edges), "part")  # a row for each part
    return found.select(*KEY, F.col("real").alias("exists"), F.coalesce("before", "far_before").alias("before"), F.coalesce("after", "far_after").alias("after"))


def lower_bounds(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """(addr, slot, pos): for each probed key the 0-based place of the first existing key that is not below it; the last place if all are below.

    The place is the number of existing keys below: those of the parts before, and those before it in its own part.
    """
    every = _ranked_with(changes, probes)
    one, before = F.col("real").cast("long"), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = every.withColumn("near", F.coalesce(F.sum(one).over(before(Window.partitionBy("part").orderBy("pos"))), F.lit(0)))
    sizes = every.groupBy("part").agg(F.sum(one).alias("n"))
    far = F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0))
    last = F.sum("n").over(Window.partitionBy()) - 1
    sizes = sizes.select("part", far.alias("far"), F.when(last >= 0, last).alias("last"))
    found = rows.where("asked").join(F.broadcast(sizes), "part")  # a row for each part
    return found.select(*KEY, F.when(F.col("last").isNotNull(), F.least(F.col("near") + F.col("far"), "last")).alias("pos"))


def rightmost(changes: DataFrame) -> DataFrame:
    """The largest key with its newest block and value: one row."""
    order = F.struct(*KEY, "block")
    return changes.agg(F.max(order).alias("k"), F.max_by("value", order).alias("value")).where("k is not null").select("k.*", "value")


def sample_keys(changes: DataFrame, n: int, seed: int) -> DataFrame:
    """n keys in the order of a digest: the same for the same seed, whatever the table's partitions."""
    from stratum.operators.merkle import leaf

    order = F.sha2(F.concat(F.lit(f"{seed}|"), leaf(*KEY)).cast("binary"), 256)
    return changes.select(*KEY).distinct().orderBy(order, *KEY).limit(n)


def recent_keys(changes: DataFrame, blocks: int) -> DataFrame:
    """Keys written in the last blocks, with the last block that wrote them."""
    head = changes.agg(F.max("block").alias("head"))
    return changes.join(F.broadcast(head)).where(F.col("block") > F.col("head") - blocks).groupBy(*KEY).agg(F.max("block").alias("block"))  # the head is one row


def checked_versions(changes: DataFrame, order: str) -> DataFrame:
    """Rows that would take a key back to an older block than a write before them, by order: a store may refuse these."""
    before = F.max("block").over(Window.partitionBy(*KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return changes.withColumn("newest", before).where(F.col("block") < F.col("newest"))


def keyed(changes: DataFrame, keys: Sequence[tuple]) -> DataFrame:
    """Changes of a few keys given by the caller, as a predicate that reaches the scan."""
    cond = F.lit(False)
    for addr, slot in keys:
        cond = cond | ((F.col("addr") == addr) & (F.col("slot") == slot))
    return changes.where(cond)
