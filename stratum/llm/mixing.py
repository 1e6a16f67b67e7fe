"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks of about BLOCK_DOCS. A pass over a source draws its blocks in a
random order of its own. A source's target in words fixes how many whole passes the mix takes, and where the last
pass ends: after a number of blocks and, within the next one, with the documents that fill it up to the target. So a
source is one sequence of block draws with an exact quota. A tree over the output shards halves the vector of
quotas again and again, each time by a multivariate-hypergeometric draw; at its leaves, every shard knows how many
draws of every source are its own, and takes that stretch of the source's sequence. Draws are disjoint, and
the shards' shares are those of a uniform shuffle of all draws. Rows are then shuffled inside their shard only.

Sources are dealt into groups: the tree splits the groups' quotas first, then each group's share among its sources,
which is the same draw in two steps. Only the groups' quotas are on the driver. The plan is a table with a row for
each block, and texts are not shuffled to be drawn.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import WORD, stored
from stratum.plans.scratch import positions

BLOCK_DOCS = 1024
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Words of a shard, and the fewest and most shards.
SHARD_WORDS, LEAST_SHARDS, MOST_SHARDS = 50_000_000, 16, 4096
#: Sources of a group.
GROUP_SOURCES = 1000
#: Tables of the plan are broadcast up to so many rows (some 100 bytes each); larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD})")), F.lit(0)).cast("long")


def split_quotas(quotas: Sequence[int], shares: Sequence[int], seed: Sequence[int]) -> np.ndarray:
    """How many draws of each source each shard takes, shards by sources: columns add up to the quotas, rows to the shares."""
    out = np.zeros((len(shares), len(quotas)), np.int64)
    ends = np.cumsum([0, *shares])

    def divide(low: int, high: int, counts: np.ndarray) -> None:
        if high - low == 1:
            out[low] = counts
            return
        mid = (low + high) // 2
        left = int(ends[mid] - ends[low])
        rng = np.random.default_rng([*seed, low, high])
        mine = rng.multivariate_hypergeometric(counts, left, method="marginals") if left else np.zeros_like(counts)
        divide(low, mid, mine)
        divide(mid, high, counts - mine)

    divide(0, len(shares), np.asarray(quotas, np.int64))
    return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def with_targets(sources: DataFrame, weights: Sequence[float], share: float, most_times: float) -> DataFrame:
    """sources (size, weight) with target: shares of all words by weight, none above most_times its size; the excess is shared by weight among the others, until none is above.

    The words that a unit of weight gets only grow from round to round, so a source that is full stays full: a
    round is one aggregate, and no source is on the driver.
    """
    cap, weight = most_times * F.col("size"), F.col("weight")
    total, whole = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rest, left, full = share * total, whole, 0
    each = rest / left if left > 0 else 0.0
    while left > 0:
        above = sources.where(weight * F.lit(each) > cap).agg(F.count("*"), F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if above[0] == full:
            break
        full, rest, left = above[0], share * total - above[1], whole - above[2]
        each = rest / left if left > 0 else float("inf")
    target = F.when(weight <= 0, F.lit(0.0)).when(F.lit(each) == float("inf"), cap).otherwise(F.least(cap.cast("double"), weight * F.lit(each)))
    return sources.withColumn("target", target.cast("double"))


def _fill(rows: pa.Table) -> pa.Table:
    """Which documents of a source's last block to take: in order, each that still fits, and one more if that comes nearer."""
    rows = rows.sort_by([("h", "ascending"), ("size", "ascending")])
    left, taken = rows.column("rest")[0].as_py(), []
    missed: tuple[int, int] | None = None
    for h, size in zip(rows.column("h").to_pylist(), rows.column("size").to_pylist(), strict=True):
        if size <= left:
            left -= size
            taken.append(h)
        elif missed is None or size < missed[0]:
            missed = (size, h)
    if missed and missed[0] - left < left:
        taken.append(missed[1])
    return pa.table([pa.array([rows.column("source")[0].as_py()] * len(taken), pa.string()), pa.array(taken, pa.int64())], names=["f_source", "f_h"])


def _split_group(shares: dict[int, list[int]], seed: int):  # noqa: ANN202
    """Of a group's rows (source, g, quota), each source's shards with the number of its draws up to theirs."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("source")
        group = rows.column("g")[0].as_py()
        ends = split_quotas(rows.column("quota").to_pylist(), shares[group], [seed, 1, group]).cumsum(axis=0).T
        bounds = [[{"upto": int(row[k]), "shard": int(k)} for k in np.flatnonzero(np.diff(row, prepend=0))] for row in ends]
        return pa.table([rows.column("source"), pa.array(bounds, pa.list_(pa.struct([("upto", pa.int64()), ("shard", pa.int32())])))], names=["b_source", "bounds"])

    return run


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most_times: int = MOST_TIMES, shards: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with columns mix_size, mix_source_size (long), mix_target (double) and mix_draws: an array of (epoch, shard), one for each time the mix takes the document.

    Sources in the order of code points, null last (a source of its own), have the weights, repeating. Together
    they take share of all words, and none more than most_times its size. A source of size 0 takes nothing. A
    source's taken words differ from its target by half of the smallest document of its last block that is left out, at most. No document is drawn more
    than most_times. The same rows give the same draws in any order and partitioning; of rows that repeat a
    document, which are told apart by where they stand, each is drawn by itself. shards is a number that grows with the words
    if it is not given. Null texts have no words, no rows give none. Columns of docs with the names of the new ones are replaced.
    """
    new = ["mix_size", "mix_source_size", "mix_target", "mix_draws"]
    # The row's own columns go together, so that their names cannot clash with the plan's.
    row = F.struct(*(docs[c] for c in docs.columns if c not in new)).alias("row")
    key = F.xxhash64(F.lit(seed), docs[id_col], F.xxhash64(docs[text_col]))
    read = docs.select(row, docs[source_col].cast("string").alias("source"), words(docs[text_col]).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("at"))
    repeated = stored(read.groupBy("source", "key").count().where("count > 1").select(F.col("source").alias("r_source"), F.col("key").alias("r_key")), "repeated")
    if repeated.isEmpty():
        read = read.withColumn("h", F.col("key"))
    else:
        read = read.join(_small(repeated), F.col("source").eqNullSafe(F.col("r_source")) & (F.col("key") == F.col("r_key")), "left")
        read = read.withColumn("h", F.when(F.col("r_key").isNull(), F.col("key")).otherwise(F.xxhash64("key", "at")))
    slim = stored(read.select("source", "size", "h"), "sized")

    found = stored(slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "sources").withColumn("no_source", F.col("source").isNull())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    sources = stored(positions(found, ["no_source", "source"]).withColumn("weight", weight).drop("no_source"), "sources")
    rest = lambda c: F.col("target") - F.col(c) * F.col("size")
    passes = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(most_times))).otherwise(0).cast("int")
    plan = with_targets(sources, weights, share, most_times).withColumn("passes", passes).withColumn("rest", rest("passes"))
    plan = stored(plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("target").alias("p_target"), "passes", "rest", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.lit(1)).cast("long").alias("blocks")), "plan")
    planned = lambda df: df.join(_small(plan), F.col("source").eqNullSafe(F.col("p_source"))).withColumn("block", F.pmod("h", "blocks"))

    # The order of a source's blocks in each pass, and where the last one ends: a row for each block of about BLOCK_DOCS documents.
    own = planned(slim)
    sums = own.groupBy("p_source", "passes", "rest", "blocks", "block").agg(F.sum("size").alias("words"))
    drawn_at = lambda e: F.row_number().over(Window.partitionBy("p_source").orderBy(F.xxhash64(F.lit(seed + 1), F.lit(e), "p_source", "block"), "block")) - 1
    placed = sums.withColumn("places", F.array(*(drawn_at(e) for e in range(most_times)))).withColumn("last", F.get("places", F.col("passes")))
    before = F.sum("words").over(Window.partitionBy("p_source").orderBy("last").rowsBetween(Window.unboundedPreceding, -1))
    placed = stored(placed.withColumn("before", F.coalesce(before, F.lit(0))), "blocks")
    # Blocks that lie in the rest are taken once more, the one that it ends in partly.
    part = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    whole = (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("passes") < most_times) & (F.col("rest") > 0)
    ends = placed.where(part).select(F.col("p_source").alias("e_source"), F.col("block").alias("e_block"), (F.col("rest") - F.col("before")).alias("e_rest"))
    last = own.join(_small(ends), F.col("p_source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")))
    # One block's documents for each source: some BLOCK_DOCS rows.
    filled = stored(last.select("source", "h", "size", F.col("e_rest").alias("rest")).groupBy("source").applyInArrow(_fill, "f_source string, f_h long"), "filled")

    started = filled.groupBy("f_source").agg(F.lit(1).alias("started"))
    quota = F.first("passes") * F.first("blocks") + F.sum(whole.cast("long"))
    quotas = placed.groupBy("p_source").agg(quota.alias("quota")).join(_small(started), F.col("p_source").eqNullSafe(F.col("f_source")), "left")
    groups = max(1, -(-plan.count() // GROUP_SOURCES))
    dealt = stored(quotas.select(F.col("p_source").alias("source"), F.pmod(F.xxhash64(F.lit(seed), "p_source"), F.lit(groups)).alias("g"), (F.col("quota") + F.coalesce("started", F.lit(0))).alias("quota")), "quotas")
    whole_groups = sorted(tuple(r) for r in dealt.groupBy("g").agg(F.sum("quota")).collect())  # a row for each GROUP_SOURCES sources
    if shards is None:
        n_words = plan.agg(F.coalesce(F.sum("p_target"), F.lit(0.0))).first()[0]
        shards = min(MOST_SHARDS, max(LEAST_SHARDS, int(n_words // SHARD_WORDS)))
    total = sum(q for _, q in whole_groups)
    even = np.diff(np.arange(shards + 1) * total // shards).tolist()
    top = split_quotas([q for _, q in whole_groups], even, [seed, 0])
    shares = {g: top[:, k].tolist() for k, (g, _) in enumerate(whole_groups)}
    bounds = stored(dealt.groupBy("g").applyInArrow(_split_group(shares, seed), "b_source string, bounds array<struct<upto:long,shard:int>>"), "bounds")

    shard = lambda e: F.get(F.filter("bounds", lambda b: b["upto"] > e * F.col("blocks") + F.get("places", e)), F.lit(0))["shard"]
    draw = lambda e: F.struct(e.cast("int").alias("epoch"), shard(e).alias("shard"))
    epochs = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), draw)).otherwise(F.array().cast("array<struct<epoch:int,shard:int>>"))
    again = F.when(whole | part, draw(F.col("passes")))
    draws = placed.join(_small(bounds), F.col("p_source").eqNullSafe(F.col("b_source"))).select(F.col("p_source").alias("d_source"), F.col("block").alias("d_block"), epochs.alias("full"), again.alias("again"), part.alias("part"))
    draws = stored(draws, "draws")

    out = planned(read).join(_small(draws), F.col("source").eqNullSafe(F.col("d_source")) & (F.col("block") == F.col("d_block")))
    out = out.join(_small(filled), F.col("part") & F.col("source").eqNullSafe(F.col("f_source")) & (F.col("h") == F.col("f_h")), "left")
    taken = F.col("again").isNotNull() & (~F.col("part") | F.col("f_h").isNotNull())
    return out.select("row", F.col("size").alias("mix_size"), F.col("p_size").alias("mix_source_size"), F.col("p_target").alias("mix_target"), F.when(taken, F.concat("full", F.array("again"))).otherwise(F.col("full")).alias("mix_draws")).select("row.*", *new)


def drawn(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each draw of mix(), with mix_epoch and mix_shard in place of mix_draws. Documents that are not drawn have none; columns of these names are replaced."""
    kept = [c for c in mixed.columns if c not in ("mix_draws", "mix_epoch", "mix_shard")]
    return mixed.select(F.struct(*kept).alias("row"), F.explode("mix_draws").alias("draw")).select("row.*", F.col("draw.epoch").alias("mix_epoch"), F.col("draw.shard").alias("mix_shard"))


def shuffled(rows: DataFrame, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """drawn() rows, each shard in partitions of its own and in random order; rows that are equal, null ids included, stand in any order."""
    order = F.xxhash64(F.lit(seed + 1), id_col, "mix_epoch")
    return rows.repartition("mix_shard", F.pmod(order, F.lit(64))).sortWithinPartitions("mix_shard", order)
