"""Proofs of what a run holds of a key: a filter that excludes it, or all rows between two neighbours.

A run is committed to by the Merkle root of its rows in the order of keys and blocks and by the digests of its
filters. A key that a filter excludes is proved absent by that filter; otherwise the rows of the key in a range of
blocks are shown with the rows next to them on both sides, so that none between can be missing.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from stratum.functions.bloom import BloomFilter
from stratum.operators import lookup, merkle
from stratum.plans.scratch import positions, stored
from stratum.schema import KEY

ORDER = ["level", "run", *KEY, "block"]
PART = ["level", "run", "part"]
#: Keys of a filter, keys that are asked together, and rows of a window; each is a bound, not a limit.
PART_KEYS = 1 << 16
#: Leaves of a block: a block's rows, digests and what stands beside it on the levels above are one row.
BLOCK_ROWS = 256


def _above(below: Column, fanout: int) -> Column:
    """The level above some nodes that begin a group."""
    starts = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fanout).cast("int"))
    return F.transform(starts, lambda k: merkle.sha256(F.array_join(F.slice(below, k * fanout + 1, fanout), "")))


def _beside(nodes: Column, at: Column, fanout: int) -> tuple[Column, Column]:
    """What stands left and right of a node in its group."""
    place = at % fanout
    return F.slice(nodes, (at - place + 1).cast("int"), place.cast("int")), F.slice(nodes, (at + 2).cast("int"), (fanout - 1 - place).cast("int"))


def _spine(nodes: DataFrame, fanout: int, height: int, step: int) -> DataFrame:
    """(tree, pos, up, root) of nodes (tree, pos, hash) with height levels above them: what stands beside each node's ancestors, and the root.

    step levels go by one aggregation, so that a path is not carried through a join for each level.
    """
    kind = "array<struct<left:array<string>,right:array<string>>>"
    if not height:
        return nodes.select("tree", "pos", F.array().cast(kind).alias("up"), F.col("hash").alias("root"))
    n = min(step, height)
    group = nodes.groupBy("tree", F.floor(F.col("pos") / fanout**n).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("x"))
    made = group.select("tree", "block", F.transform("x", lambda x: x["hash"]).alias("l0"))
    for i in range(n):
        made = made.withColumn(f"l{i + 1}", _above(F.col(f"l{i}"), fanout))
    made = stored(made, "spine")
    above = _spine(made.select("tree", F.col("block").alias("pos"), F.col(f"l{n}")[0].alias("hash")), fanout, height - n, step)
    each = made.join(above.withColumnRenamed("pos", "block"), ["tree", "block"]).select("*", F.explode(F.sequence(F.lit(0), F.size("l0") - 1)).alias("at"))
    own = F.array(*(F.struct(*(c.alias(s) for c, s in zip(_beside(F.col(f"l{i}"), F.floor(F.col("at") / fanout**i), fanout), ("left", "right"), strict=True))) for i in range(n)))
    return each.select("tree", (F.col("block") * fanout**n + F.col("at")).alias("pos"), F.concat(own, "up").cast(kind).alias("up"), "root")


def filters(keys: DataFrame, error: float) -> DataFrame:
    """(level, run, part, parts, filter) of the distinct keys (addr, slot, level, run) of runs. Parts are a power of two, so that the parts of all runs split a key's hash alike."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BloomFilter(error, max(64, len(pdf))).update(k.encode() for k in pdf["key"])
        return pdf[[*PART, "parts"]].head(1).assign(filter=f.to_bytes())

    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.count("*") / PART_KEYS, F.lit(1.0))))).cast("long")
    sizes = keys.groupBy("level", "run").agg(parts.alias("parts"))
    dealt = keys.select("level", "run", lookup.key_text().alias("key")).join(F.broadcast(sizes), ["level", "run"])  # a row for each run
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    kinds = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in [*PART, "parts"])
    return dealt.groupBy(*PART).applyInPandas(build, f"{kinds}, filter binary")


def _by_buckets(asked: DataFrame, built: DataFrame, least: int) -> tuple[DataFrame, PandasCogroupedOps]:
    """asked by bucket, a key's hash modulo a power of two, with the filters that the buckets need: a filter of fewer parts goes to several buckets, at least least."""
    most = built.agg(F.coalesce(F.max("parts"), F.lit(1))).first()[0]
    buckets = max(most, least)
    keyed = asked.withColumn("key", lookup.key_text()).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets).cast("long")))
    spread = F.explode(F.sequence(F.col("part").cast("long"), F.lit(buckets - 1).cast("long"), F.col("parts").cast("long")))
    own = built.select(*(F.col(c).alias(f"i_{c}") for c in PART), "filter", spread.alias("i_bucket"))
    return keyed, keyed.groupBy("bucket").cogroup(own.groupBy("i_bucket"))


def answers(built: DataFrame, probes: DataFrame) -> DataFrame:
    """(addr, slot, level, run, part, passed): whether the filter of each run lets each key pass. A key is dealt once for all runs."""

    def check(asked: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        keys = [k.encode() for k in asked["key"]]
        out = [asked[KEY].assign(level=e.i_level, run=e.i_run, part=e.i_part, passed=BloomFilter.from_bytes(e.filter).contains_all(keys)) for e in entries.itertuples()]
        return pd.concat(out) if out and keys else asked[KEY].head(0).assign(level=0, run=0, part=0, passed=False)

    asked = stored(probes.select(*KEY).distinct(), "probes")
    keyed, dealt = _by_buckets(asked, built, 1 << max(0, math.ceil(math.log2(max(1, asked.count()) / PART_KEYS))))
    kinds = ", ".join(f"{c} {(keyed if c in KEY else built).schema[c].dataType.simpleString()}" for c in [*KEY, *PART])
    return dealt.applyInPandas(check, f"{kinds}, passed boolean")


class Runs:
    """The runs of rows (addr, slot, block, value, level, run), with trees and filters that are written once."""

    def __init__(self, rows: DataFrame, fanout: int = 4, error: float = 0.1) -> None:
        self.fanout = fanout
        #: Levels inside a block.
        self.step = max(1, int(math.log(BLOCK_ROWS) / math.log(fanout) + 1e-9))
        self.block = fanout**self.step
        ranked = positions(rows.select(*ORDER, "value"), ORDER)
        #: A row for each run: levels times ratio.
        self.runs = stored(ranked.groupBy("level", "run").agg(F.min("pos").alias("first"), F.count("*").alias("n_rows")).withColumn("tree", F.concat_ws("/", "level", "run")), "runs")
        self.ranked = ranked
        place = F.col("pos") - F.col("first")
        own = ranked.join(F.broadcast(self.runs), ["level", "run"]).select("tree", place.alias("pos"), *KEY, "block", "value")
        group = own.groupBy("tree", F.floor(F.col("pos") / self.block).alias("b")).agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*KEY, "block", "value").alias("r")))).alias("x"))
        made = group.select("tree", "b", F.transform("x", lambda x: x["r"]).alias("rows"))
        made = made.withColumn("l0", F.transform("rows", lambda r: merkle.leaf_of(*(r[c] for c in (*KEY, "block", "value")))))
        for i in range(self.step):
            made = made.withColumn(f"l{i + 1}", _above(F.col(f"l{i}"), fanout))
        #: (tree, b, rows, l1, ...): each tree's blocks with their levels of nodes; digests of leaves are made again from the rows.
        self.blocks = stored(made.drop("l0"), "blocks")
        most, height = self.runs.agg(F.coalesce(F.max("n_rows"), F.lit(0))).first()[0], 0
        while fanout**height < most:
            height += 1
        #: Trees that fit into one block go no higher than the highest needs.
        self.height = height
        inner = min(height, self.step)
        top = self.blocks.select("tree", F.col("b").alias("pos"), (F.col(f"l{inner}") if inner else F.transform("rows", lambda r: merkle.leaf_of(*(r[c] for c in (*KEY, "block", "value")))))[0].alias("hash"))
        self.spine = stored(_spine(top, fanout, height - inner, self.step).withColumnRenamed("pos", "b"), "spine")
        self.index = stored(filters(ranked.select(*KEY, "level", "run").distinct(), error), "index")

    def digests(self) -> DataFrame:
        """(level, run, root, filters, digest): what a run is committed to by; filters are the digests of its parts' filters, in their order."""
        own = self.index.groupBy("level", "run").agg(F.array_sort(F.collect_list(F.struct("part", F.sha2("filter", 256).alias("hash")))).alias("f"))
        roots = self.runs.join(self.spine.where("b = 0").select("tree", "root"), "tree").select("level", "run", "root")
        named = own.select("level", "run", F.transform("f", lambda x: x["hash"]).alias("filters")).join(roots, ["level", "run"])
        return named.select("level", "run", "root", "filters", merkle.sha256(F.concat("root", F.array_join("filters", ""))).alias("digest"))

    def _places(self, asked: DataFrame, low: int, high: int) -> DataFrame:
        """asked (addr, slot, level, run) with tree, low and high: the places from the row before a key's blocks from low to high to the row after them.

        Only keys are sorted: a key's place is the number of rows of the keys before it.
        """
        count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
        columns = [*ORDER[:4], "n", "below", "upto", "asked"]
        keys = self.ranked.groupBy(*ORDER[:4]).agg(F.count("*").alias("n"), count(F.col("block") < low)("below"), count(F.col("block") <= high)("upto")).withColumn("asked", F.lit(False))
        zero = F.lit(0).cast("long")
        probes = asked.select(*ORDER[:4], zero.alias("n"), zero.alias("below"), zero.alias("upto"), F.lit(True).alias("asked"))
        both = keys.select(columns).unionByName(probes).groupBy(*ORDER[:4]).agg(F.sum("n").alias("n"), F.sum("below").alias("below"), F.sum("upto").alias("upto"), F.max("asked").alias("asked"))
        every = positions(both, ORDER[:4]).withColumn("part", F.floor(F.col("pos") / PART_KEYS))
        before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        rows = every.withColumn("near", F.coalesce(F.sum("n").over(before(Window.partitionBy("part").orderBy("pos"))), zero))
        sizes = every.groupBy("part").agg(F.sum("n").alias("size")).select("part", F.coalesce(F.sum("size").over(before(Window.orderBy("part"))), zero).alias("far"))
        found = rows.where("asked").join(F.broadcast(sizes), "part").join(F.broadcast(self.runs), ["level", "run"])  # a row for each part, and for each run
        place = F.col("near") + F.col("far") - F.col("first")
        return found.select(*KEY, "level", "run", "tree", F.greatest(place + F.col("below") - 1, zero).alias("low"), F.least(place + F.col("upto"), F.col("n_rows") - 1).alias("high"))

    def _shown(self, places: DataFrame) -> DataFrame:
        """places (addr, slot, level, run, tree, low, high) with rows and path. A range inside a block needs that block only; what a longer one needs of each of its blocks is put together."""
        wide = places.withColumns({"lb": F.floor(F.col("low") / self.block), "hb": F.floor(F.col("high") / self.block)})
        blocks = self.blocks.join(self.spine.select("tree", "b", "up"), ["tree", "b"])
        start = F.greatest(F.col("low") - F.col("b") * self.block, F.lit(0)).cast("int")
        end = F.least(F.col("high") - F.col("b") * self.block, F.lit(self.block - 1)).cast("int")
        inner = min(self.height, self.step)

        def sides(which: int, at: Column) -> Column:
            own = []
            for i in range(inner):
                side = _beside(F.col(f"l{i}") if i else F.col("rows"), F.floor(at / self.fanout**i), self.fanout)[which]
                own.append(side if i else F.transform(side, lambda r: merkle.leaf_of(*(r[c] for c in (*KEY, "block", "value")))))
            return F.concat(F.array(*own).cast("array<array<string>>"), F.transform("up", lambda u: u["left" if not which else "right"]))

        joined = lambda left, right: F.zip_with(left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right")))
        columns = [*KEY, "level", "run"]
        one = wide.where("lb = hb").withColumn("b", F.col("lb")).join(blocks, ["tree", "b"])
        one = one.select(*columns, F.slice("rows", start + 1, end - start + 1).alias("rows"), joined(sides(0, start), sides(1, end)).alias("path"))
        many = wide.where("lb < hb").withColumn("b", F.explode(F.sequence("lb", "hb"))).join(blocks, ["tree", "b"])
        many = many.select(*columns, "b", F.slice("rows", start + 1, end - start + 1).alias("rows"), F.when(F.col("b") == F.col("lb"), sides(0, start)).alias("left"), F.when(F.col("b") == F.col("hb"), sides(1, end)).alias("right"))
        many = many.groupBy(*columns).agg(F.array_sort(F.collect_list(F.struct("b", "rows"))).alias("x"), F.first("left", True).alias("left"), F.first("right", True).alias("right"))
        return one.unionByName(many.select(*columns, F.flatten(F.transform("x", lambda x: x["rows"])).alias("rows"), joined(F.col("left"), F.col("right")).alias("path")))

    def prove(self, probes: DataFrame, low: int, high: int, shared: bool = False) -> DataFrame:
        """(addr, slot, level, run, part, filter, rows, path): for each probed key and run either the filter that excludes it, or rows (addr, slot, block, value) and what leads from them to the root.

        With shared, filter is null and proofs name the part only: verify() takes the filters, which many proofs share, beside them.
        """
        asked = stored(answers(self.index, probes), "asked")
        excluded = asked.where("not passed").select(*KEY, *PART)
        if not shared:
            excluded = excluded.join(self.index.select(*PART, "filter"), PART, "left")
        found = self._shown(stored(self._places(asked.where("passed"), low, high), "places"))
        columns = [*KEY, "level", "run"]
        return found.select(*columns, F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("filter"), "rows", "path").unionByName(excluded, allowMissingColumns=True)

    @staticmethod
    def verify(proofs: DataFrame, digests: DataFrame, low: int, high: int, fanout: int = 4, shared: DataFrame | None = None) -> DataFrame:
        """(addr, slot, level, run, ok, n_found): whether each proof holds against the run's digest, and how many versions of the key from low to high it shows.

        shared are filters (level, run, part, filter) for proofs that name a part and show no filter; each is checked against the digest once.
        """

        def excludes(filters: pd.Series, keys: pd.Series) -> pd.Series:
            return pd.Series([f is not None and k.encode() not in BloomFilter.from_bytes(f) for f, k in zip(filters, keys, strict=True)])

        excluded = F.pandas_udf(excludes, "boolean")
        rows = F.col("rows")
        key, of = F.struct(*KEY), lambda r: F.struct(*(r[k] for k in KEY))
        after = lambda r, b: (of(r) > key) | ((of(r) == key) & (r["block"] > b))
        before = lambda r, b: (of(r) < key) | ((of(r) == key) & (r["block"] < b))
        empty = lambda side: F.forall("path", lambda s: F.size(s[side]) == 0)
        hashes = F.transform(rows, lambda r: merkle.leaf_of(*(r[c] for c in (*KEY, "block", "value"))))
        whole = (empty("left") | before(rows[0], low)) & (empty("right") | after(F.element_at(rows, -1), high))
        by_rows = whole & (merkle.range_root(hashes, F.col("path"), fanout) == F.col("root"))
        joined = proofs.join(F.broadcast(digests), ["level", "run"])  # a row for each run
        named = F.get("filters", F.col("part")) == F.sha2("filter", 256)
        bound = F.col("digest") == merkle.sha256(F.concat("root", F.array_join("filters", "")))
        inside = F.size(F.filter(rows, lambda r: (of(r) == key) & r["block"].between(low, high)))
        # A key is excluded by the filter of its own part only, and an excluded key shows no rows. Proofs by rows do not pass through Python.
        own_part = F.col("part") == F.pmod(F.xxhash64(lookup.key_text()), F.size("filters"))
        by_filter = F.col("filter").isNotNull() & rows.isNull()
        by_name = F.col("part").isNotNull() & F.col("filter").isNull() & rows.isNull()
        answer = lambda df, ok, n: df.select(*KEY, "level", "run", F.coalesce(ok, F.lit(False)).alias("ok"), n.cast("long").alias("n_found"))
        out = answer(joined.where(~by_filter & ~by_name if shared is not None else ~by_filter), bound & by_rows, F.when(rows.isNull(), 0).otherwise(inside))
        checked = joined.where(by_filter).withColumn("no_key", excluded("filter", lookup.key_text()))
        out = out.unionByName(answer(checked, bound & named & own_part & F.col("no_key"), F.lit(0)))
        if shared is None:
            return out
        sound = shared.join(F.broadcast(digests), ["level", "run"]).where(bound & named)
        sound = sound.select(*PART, F.size("filters").cast("long").alias("parts"), "filter")
        by_part = proofs.where(by_name).select(*KEY, *PART)

        def check(asked: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
            by = {(e.i_level, e.i_run, e.i_part): e.filter for e in entries.itertuples()}
            out = asked[[*KEY, "level", "run"]].assign(ok=False, n_found=0)
            for k, at in asked.groupby(PART).indices.items():
                if k in by:  # else the part is not the key's, or its filter not the run's
                    out.iloc[at, out.columns.get_loc("ok")] = ~BloomFilter.from_bytes(by[k]).contains_all(x.encode() for x in asked["key"].iloc[at])
            return out

        # Proofs of all runs meet in a bucket, so there are more buckets than parts.
        keyed, dealt = _by_buckets(by_part, sound, 16 * sound.agg(F.coalesce(F.max("parts"), F.lit(1))).first()[0])
        kinds = ", ".join(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in [*KEY, "level", "run"])
        return out.unionByName(dealt.applyInPandas(check, f"{kinds}, ok boolean, n_found long"))
