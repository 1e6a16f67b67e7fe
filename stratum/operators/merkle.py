"""Digests of rows and k-ary Merkle trees as tables (tree, level, pos, hash).

Digests are hexadecimal strings of SHA-256 over the joined hexadecimal strings below them, by default; hashing.py
offers BLAKE2b with the same signature. A level is an aggregation of groups of at most fanout rows, so trees grow
with as many small shuffles as they have levels; trees of many runs or keys grow together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.plans.scratch import stored

Hash = Callable[[Column], Column]
#: Leaf positions that a range is looked up in together.
STRETCH = 4096


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*columns: str, hashed: Hash = sha256) -> Column:
    """Digest of a row: its columns as strings, each after its length in bytes, so that borders count; null is a dash."""
    return leaf_of(*map(F.col, columns), hashed=hashed)


def leaf_of(*columns: Column, hashed: Hash = sha256) -> Column:
    """leaf() of column expressions."""
    text = [c.cast("string") for c in columns]
    return hashed(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)))


def joined(hashes: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(hashes), lambda x: x["hash"]), "")


def parents(nodes: DataFrame, fanout: int, hashed: Hash = sha256) -> DataFrame:
    """The level above some nodes (tree, pos, hash)."""
    group = nodes.groupBy("tree", F.floor(F.col("pos") / fanout).alias("pos")).agg(F.collect_list(F.struct("pos", "hash")).alias("below"))
    return group.select("tree", "pos", hashed(joined(F.col("below"))).alias("hash"))


def levels(leaves: DataFrame, fanout: int, hashed: Hash = sha256) -> list[DataFrame]:
    """Levels of the trees of leaves (tree, pos, hash), from the leaves to the roots. Short trees go on to be hashed above their root.

    Each level is stored, so that it is made once: all levels above the leaves are a fraction of these.
    """
    leaves = stored(leaves.select("tree", "pos", "hash"), "leaves")
    most = leaves.agg(F.max("pos")).first()[0]
    out, n = [leaves], (0 if most is None else most + 1)
    while n > 1:
        out.append(stored(parents(out[-1], fanout, hashed), "nodes"))
        n = -(-n // fanout)
    return out


def roots(leaves: DataFrame, fanout: int, hashed: Hash = sha256, made: list[DataFrame] | None = None) -> DataFrame:
    """(tree, root). made are the levels() of the leaves, if there are any."""
    return (made or levels(leaves, fanout, hashed))[-1].select("tree", F.col("hash").alias("root"))


def proofs(leaves: DataFrame, fanout: int, hashed: Hash = sha256, made: list[DataFrame] | None = None) -> DataFrame:
    """(tree, pos, hash, path): for each leaf, the siblings on the left and right of its ancestors, from below.

    A path has a struct (left, right) for each level; both are the joined digests of the group's other members.
    made are the levels() of the leaves, if there are any.
    """
    every = made or levels(leaves, fanout, hashed)
    out = every[0].select("tree", "pos", "hash", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    for i, level in enumerate(every[:-1]):
        group = F.floor(F.col("pos") / fanout)
        below = level.groupBy("tree", group.alias("group")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("all"))
        at = F.floor(F.col("pos") / fanout**i)
        side = lambda keep: F.array_join(F.transform(F.filter("all", keep), lambda x: x["hash"]), "")
        me = F.col("at")
        out = out.withColumn("at", at).withColumn("group", F.floor(at / fanout)).join(below, ["tree", "group"])
        out = out.select("tree", "pos", "hash", F.concat("path", F.array(F.struct(side(lambda x: x["pos"] < me).alias("left"), side(lambda x: x["pos"] > me).alias("right")))).alias("path"))
    return out


def range_proofs(made: list[DataFrame], ranges: DataFrame, fanout: int) -> DataFrame:
    """(tree, low, high, hashes, path) for ranges (tree, low, high) of leaf positions: the leaves' digests in order, and for each level what stands left and right of the range in the nodes at its borders.

    made are the levels() of the leaves. A range beyond the leaves ends with the last one. A range's leaves go into one row.
    """
    leaves = made[0].select(F.col("tree").alias("t"), "pos", "hash")
    inside = ranges.select("tree", "low", "high").distinct()
    # Leaves are joined by stretches of STRETCH positions, so that this is no join of ranges.
    part = inside.withColumn("part", F.explode(F.sequence(F.floor(F.col("low") / STRETCH), F.floor(F.col("high") / STRETCH))))
    found = part.join(leaves.withColumn("part", F.floor(F.col("pos") / STRETCH)), ["part"]).where((F.col("tree") == F.col("t")) & F.col("pos").between(F.col("low"), F.col("high")))
    out = found.groupBy("tree", "low", "high").agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("all"))
    out = out.select("tree", "low", "high", F.transform("all", lambda x: x["hash"]).alias("hashes"), F.element_at("all", -1)["pos"].alias("last"), F.array().cast("array<struct<left:array<string>,right:array<string>>>").alias("path"))
    for i, level in enumerate(made[:-1]):
        below = level.groupBy("tree", F.floor(F.col("pos") / fanout).alias("group")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("members"))
        at = lambda c: F.floor(F.col(c) / fanout**i)  # noqa: B023, E731
        out = out.withColumns({"a": at("low"), "b": at("last")}).withColumns({"ga": F.floor(F.col("a") / fanout), "gb": F.floor(F.col("b") / fanout)})
        out = out.join(below.select("tree", F.col("group").alias("ga"), F.col("members").alias("first")), ["tree", "ga"]).join(below.select("tree", F.col("group").alias("gb"), F.col("members").alias("final")), ["tree", "gb"])
        a, b = F.col("a"), F.col("b")
        beside = F.struct(F.transform(F.filter("first", lambda x: x["pos"] < a), lambda x: x["hash"]).alias("left"), F.transform(F.filter("final", lambda x: x["pos"] > b), lambda x: x["hash"]).alias("right"))
        out = out.select("tree", "low", "high", "hashes", "last", F.concat("path", F.array(beside)).alias("path"))
    return out.drop("last")


def range_root(hashes: Column, path: Column, fanout: int, hashed: Hash = sha256) -> Column:
    """The root that a range's leaves and what stands beside them lead to. The first node of a level begins with what is left of the range, so nodes are counted from there."""

    def up(members: Column, beside: Column) -> Column:
        every = F.concat(beside["left"], members, beside["right"])
        starts = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / fanout).cast("int"))
        return F.transform(starts, lambda k: hashed(F.array_join(F.slice(every, k * fanout + 1, fanout), "")))

    return F.aggregate(path, hashes, up)[0]


def folded(digest: Column, path: Column, hashed: Hash = sha256) -> Column:
    """The root that a leaf's digest and path lead to."""
    return F.aggregate(path, digest, lambda h, s: hashed(F.concat(s["left"], h, s["right"])))


def verified(proven: DataFrame, root: DataFrame, hashed: Hash = sha256) -> DataFrame:
    """proofs() rows with ok: whether they lead to the root of their tree (tree, root)."""
    return proven.join(root, "tree").withColumn("ok", folded(F.col("hash"), F.col("path"), hashed) == F.col("root"))


def proof_bytes(path: Column) -> Column:
    """Size of a proof: its digests, 32 bytes each."""
    return F.aggregate(path, F.lit(0).cast("long"), lambda n, s: n + F.floor((F.length(s["left"]) + F.length(s["right"])) / 2))


def ordered_digest(rows: DataFrame, order: Column, digest: str, by: list[str], name: str, hashed: Hash = sha256) -> DataFrame:
    """One digest for each group: that of its rows' digests, joined in an order. For runs of a level and levels of a store, which are few."""
    part = rows.groupBy(*by) if by else rows.groupBy()
    return part.agg(F.array_sort(F.collect_list(F.struct(order.alias("pos"), F.col(digest).alias("hash")))).alias("x")).select(*by, hashed(joined(F.col("x"))).alias(name))
