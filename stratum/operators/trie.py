"""Tries over hashed keys as tables: prefix fan-out, snapshot roots, node versions and pruning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.patricia import Trie, verify
from stratum.operators import merkle
from stratum.operators.state import as_of
from stratum.plans.scratch import positions
from stratum.schema import KEY


def path() -> Column:
    """The nibbles of a key: the hexadecimal SHA-256 of its columns."""
    return merkle.leaf(*KEY)


def fanout(state: DataFrame, depth: int) -> DataFrame:
    """(depth, prefix, children, leaves): for each prefix of up to depth nibbles, the next nibbles that occur and the keys below."""
    p = state.select(path().alias("p"))
    every = p.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"), "p")
    rows = every.select("depth", F.expr("substring(p, 1, depth)").alias("prefix"), F.expr("substring(p, depth + 1, 1)").alias("nibble"))
    return rows.groupBy("depth", "prefix").agg(F.count_distinct("nibble").alias("children"), F.count("*").alias("leaves"))


def nibbles_for(state: DataFrame, most: int = 50_000) -> int:
    """How many nibbles part a state's keys into tries of about so many; their digests spread keys evenly."""
    rows, n = state.count(), 1
    while rows > most * 16**n:
        n += 1
    return n


def _parted(state: DataFrame, nibbles: int) -> DataFrame:
    return state.select(F.substring(path(), 1, nibbles).alias("shard"), F.substring(path(), nibbles + 1, 64).alias("rest"), merkle.leaf("value").alias("hash"))


def _trie(pdf: pd.DataFrame) -> Trie:
    return Trie(dict(zip(pdf["rest"], pdf["hash"], strict=True)))


def shards(state: DataFrame, nibbles: int = 2) -> DataFrame:
    """(shard, kind, path, below, nodes): the root node of the trie below each prefix of some nibbles, and its number of nodes. They are built side by side; more nibbles make smaller shards."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _trie(pdf)
        kind, part, below = t.nodes[t.root]
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "kind": [kind], "path": [part], "below": ["|".join(below)], "nodes": [len(t.nodes)]})

    return _parted(state, nibbles).groupBy("shard").applyInPandas(build, "shard string, kind string, path string, below string, nodes long")


def _joined_shards(rows: DataFrame, nibbles: int) -> DataFrame:
    """shards() of one nibble less: a lone root goes up with its nibble, several become a branch."""
    nibble = F.substring("shard", nibbles, 1)
    rows = rows.select(F.substring("shard", 1, nibbles - 1).alias("shard"), nibble.alias("nibble"), "kind", "path", "below", merkle.sha256(F.concat_ws("|", "kind", "path", "below")).alias("digest"))
    only = lambda c: F.first(c).alias(c)
    slots = [F.coalesce(F.max(F.when(F.col("nibble") == n, F.col("digest"))), F.lit("")) for n in "0123456789abcdef"]
    up = rows.groupBy("shard").agg(F.count("*").alias("n"), *map(only, ("nibble", "kind", "path", "below", "digest")), F.concat_ws("|", *slots).alias("slots"))
    lone, branch = F.col("n") == 1, F.col("kind") == "branch"
    return up.select(
        "shard",
        F.when(~lone, F.lit("branch")).when(branch, F.lit("extension")).otherwise(F.col("kind")).alias("kind"),
        F.when(~lone, F.lit("")).when(branch, F.col("nibble")).otherwise(F.concat("nibble", "path")).alias("path"),
        F.when(~lone, F.col("slots")).when(branch, F.col("digest")).otherwise(F.col("below")).alias("below"),
    )


def root(state: DataFrame, nibbles: int | None = None) -> DataFrame:
    """One row: the root of the trie of all keys, whatever the number of nibbles that part it (by the number of keys if None, which counts them at once); an empty text for an empty state.

    The shards' roots meet nibble by nibble, sixteen at most in a group.
    """
    nibbles = nibbles or nibbles_for(state)
    rows = shards(state, nibbles)
    for n in range(nibbles, 0, -1):
        rows = _joined_shards(rows, n)
    return rows.agg(F.coalesce(F.max(merkle.sha256(F.concat_ws("|", "kind", "path", "below"))), F.lit("")).alias("root"))


def proved(state: DataFrame, nibbles: int | None = None) -> DataFrame:
    """(path, ok): each key's proof in its shard, checked against the shard's root and the value's digest. Shards are as for root()."""

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _trie(pdf)
        ok = [verify(t.prove(r), t.root, r) == (True, h) for r, h in zip(pdf["rest"], pdf["hash"], strict=True)]
        return pd.DataFrame({"path": pdf["shard"] + pdf["rest"], "ok": ok})

    return _parted(state, nibbles or nibbles_for(state)).groupBy("shard").applyInPandas(check, "path string, ok boolean")


def nodes(state: DataFrame, nibbles: int = 2) -> DataFrame:
    """(shard, top, node, kind, path, below): the nodes of the shards' tries as a table to be written; top marks a shard's root."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _trie(pdf)
        kinds, paths, below = zip(*t.nodes.values(), strict=True)
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "top": [n == t.root for n in t.nodes], "node": list(t.nodes), "kind": kinds, "path": paths, "below": [list(b) for b in below]})

    return _parted(state, nibbles).groupBy("shard").applyInPandas(build, "shard string, top boolean, node string, kind string, path string, below array<string>")


def read(stored: DataFrame, keys: DataFrame, nibbles: int = 2) -> DataFrame:
    """(addr, slot, hash): for each distinct key, the value's digest that the path from its shard's root leads to in stored nodes(); null if it leads nowhere. A shard's nodes and keys meet in one task."""

    def walk(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        at = {n: (k, p, b) for n, k, p, b in zip(held["node"], held["kind"], held["path"], held["below"], strict=True)}
        tops = held.loc[held["top"].astype(bool), "node"].tolist()

        def found(rest: str) -> str | None:
            digest = tops[0] if tops else ""
            while digest:
                kind, part, below = at[digest]
                if kind == "leaf":
                    return below[0] if part == rest else None
                if kind == "extension":
                    if not rest.startswith(part):
                        return None
                    digest, rest = below[0], rest[len(part) :]
                else:
                    digest, rest = below[int(rest[0], 16)], rest[1:]
            return None

        return asked[KEY].assign(hash=[found(r) for r in asked["rest"]])

    asked = keys.select(*KEY).distinct().select(*KEY, F.substring(path(), 1, nibbles).alias("shard"), F.substring(path(), nibbles + 1, 64).alias("rest"))
    kinds = ", ".join(f"{k} {keys.schema[k].dataType.simpleString()}" for k in KEY)
    return asked.groupBy("shard").cogroup(stored.groupBy("shard")).applyInPandas(walk, f"{kinds}, hash string")


def node_versions(changes: DataFrame, blocks: list[int], nibbles: int | None = None) -> DataFrame:
    """(node, kind, first_block, last_block, references): the nodes of the shards' tries of the snapshots at some blocks, and between which of these they are in use. Shards have two nibbles or, if None is given and they would be large, more."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _trie(pdf)
        return pd.DataFrame({"at": pdf["at"].iloc[0], "node": list(t.nodes), "kind": [n[0] for n in t.nodes.values()]})

    nibbles = nibbles or max(2, nibbles_for(changes.select(*KEY).distinct()))
    snapshots = None
    for b in blocks:
        s = _parted(as_of(changes, b), nibbles).withColumn("at", F.lit(b).cast("long"))
        snapshots = s if snapshots is None else snapshots.unionByName(s)
    nodes = snapshots.groupBy("at", "shard").applyInPandas(build, "at long, node string, kind string")
    return nodes.groupBy("node", "kind").agg(F.min("at").alias("first_block"), F.max("at").alias("last_block"), F.count("*").alias("references"))


def pruned(nodes: DataFrame, block: int) -> DataFrame:
    """Nodes that no snapshot from a block on uses: they can be deleted."""
    return nodes.where(F.col("last_block") < block)


def delta_pages(changes: DataFrame, nibbles: int = 2, every: int = 256) -> DataFrame:
    """Where each change lies if a page of the trie (a prefix of some nibbles) keeps its updates as deltas and is written as a whole each time: (addr, slot, block, page, base, delta).

    Updates are numbered over all pages at once, by ranges, and then from each page's first: no page has to fit into a
    task. Pages are 16 to the power of nibbles at most.
    """
    rows = positions(changes.select(*KEY, "block", F.substring(path(), 1, nibbles).alias("page")), ["page", "block", *KEY])
    first = rows.groupBy("page").agg(F.min("pos").alias("first"))
    first = F.broadcast(first) if nibbles <= 4 else first  # 65,536 rows
    return rows.join(first, "page").withColumn("n", F.col("pos") - F.col("first")).select(*KEY, "block", "page", F.floor(F.col("n") / every).alias("base"), (F.col("n") % every).alias("delta"))


def page_leaves(state: DataFrame, nibbles: int) -> DataFrame:
    """(tree, pos, hash, page, n_keys): a digest of the entries (addr, slot, value) of each page of a state, as leaves of a tree of 16 children a node, which merkle proves.

    Pages are prefixes of some nibbles, and a page's digests meet in one row: see nibbles_for(). The digest covers the
    page's prefix, so a page without keys needs no leaf.
    """
    rows = state.select(F.substring(path(), 1, nibbles).alias("page"), F.struct(path().alias("path"), merkle.leaf(*KEY, "value").alias("hash")).alias("entry"))
    pages = rows.groupBy("page").agg(F.count("*").alias("n_keys"), merkle.sha256(F.concat("page", merkle.joined(F.collect_list("entry")))).alias("hash"))
    return pages.select(F.lit(0).alias("tree"), F.conv("page", 16, 10).cast("long").alias("pos"), "hash", "page", "n_keys")
