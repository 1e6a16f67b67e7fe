"""Provenance with proofs: each key's versions as a content-defined tree, and the keys of a run as a Merkle tree."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from stratum.functions import chunked_tree
from stratum.functions.chunked_tree import ChunkedTree
from stratum.operators import merkle
from stratum.plans.scratch import positions
from stratum.schema import KEY

#: How nodes end, by name; fixed is after a number of entries.
CUTS = {"gear": chunked_tree.gear_cut, "polynomial": chunked_tree.polynomial_cut, "fixed": lambda fanout: None}


def _tree(blocks, values, cut: str, fanout: int, hashed: chunked_tree.Digest = chunked_tree.digest) -> ChunkedTree:  # noqa: ANN001
    return ChunkedTree([(int(b), str(v).encode()) for b, v in zip(blocks, values, strict=True)], CUTS[cut](fanout), fanout, hashed=hashed)


def _keyed(df: DataFrame) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in KEY)


def _by_key(changes: DataFrame, made, columns: str) -> DataFrame:  # noqa: ANN001
    """made(tree), a tuple of columns, for each key's tree of versions (block, value as a string).

    Rows are dealt and sorted by key, and a task walks its keys one after another: no group has an Arrow batch of its
    own. A key's history must fit into a task.
    """
    import pyarrow as pa

    schema = StructType([changes.schema[k] for k in KEY] + _parse(columns))
    names = [f.name for f in schema]

    def run(batches):  # noqa: ANN001, ANN202
        key, blocks, values, out = None, [], [], []
        kinds = None

        def flushed() -> pa.RecordBatch:
            rows, out[:] = list(zip(*out, strict=True)) if out else [()] * len(names), []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, batch.schema.field(1).type, *(f.type for f in arrow)]
            for addr, slot, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (addr, slot) != key and key is not None:
                    out.append((*key, *made(blocks, values)))
                    blocks, values = [], []
                    if len(out) >= 5000:
                        yield flushed()
                key = addr, slot
                blocks.append(block)
                values.append(value)
        if key is not None:
            out.append((*key, *made(blocks, values)))
            yield flushed()

    arrow = to_arrow_schema(StructType(_parse(columns)))
    rows = changes.select(*KEY, "block", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(run, schema)


def _parse(columns: str) -> list[StructField]:
    return list(StructType.fromDDL(columns))


def version_roots(changes: DataFrame, cut: str = "gear", fanout: int = 4, hashed: chunked_tree.Digest = chunked_tree.digest) -> DataFrame:
    """(addr, slot, root, n_versions, height) of each key's tree of versions. A null value counts as an empty one."""

    def made(blocks: list, values: list) -> tuple:
        tree = _tree(blocks, values, cut, fanout, hashed)
        return tree.root.hex(), len(blocks), tree.height

    return _by_key(changes, made, "root string, n_versions long, height int")


def prove(changes: DataFrame, low: int, high: int, cut: str = "gear", fanout: int = 4) -> DataFrame:
    """(addr, slot, root, n_versions, height, proof, proof_bytes): each key's versions from low to high, with what proves that they are all, and the root of all its versions, in one pass. proof_bytes counts the entries shown, 40 bytes each, and the digests."""

    def made(blocks: list, values: list) -> tuple:
        tree = _tree(blocks, values, cut, fanout)
        proof = tree.prove(low, high)
        return tree.root.hex(), len(blocks), tree.height, pickle.dumps(proof), proof.size() + 40 * len(proof.entries)

    return _by_key(changes, made, "root string, n_versions long, height int, proof binary, proof_bytes long")


def verify(proofs: DataFrame, roots: DataFrame | None, low: int, high: int) -> DataFrame:
    """(addr, slot, ok, n_found): whether each proof holds against the key's root, and how many versions it shows. Without roots, against the root that came with the proof."""

    def check(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            found = [chunked_tree.verify(pickle.loads(p), bytes.fromhex(r), low, high) for p, r in zip(pdf["proof"], pdf["root"], strict=True)]  # noqa: S301
            yield pdf[KEY].assign(ok=[f is not None for f in found], n_found=[len(f or ()) for f in found])

    rows = proofs if roots is None else proofs.drop("root").join(roots.select(*KEY, "root"), KEY)
    return rows.select(*KEY, "proof", "root").mapInPandas(check, f"{_keyed(proofs)}, ok boolean, n_found long")


def shown(proofs: DataFrame, low: int, high: int) -> DataFrame:
    """(addr, slot, block, value) of the versions that proofs (with their root) show, once each holds; a proof that does not hold shows none."""

    def check(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            found = [chunked_tree.verify(pickle.loads(p), bytes.fromhex(r), low, high) or [] for p, r in zip(pdf["proof"], pdf["root"], strict=True)]  # noqa: S301
            rows = [(*k, b, v.decode()) for k, entries in zip(zip(*(pdf[c] for c in KEY), strict=True), found, strict=True) for b, v in entries]
            yield pd.DataFrame(rows, columns=[*KEY, "block", "value"])

    return proofs.select(*KEY, "proof", "root").mapInPandas(check, f"{_keyed(proofs)}, block long, value string")


def merge_check(changes: DataFrame, block: int, cut: str = "gear", fanout: int = 4) -> DataFrame:
    """(addr, slot, n_versions, equal, made, whole): whether the tree of a key's versions up to a block, to which the later ones are added at its right spine, is the one of all at once; and how many nodes each of them made."""

    def check(blocks: list, values: list) -> tuple:
        n = sum(b <= block for b in blocks)
        both = _tree(blocks[:n], values[:n], cut, fanout).merged(_tree(blocks[n:], values[n:], cut, fanout))
        every = _tree(blocks, values, cut, fanout)
        return len(blocks), both.levels == every.levels and both.starts == every.starts, both.made, every.made

    return _by_key(changes, check, "n_versions long, equal boolean, made long, whole long")


def window_proofs(changes: DataFrame, head: int, sizes: list[int], cut: str = "gear", fanout: int = 4) -> DataFrame:
    """(addr, slot, window, n_found, proof_bytes, ok): each key's proof for the windows of these sizes that end at head, proved and checked in one pass."""

    def made(blocks: list, values: list) -> tuple:
        tree = _tree(blocks, values, cut, fanout)
        proofs = [tree.prove(head - w + 1, head) for w in sizes]
        found = [chunked_tree.verify(p, tree.root, head - w + 1, head) for p, w in zip(proofs, sizes, strict=True)]
        return [len(f or ()) for f in found], [p.size() + 40 * len(p.entries) for p in proofs], [f is not None for f in found]

    every = _by_key(changes, made, "n_found array<long>, proof_bytes array<long>, ok array<boolean>")
    rows = every.select(*KEY, F.explode(F.arrays_zip(F.array(*map(F.lit, sizes)).alias("window"), "n_found", "proof_bytes", "ok")).alias("x"))
    return rows.select(*KEY, F.col("x.window").alias("window"), "x.n_found", "x.proof_bytes", "x.ok")


def dense_prove(changes: DataFrame, low: int, high: int, cut: str = "gear", fanout: int = 4) -> DataFrame:
    """(addr, slot, root, low, high, proof): for each key, the stretches of blocks from low to high in which its value stays, each with a proof that no version lies between. It is the proof of each of the stretch's blocks."""

    def made(blocks: list, values: list) -> tuple:
        tree = _tree(blocks, values, cut, fanout)
        borders = [low, *(b for b in blocks if low < b <= high), high + 1]
        spans = [(a, b - 1) for a, b in zip(borders, borders[1:])]
        return tree.root.hex(), [a for a, _ in spans], [b for _, b in spans], [pickle.dumps(tree.prove(a, b)) for a, b in spans]

    every = _by_key(changes, made, "root string, low array<long>, high array<long>, proof array<binary>")
    return every.select(*KEY, "root", F.explode(F.arrays_zip("low", "high", "proof")).alias("x")).select(*KEY, "root", "x.low", "x.high", "x.proof")


def dense_shown(proofs: DataFrame) -> DataFrame:
    """(addr, slot, block, value, ok) for each block of the proofs' stretches: the value that the proof shows to hold, null before the key's first version or if the proof does not hold."""

    def check(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            values, holds = [], []
            for a, b, data, root in zip(pdf["low"], pdf["high"], pdf["proof"], pdf["root"], strict=True):
                proof = pickle.loads(data)  # noqa: S301
                inside = chunked_tree.verify(proof, bytes.fromhex(root), a, b)
                # A version after the stretch's first block would end the stretch.
                holds.append(inside is not None and all(k == a for k, _ in inside))
                held = [v for k, v in proof.entries if k <= a]
                values.append(held[-1].decode() if holds[-1] and held else None)
            yield pdf[[*KEY, "low", "high"]].assign(value=values, ok=holds)

    spans = proofs.select(*KEY, "low", "high", "proof", "root").mapInPandas(check, f"{_keyed(proofs)}, low long, high long, value string, ok boolean")
    return spans.select(*KEY, F.explode(F.sequence("low", "high")).alias("block"), "value", "ok")


def key_leaves(roots: DataFrame) -> DataFrame:
    """Leaves (tree, pos, hash, addr, slot) of the Merkle tree of all keys: a key's digest covers the root of its versions."""
    return positions(roots, KEY).select(F.lit(0).alias("tree"), "pos", merkle.leaf(*KEY, "root").alias("hash"), *KEY)


def absence(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """Probed keys that do not exist, with their neighbours; neighbours at adjacent positions prove the absence."""
    from stratum.operators.state import neighbours

    return neighbours(changes, probes).where("not exists")
