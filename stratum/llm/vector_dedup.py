"""Embedding near-duplicates by randomised-rotation binary codes.

1. Each unit vector is turned by several random rotations; its code are the signs, with a correction factor for
   each rotation: the inner product of the turned vector and its code, as a unit vector. Equal vectors of a label
   are one class from here on.
2. Bands of the code's bits are keys. Classes of a label that share a key are candidates. With 60 bands of 20
   bits, two vectors at a cosine of 0.98 share none with a chance of 8e-9.
3. Buckets are compared in blocks inside the tasks. A turned vector against a code, over the correction factor,
   estimates the inner product without bias; the mean over the rotations and its confidence bound decide which
   pairs are computed again exactly, in double precision. Each pair counts in the first band that it shares, so
   links can be added up from the blocks: no task puts out pairs, only counts and a tree of each block's links.
4. The trees' connected components are the groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import components, released, stored

BANDS, BITS = 60, 20
#: Rows of a block.
BLOCK = 256
#: Width of the confidence bound, in standard errors of the estimate.
WIDTH = 6.0
SEED = 11


@lru_cache(maxsize=8)
def rotations(dim: int) -> np.ndarray:
    """Random rotations under each other, enough for all bands: (rotations * dim, dim)."""
    rng = np.random.default_rng([SEED, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-BANDS * BITS // dim))])


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (rows, bits) and correction factors (rows, rotations) of unit vectors."""
    dim = unit.shape[1]
    turned = unit @ rotations(dim).T
    return turned >= 0, np.abs(turned).reshape(len(unit), -1, dim).sum(axis=2) / math.sqrt(dim)


def estimated(unit: np.ndarray, signs: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of unit vectors (rows) and coded vectors (columns), and the bound of each column's error."""
    dim = unit.shape[1]
    turns = signs.shape[1] // dim
    weight = np.repeat(1 / (factors * math.sqrt(dim) * turns), dim, axis=1)
    codes = np.where(signs, weight, -weight).astype(np.float32)
    turned = (unit @ rotations(dim).T).astype(np.float32)
    bound = WIDTH * np.sqrt(((1 - factors**2).clip(0) / factors**2).mean(axis=1) / (max(1, dim - 1) * turns)) + 1e-4
    return turned @ codes.T, bound


def band_keys(signs: np.ndarray) -> np.ndarray:
    return signs[:, : BANDS * BITS].reshape(len(signs), BANDS, BITS) @ (1 << np.arange(BITS))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id (long) and kept (boolean).

    Vectors of the same label (not null) and dimension are linked if their cosine in double precision reaches
    cosine. n_links counts other rows linked directly, copies included; component_id is the smallest id reachable,
    itself included. Vectors that are null, empty or zero, or hold null or non-finite components, and rows
    without a label or id, are linked with nothing. A row without an id has a null component_id and is kept.
    Repeated rows are vectors of their own. Other columns are not read.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    coded_rows = stored(rows.mapInArrow(_coded, "id long, label string, vec binary, digest binary"), "coded")
    real = "digest is not null and id is not null and label is not null"
    # Aggregates are stored before they are joined: a join of two plain tables can split the rows of a large class or bucket.
    classes = stored(coded_rows.where(real).groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("mult")), "classes")
    own = coded_rows.where(real).select("id", "label", "digest").join(classes, ["label", "digest"])
    members = stored(own.select("id", "rep", "mult").unionByName(coded_rows.where(f"not ({real}) or ({real}) is null").select("id", F.lit(None).cast("long").alias("rep"), F.lit(1).cast("long").alias("mult"))), "members")
    first = classes.select(F.col("rep").alias("id"), "label", "digest", "mult")
    reps = stored(coded_rows.where(real).join(first, ["id", "label", "digest"]).dropDuplicates(["id", "label", "digest"]).select("id", "label", "mult", "vec").mapInArrow(_keyed, "id long, label string, mult long, vec binary, bits binary, factors binary, keys array<int>"), "reps")
    released(coded_rows)

    buckets = reps.select("id", F.octet_length("vec").alias("dim"), "label", F.posexplode("keys").alias("band", "part"))
    buckets = buckets.select("id", "band", F.xxhash64("label", "dim", "band", "part").alias("key"))
    groups = buckets.groupBy("key").agg(F.count("*").alias("c"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y"), F.min("band").alias("band")).where("c > 1")
    # Of buckets with the same classes, the first band's is enough: a pair counts in the first band that it shares.
    groups = groups.groupBy("c", "x", "y").agg(F.min(F.struct("band", "key")).alias("first")).select("first.key", "first.band", F.ceil(F.col("c") / BLOCK).cast("int").alias("g"))
    groups = stored(groups, "buckets")
    shared = buckets.select("id", "key").join(groups, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    me = F.col("block")
    unit = lambda j: F.struct(F.xxhash64("key", F.least(me, j), F.greatest(me, j)).alias("unit"), (me > j).cast("int").alias("side"), (me == j).alias("alone"))
    units = shared.select("id", "band", F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), unit)).alias("u")).select("u.*", "band", "id")
    full = units.join(reps.select("id", "mult", "vec", "bits", "factors"), "id").select("unit", "side", "alone", "band", "id", "mult", "vec", "bits", "factors")
    found = stored(full.repartition("unit").sortWithinPartitions("unit").mapInArrow(_compared(cosine), "id long, links long, near long"), "links")
    released(reps)
    links = stored(found.groupBy("id").agg(F.sum("links").alias("links")), "counts")
    groups = stored(components(found.where("near is not null").select(F.col("id").alias("a"), F.col("near").alias("b"))), "components")
    out = members.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, with a digest; null where a vector can't be linked."""
    for batch in batches:
        vectors, digests = [], []
        for value in batch.column(2):
            vec = np.array([math.nan if x is None else x for x in value.as_py()], np.float64) if value.is_valid else np.zeros(0)
            good = len(vec) > 0 and bool(np.isfinite(vec).all()) and bool((vec != 0).any())
            data = vec.tobytes() if good else None
            vectors.append(data)
            digests.append(hashlib.blake2b(data, digest_size=16).digest() if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary()), pa.array(digests, pa.binary())], ["id", "label", "vec", "digest"])


def _units(vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one dimension, and the same at length 1. Scaling by the largest component first keeps squares in range."""
    v = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    s = v / np.abs(v).max(axis=1, keepdims=True)
    return v, s / np.sqrt((s * s).sum(axis=1, keepdims=True))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column(3).to_pylist()
        sizes = np.array([len(d) for d in data])
        bits, factors, keys = ([None] * len(data) for _ in range(3))
        for size in set(sizes.tolist()):
            at = np.flatnonzero(sizes == size)
            signs, f = coded(_units([data[i] for i in at])[1])
            packed, k = np.packbits(signs, axis=1), band_keys(signs)
            for j, i in enumerate(at):
                bits[i], factors[i], keys[i] = packed[j].tobytes(), f[j].astype(np.float32).tobytes(), k[j]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.binary()), pa.array(factors, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], ["id", "label", "mult", "vec", "bits", "factors", "keys"])


def _compared(cosine: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    out += _linked(rows, cosine)
                    last, rows = row[0], []
                rows.append(row)
            yield _found(out)
        yield _found(_linked(rows, cosine))

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["id", "links", "near"])


def _linked(rows: list[tuple], cosine: float) -> list[tuple]:
    """(id, links, near) of one unit's rows (unit, side, alone, band, id, mult, vec, bits, factors): the weight of its links here, and a neighbour in a tree of them."""
    if len(rows) < 2:
        return []
    left = [r for r in rows if r[1] == 0]
    right = [r for r in rows if r[1] == 1]
    alone = rows[0][2]
    if not alone and not (left and right):
        return []
    right = left if alone else right
    band = rows[0][3]
    x, ux = _units([r[6] for r in left])
    y, uy = (x, ux) if alone else _units([r[6] for r in right])
    n_bits = len(rotations(x.shape[1]))
    signs = lambda side: np.unpackbits(np.frombuffer(b"".join(r[7] for r in side), np.uint8).reshape(len(side), -1), axis=1)[:, :n_bits].astype(bool)
    theirs = signs(right)
    factors = np.frombuffer(b"".join(r[8] for r in right), np.float32).reshape(len(right), -1).astype(np.float64)
    estimate, bound = estimated(ux, theirs, factors)
    i, j = np.nonzero(estimate + bound >= cosine)
    if alone:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return []
    k, m = band_keys(theirs if alone else signs(left)), band_keys(theirs)
    out: list[tuple] = []
    ids, others = np.array([r[4] for r in left]), np.array([r[4] for r in right])
    mine, their = np.array([r[5] for r in left], np.int64), np.array([r[5] for r in right], np.int64)
    links, back = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    near: dict[int, int] = {}

    def root(a: int) -> int:
        while a in near:
            a = near[a]
        return a

    for s in range(0, len(i), 50_000):
        p, q = i[s : s + 50_000], j[s : s + 50_000]
        first = (k[p] == m[q]).argmax(axis=1) == band
        p, q = p[first], q[first]
        exact = (x[p] * y[q]).sum(axis=1) / (np.sqrt((x[p] ** 2).sum(axis=1)) * np.sqrt((y[q] ** 2).sum(axis=1)))
        hit = exact >= cosine
        p, q = p[hit], q[hit]
        np.add.at(links, p, their[q])
        np.add.at(back, q, mine[p])
        for a, b in zip(ids[p].tolist(), others[q].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                near[max(a, b)] = min(a, b)
    for side, count in ((ids, links), (others, back)):
        out += [(int(a), int(n), near.get(int(a))) for a, n in zip(side, count, strict=True) if n]
    return out
