"""MinHash near-duplicate groups with odd sketches.

1. Each document becomes a set of word shingles, a MinHash sample in bands, and an odd sketch: the samples
   folded into a parity bitmap. Documents with equal sets are one class; only its smallest id goes on.
2. Classes that share a band's key are candidates. Equal buckets of several bands count once. First, each
   bucket's smallest id is held against the others, which makes one pair for a row: a large group of near
   copies collapses into one component here. Pairs whose sketches differ by more bits than a similarity at the
   threshold allows (but for a chance of 1e-9) go; the others are confirmed on the full sets.
3. Buckets that still hold several components are compared in blocks, inside the tasks: rows outside the
   component of the bucket's smallest id against all others. Again the XOR of the sketches filters and the
   full sets decide. Only links that join two components come out, never the pairs of a group.
4. The links' connected components are the groups.

So every pair that shares a band is tested, unless both are known to be in one group already: no candidate is
capped or dropped. With 40 bands of 5 rows, a pair at a similarity of 0.8 shares none with a chance of 1.3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import components, released, stored
from stratum.llm.shingles import Sketcher, WordCodes, digest, most_odd_bits, shingle_set

BANDS, ROWS, BITS = 40, 5, 512
#: A block of a bucket has about so many rows and shingles at most.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_000_000
#: Up to so many ids (16 MB as longs) are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_shingles (long), component_id (long) and kept (boolean).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of shingles of size
    words. component_id is the smallest id reachable by links, itself included; kept is id = component_id.
    Null and empty texts and texts of white space have an empty set and are linked with nothing. A row with a
    null id is linked with nothing, has a null component_id and is kept. Repeated rows come out as often as
    they go in; rows of one id with different texts are one document to links, but have rows and sets of their own.
    With text_hash, text_hash is xxhash64 of the text, to tell such rows apart. Other columns of docs are not read.
    """
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").cast("binary").alias("text"))
    hashed = texts.select("id", "text", F.xxhash64(F.col("text").cast("string")).alias("hash"))
    signed = stored(hashed.mapInArrow(_signatures(size), "id long, hash long, n long, digest binary, keys array<long>, sketch array<long>"), "signed")
    real = "n > 0 and id is not null"
    # Aggregates are stored before they are joined: a join of two plain tables can split the rows of a large class or bucket.
    classes = stored(signed.where(real).groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    own = signed.where(real).select("id", "hash", "n", "digest").join(classes, "digest")
    members = stored(own.select("id", "hash", "n", "rep").unionByName(signed.where(f"not ({real}) or id is null").select("id", "hash", "n", F.lit(None).cast("long").alias("rep"))), "members")
    first = classes.select(F.col("rep").alias("id"), "digest")
    reps = stored(signed.where(real).join(first, ["id", "digest"]).dropDuplicates(["id", "digest"]).select("id", "n", "keys", "sketch"), "reps")
    released(signed)

    buckets = reps.select("id", F.explode("keys").alias("key"))
    groups = buckets.groupBy("key").agg(F.count("*").alias("c"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y"), F.min("id").alias("pivot")).where("c > 1")
    groups = stored(groups.groupBy("c", "x", "y").agg(F.min("key").alias("key"), F.min("pivot").alias("pivot")), "buckets")
    shared = stored(buckets.join(groups.select("key", "pivot"), "key"), "shared")

    bits = most_odd_bits(BANDS * ROWS, BITS, percent)
    a, b = (reps.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in ("a", "b"))
    pairs = shared.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct().join(a, "a").join(b, "b")
    odd = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    pairs = stored(pairs.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (odd <= bits)).select("a", "b"), "pairs")
    released(reps)

    sets = stored(_sets(texts, shared.select("id").distinct(), size), "sets")
    a, b = (sets.select(F.col("id").alias(k), F.col("codes").alias(f"codes_{k}")) for k in ("a", "b"))
    links = stored(pairs.join(a, "a").join(b, "b").mapInArrow(_confirmed(percent), "a long, b long"), "links")
    more = _across(shared, sets, stored(components(links), "components"), percent, bits)
    links = stored(links.unionByName(more), "links")
    released(sets)
    released(shared)
    found = stored(components(links), "components").withColumnRenamed("node", "rep")
    out = members.join(found, "rep", "left").withColumn("component_id", F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), *([F.col("hash").alias("text_hash")] if text_hash else []))


def _signatures(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sketcher = WordCodes(), Sketcher(BANDS, ROWS, BITS)
        for batch in batches:
            n, digests, keys, sketches = [], [], [], []
            for value in batch.column(1):
                found = shingle_set(codes.of(value.as_py()), size)
                n.append(len(found))
                if len(found):
                    samples = sketcher.samples(found)
                    digests.append(digest(found))
                    keys.append(sketcher.keys(samples))
                    sketches.append(sketcher.odd(samples))
                else:
                    digests.append(None)
                    keys.append([])
                    sketches.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["id", "hash", "n", "digest", "keys", "sketch"])

    return run


def _sets(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, n, sketch, codes) of the documents with these ids; codes are the set's 64-bit numbers in order, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sketcher = WordCodes(), Sketcher(BANDS, ROWS, BITS)
        for batch in batches:
            n, sketches, codes = [], [], []
            for value in batch.column(1):
                found = shingle_set(words.of(value.as_py()), size)
                n.append(len(found))
                sketches.append(sketcher.odd(sketcher.samples(found)).tobytes())
                codes.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sketches, pa.binary()), pa.array(codes, pa.binary())], ["id", "n", "sketch", "codes"])

    ids = stored(ids, "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return texts.join(wanted, "id", "left_semi").mapInArrow(run, "id long, n long, sketch binary, codes binary").dropDuplicates(["id", "codes"])


def _confirmed(percent: int):  # noqa: ANN202
    """Of rows (b, a, codes_a, codes_b), the pairs that are linked by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            x, y, cx, cy = (batch.column(batch.schema.get_field_index(k)) for k in ("a", "b", "codes_a", "codes_b"))
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (cx, cy))
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    left.append(x[i].as_py())
                    right.append(y[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _across(shared: DataFrame, sets: DataFrame, found: DataFrame, percent: int, bits: int) -> DataFrame:
    """Links (a, b) between the components found so far, for each bucket that holds rows of several."""
    rows = shared.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "pivot", F.coalesce("component", "id").alias("comp"))
    several = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.when(F.col("id") == F.col("pivot"), F.col("comp"))).alias("main")).where("low <> high")
    several = stored(several, "several")
    rows = rows.join(several.select("key", "main"), "key").join(sets.select("id", "n"), "id").select("key", "id", "comp", "n", (F.col("comp") != F.col("main")).alias("out"))
    rows = stored(rows, "mixed")
    out = F.col("out").cast("long")
    blocks = lambda c, n: F.greatest(F.ceil(c / BLOCK_ROWS), F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sizes = stored(rows.groupBy("key").agg(blocks(F.sum(out), F.sum(out * F.col("n"))).alias("g_out"), blocks(F.sum(1 - out), F.sum((1 - out) * F.col("n"))).alias("g_in"), F.sum(out).alias("c_out")), "sizes")
    # A unit is a block of outside rows (side 0) against a block of inside rows (side 1), or against one of outside rows.
    unit = lambda kind, i, j, side: F.struct(F.xxhash64("key", F.lit(kind), i, j).alias("unit"), side.cast("int").alias("side"))
    me = F.col("block")
    cross = F.transform(F.sequence(F.lit(0), F.col("g_in") - 1), lambda j: unit(0, me, j, F.lit(0)))
    among = F.transform(F.sequence(F.lit(0), F.col("g_out") - 1), lambda j: unit(1, F.least(me, j), F.greatest(me, j), me > j))
    inside = F.transform(F.sequence(F.lit(0), F.col("g_out") - 1), lambda i: unit(0, i, me, F.lit(1)))
    rows = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("out"), F.col("g_out")).otherwise(F.col("g_in"))).cast("int"))
    units = F.when(F.col("out"), F.when(F.col("c_out") > 1, F.concat(cross, among)).otherwise(cross)).otherwise(inside)
    rows = rows.select("id", "comp", F.explode(units).alias("u")).select("u.unit", "u.side", "id", "comp").distinct()
    full = rows.join(sets, "id").select("unit", "side", "id", "comp", "n", "sketch", "codes")
    return full.repartition("unit").sortWithinPartitions("unit").mapInArrow(_linked_units(percent, bits), "a long, b long")


def _linked_units(percent: int, bits: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for row in zip(*(batch.column(k) for k in range(7))):
                u = row[0].as_py()
                if u != unit:
                    edges += _links(rows, percent, bits)
                    unit, rows = u, []
                rows.append((row[1].as_py(), row[2].as_py(), row[3].as_py(), row[4].as_py(), row[5].as_py(), np.frombuffer(row[6].as_py(), np.uint64)))
            yield _edge_batch(edges)
        yield _edge_batch(_links(rows, percent, bits))

    return run


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])


def _links(rows: list[tuple], percent: int, bits: int) -> list[tuple[int, int]]:
    """Links that join components: of rows (side, id, comp, n, sketch, codes), side 0 against side 1, or side 0 among itself."""
    left = [r for r in rows if r[0] == 0]
    right = [r for r in rows if r[0] == 1]
    alone = not right
    right = right or left
    if not left or len({r[2] for r in rows}) < 2:
        return []
    ns, ms = (np.array([r[3] for r in side], np.int64) for side in (left, right))
    comps, others = (np.array([r[2] for r in side], np.int64) for side in (left, right))
    sketches, theirs = (np.frombuffer(b"".join(r[4] for r in side), np.uint64).reshape(len(side), -1) for side in (left, right))
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while c in parent:
            c = parent[c]
        return c

    places = None
    edges = []
    for i in range(len(left)):
        maybe = (comps[i] != others) & (100 * np.minimum(ns[i], ms) >= percent * np.maximum(ns[i], ms))
        if alone:
            maybe[: i + 1] = False
        maybe &= np.bitwise_count(sketches[i] ^ theirs).sum(axis=1) <= bits
        hits = [int(j) for j in np.flatnonzero(maybe) if root(int(comps[i])) != root(int(others[j]))]
        if not hits:
            continue
        if places is None:  # codes as small numbers, so that membership is a look into a table
            sizes = [len(r[5]) for r in left] + [len(r[5]) for r in right]
            values, places = np.unique(np.concatenate([r[5] for r in left] + [r[5] for r in right]), return_inverse=True)
            ends = np.cumsum([0, *sizes])
            seen = np.zeros(len(values), np.int64)
            first = ends[len(left)]
        mine = places[ends[i] : ends[i + 1]]
        seen[mine] = 1
        common = np.add.reduceat(seen[places[first:]], ends[len(left) : -1] - first)
        seen[mine] = 0
        for j in hits:
            if 100 * common[j] >= percent * (ns[i] + ms[j] - common[j]):
                p, q = root(int(comps[i])), root(int(others[j]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    edges.append((left[i][1], right[j][1]))
    return edges
