"""Trees, filters, models, tries and their proofs: invariants, and every tampering is found."""

from __future__ import annotations

import random
from fractions import Fraction
from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratum.functions import bloom, chunked_tree, hashing, learned, patricia
from stratum.functions.chunked_tree import ChunkedTree, verify
from stratum.operators import lookup, lsm, merkle, provenance, run_proofs, trie

CUTS = [None, chunked_tree.gear_cut(4), chunked_tree.polynomial_cut(4)]


def entries(n, seed=1, step=2):
    rng = random.Random(seed)
    return [(i * step, rng.randbytes(32)) for i in range(1, n + 1)]


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 999])
def test_every_range_is_proved(cut, n):
    data = entries(n)
    tree = ChunkedTree(data, cut)
    rng = random.Random(n)
    for _ in range(40):
        low = rng.randint(-2, 2 * n + 4)
        high = low + rng.choice([0, 1, 5, 50])
        assert verify(tree.prove(low, high), tree.root, low, high) == [e for e in data if low <= e[0] <= high]


@pytest.mark.parametrize("cut", CUTS[1:])
def test_trees_do_not_depend_on_how_entries_came(cut):
    data = entries(999)
    whole = ChunkedTree(data, cut)
    assert ChunkedTree(data[:567], cut).merged(ChunkedTree(data[567:], cut)).root == whole.root
    shuffled = random.Random(2).sample(data, len(data))
    assert ChunkedTree(shuffled, cut).root == whole.root
    assert whole.without([k for k, _ in data[500:]]).root == ChunkedTree(data[:500], cut).root
    assert 2 <= whole.height <= 10


@pytest.mark.parametrize("cut", CUTS)
def test_trees_grow_at_their_right_spine(cut):
    data = entries(999)
    tree, made = ChunkedTree([], cut), 0
    for k in range(0, 999, 37):
        tree = tree.updated(data[k : k + 37])
        made += tree.made
        whole = ChunkedTree(data[: k + 37], cut)
        assert tree.levels == whole.levels and tree.starts == whole.starts
    assert made < 27 * whole.made / 4, "each step makes the nodes of its entries and of the spine only"
    changed = tree.updated([(data[700][0], b"new"), (data[701][0] + 1, b"more")], [data[3][0]])
    other = dict(data) | {data[700][0]: b"new", data[701][0] + 1: b"more"}
    other.pop(data[3][0])
    assert changed.root == ChunkedTree(list(other.items()), cut).root
    assert tree.lower_bound(-5) == 0 and tree.lower_bound(data[9][0]) == 9 and tree.lower_bound(data[9][0] + 1) == 10 and tree.lower_bound(10**9) == 998
    assert tree.newest() == data[-1] and ChunkedTree([]).newest() is None


@pytest.mark.parametrize("cut", CUTS)
def test_tampering_is_found(cut):
    data = entries(60)
    tree = ChunkedTree(data, cut)
    proof = tree.prove(40, 50)
    assert verify(proof, tree.root, 40, 50)
    for i in range(len(proof.entries)):
        k, v = proof.entries[i]
        for bad in ((k, bytes([v[0] ^ 1]) + v[1:]), (k + 1, v)):
            assert verify(replace(proof, entries=(*proof.entries[:i], bad, *proof.entries[i + 1 :])), tree.root, 40, 50) is None
        assert verify(replace(proof, entries=(*proof.entries[:i], *proof.entries[i + 1 :])), tree.root, 40, 50) is None
    for i, (left, right, cuts) in enumerate(proof.levels):
        for side in (0, 1):
            for j in range(len((left, right)[side])):
                both = [list(left), list(right)]
                key, d = both[side][j]
                both[side][j] = (key, bytes([d[0] ^ 1]) + d[1:])
                bad = (tuple(both[0]), tuple(both[1]), cuts)
                assert verify(replace(proof, levels=(*proof.levels[:i], bad, *proof.levels[i + 1 :])), tree.root, 40, 50) is None
    assert verify(proof, chunked_tree.digest(b"other"), 40, 50) is None
    assert verify(proof, tree.root, 20, 50) is None, "a proof of a smaller range does not prove a larger one"


def test_filters_have_no_false_negatives_and_grow():
    f = bloom.BloomFilter(0.05, 100)
    keys = [f"k{i}".encode() for i in range(3000)]
    f.update(keys)
    assert all(k in f for k in keys) and f.total_capacity >= len(f) > 2500 and len(f.slices) > 3
    assert sum(f"x{i}".encode() in f for i in range(5000)) / 5000 < 0.1
    again = bloom.BloomFilter.from_bytes(f.to_bytes())
    assert all(k in again for k in keys) and again.memory == f.memory and not again.add(keys[0])
    f.clear()
    assert len(f) == 0 and keys[0] not in f


@pytest.mark.parametrize("epsilon", [1, 8, 23])
def test_models_keep_their_error(epsilon):
    rng = random.Random(epsilon)
    keys = sorted({rng.getrandbits(448) for _ in range(2000)} | {int(1.01**i) for i in range(800)})
    points = [(k, i) for i, k in enumerate(keys)]
    model = learned.Model(learned.fit(points, epsilon))
    assert max(abs(model.predict(k) - i) for k, i in points) <= epsilon + 1
    assert len(model.segments) < len(points) / 2
    assert len(learned.levels(points, 1)[-1]) <= 53
    assert learned.fit([], 1) == [] and learned.fit([(5, 0), (5, 1)], 1)[0].start == 5


def test_models_have_the_fewest_segments():
    rng = random.Random(6)
    for epsilon in (1, 3):
        points, x = [], 0
        for y in range(120):
            x += rng.choice([1, 1, 2, 9])
            points.append((x, y))

        def fits(part, e=epsilon):
            pairs = [(a, b) for i, a in enumerate(part) for b in part[i + 1 :]]
            low = max((Fraction(b[1] - a[1] - 2 * e, b[0] - a[0]) for a, b in pairs), default=0)
            return low <= min((Fraction(b[1] - a[1] + 2 * e, b[0] - a[0]) for a, b in pairs), default=0)

        expected, begin = 0, 0
        while begin < len(points):
            end = begin + 1
            while end < len(points) and fits(points[begin : end + 1]):
                end += 1
            expected, begin = expected + 1, end
        segments = learned.fit(points, epsilon)
        assert len(segments) == expected
        assert max(abs(learned.Model(segments).predict(x) - y) for x, y in points) <= epsilon


def test_trie_proofs():
    rng = random.Random(3)
    leaves = {f"{rng.getrandbits(64):016x}": f"v{i}" for i in range(500)}
    t = patricia.Trie(leaves)
    for p, v in leaves.items():
        proof = t.prove(p)
        assert patricia.verify(proof, t.root, p) == (True, v)
        kind, part, below = proof[-1]
        assert patricia.verify([*proof[:-1], (kind, part, ("other",))], t.root, p) == (False, None)
    for _ in range(100):
        p = f"{rng.getrandbits(64):016x}"
        assert patricia.verify(t.prove(p), t.root, p) == (True, leaves.get(p))
        assert not t.prove(p) or patricia.verify(t.prove(p)[:-1], t.root, p)[0] is False
    assert patricia.Trie(dict(reversed(leaves.items()))).root == t.root and patricia.Trie({}).prove("ab") == []


@pytest.fixture(scope="module")
def changes(spark):
    rng = random.Random(5)
    rows = {(rng.randint(1, 20), rng.choice("ab"), rng.randint(1, 60)) for _ in range(500)}
    return spark.createDataFrame([(a, s, b, f"v{a}{b}") for a, s, b in rows], "addr long, slot string, block long, value string").cache()


def test_merkle_trees_of_many_sizes(spark):
    leaves = spark.createDataFrame([(t, i, f"h{t}.{i}") for t in range(1, 40, 3) for i in range(t)], "tree long, pos long, hash string")
    proofs = merkle.proofs(leaves, 4)
    good = merkle.verified(proofs, merkle.roots(leaves, 4))
    assert good.where("ok").count() == leaves.count()
    assert merkle.verified(proofs.withColumn("hash", F.concat("hash", F.lit("x"))), merkle.roots(leaves, 4)).where("ok").count() == 0
    assert proofs.select(merkle.proof_bytes(F.col("path")).alias("n")).agg(F.max("n")).first()[0] > 0


def test_merkle_ranges(spark):
    leaves = spark.createDataFrame([(t, i, f"h{t}.{i}") for t in (1, 5, 23) for i in range(t)], "tree long, pos long, hash string")
    ranges = spark.createDataFrame([(t, a, b) for t in (1, 5, 23) for a in range(t) for b in range(a, t + 2, 3)], "tree long, low long, high long")
    made = merkle.levels(leaves, 4)
    found = merkle.range_proofs(made, ranges, 4).join(merkle.roots(leaves, 4, made=made), "tree").cache()
    ok = merkle.range_root(F.col("hashes"), F.col("path"), 4) == F.col("root")
    assert found.count() == ranges.count() and found.where(~ok).count() == 0
    assert all(list(r.hashes) == [f"h{r.tree}.{i}" for i in range(r.low, min(r.high + 1, r.tree))] for r in found.collect())
    forged = found.withColumn("hashes", F.transform("hashes", lambda h, k: F.when(k == F.size("hashes") - 1, F.lit("x")).otherwise(h)))
    assert forged.where(ok).count() == 0 and found.where("size(hashes) > 1").withColumn("hashes", F.slice("hashes", 1, F.size("hashes") - 1)).where(ok).count() == 0


def test_leaves_of_unlike_rows_differ(spark):
    rows = spark.createDataFrame([("a|b", "c", "x"), ("a", "b|c", "x"), ("a", None, "b"), ("a", "b", None), ("", "ab", ""), ("a:", "1:b", "-"), ("-", None, None), (None, "-", None)], "addr string, slot string, value string")
    assert rows.select(merkle.leaf("addr", "slot", "value").alias("d")).distinct().count() == 8
    assert trie.proved(rows.select("addr", "slot", F.coalesce("value", F.lit("")).alias("value"))).where("not ok").count() == 0


def test_lookups_by_filters_and_models(spark, changes):
    placed = lsm.with_runs(changes, 20, 3).cache()
    missing = spark.createDataFrame([(a, s) for a in range(30, 60) for s in "ab"], "addr long, slot string")
    for part_rows in (7, 200_000):
        parted = lookup.dealt(placed, part_rows).cache()
        built = lookup.index(parted, 0.05, 2).cache()
        found = lookup.lookup(parted, built, changes.select("addr", "slot").unionByName(missing)).cache()
        ages = {(r.level, r.run): r.age for r in lsm.newest_first(placed).collect()}
        expected = {}
        for r in placed.collect():
            k = (r.addr, r.slot)
            if k not in expected or (ages[r.level, r.run], -r.block) < (ages[expected[k].level, expected[k].run], -expected[k].block):
                expected[k] = r
        got = {(r.addr, r.slot): r for r in found.collect()}
        assert len(got) == len(expected) + 60
        assert all((got[k].level, got[k].run, got[k].block, got[k].value) == (e.level, e.run, e.block, e.value) for k, e in expected.items())
        assert all(r.block is None and r.value is None and r.level is None for k, r in got.items() if k not in expected)
        assert all(r.searched - r.wasted == (r.block is not None) for r in got.values())
        visited = {(r.addr, r.slot): r.probed for r in lsm.runs_visited(placed).collect()}
        assert all(1 <= got[k].searched <= visited[k] for k in expected) and sum(got[k].searched for k in expected) < sum(visited.values())
        assert sum(r.wasted for r in got.values()) < 0.15 * (60 * len(ages) + sum(visited.values()))


def test_tries_share_nodes_and_delete_unused_ones():
    rng = random.Random(8)
    paths = [f"{rng.getrandbits(32):08x}" for _ in range(150)] + [f"abcdef{i:02x}" for i in range(40)]
    t, leaves, roots = patricia.VersionedTrie(), {}, [""]
    states = []
    for v in range(12):
        block = {p: f"v{v}" for p in rng.sample(paths, 25)}
        roots.append(t.update(roots[-1], block))
        leaves |= block
        states.append(dict(leaves))
        assert roots[-1] == patricia.Trie(leaves).root
    for root, old in zip(roots[1:], states, strict=True):
        p = rng.choice(list(old))
        assert set(patricia.Trie(old).nodes) <= set(t.nodes) and patricia.verify(patricia.Trie(old).prove(p), root, p) == (True, old[p])
    for i, root in enumerate(roots[1:-1]):
        t.release(root)
        assert set(t.nodes) == set().union(*(patricia.Trie(s).nodes for s in states[i + 1 :]))
    assert t.update(roots[-1], {}) == roots[-1]
    t.release(roots[-1])
    t.release(roots[-1])
    assert not t.nodes and not t.references and t.update("", {}) == ""


def test_run_proofs_hold_and_forged_ones_do_not(changes):
    placed = lsm.with_runs(changes, 40, 3).cache()
    runs = run_proofs.Runs(placed, 4, 0.05)
    keys = changes.select("addr", "slot").distinct()
    probes = keys.unionByName(keys.withColumn("addr", F.col("addr") + 50))
    proofs, digests = runs.prove(probes, 10, 30).cache(), runs.digests().cache()
    found = run_proofs.Runs.verify(proofs, digests, 10, 30).cache()
    n_runs = placed.select("level", "run").distinct().count()
    assert found.count() == probes.distinct().count() * n_runs and found.where("not ok").count() == 0
    assert found.agg(F.sum("n_found")).first()[0] == changes.where("block between 10 and 30").count()
    assert proofs.where("filter is not null").count() > 0 and proofs.where("rows is not null").count() > 0
    bad = lambda df: run_proofs.Runs.verify(df, digests, 10, 30).where("ok").count()
    shown = proofs.where("size(rows) > 2")
    assert shown.count() > 20
    assert bad(shown.withColumn("rows", F.filter("rows", lambda r, i: i != 1))) == 0, "a row is left out"
    assert bad(shown.withColumn("rows", F.transform("rows", lambda r, i: F.when(i == 1, r.withField("value", F.lit("x"))).otherwise(r)))) == 0
    assert bad(proofs.where("filter is not null").join(keys, ["addr", "slot"], "left_semi").withColumn("run", F.col("run") * 0 + 99)) == 0
    held = placed.select("addr", "slot", "level", "run").distinct()
    forged = proofs.where("rows is not null").join(held, ["addr", "slot", "level", "run"], "left_semi").withColumns({"rows": F.lit(None).cast(proofs.schema["rows"].dataType), "part": F.lit(0)}).drop("filter").join(runs.index.where("part = 0").select("level", "run", "filter"), ["level", "run"])
    assert forged.count() > 0 and bad(forged) == 0, "a filter that has the key excludes nothing"
    wider = run_proofs.Runs.verify(proofs.where("rows is not null"), digests, 5, 45)
    assert wider.where("ok").count() < wider.count(), "proofs of a range do not all prove a larger one"


def test_run_proofs_share_filters_and_blocks(changes, monkeypatch):
    monkeypatch.setattr(run_proofs, "PART_KEYS", 6, raising=False)
    monkeypatch.setattr(run_proofs, "BLOCK_ROWS", 4, raising=False)
    placed = lsm.with_runs(changes, 40, 3).cache()
    runs = run_proofs.Runs(placed, 4, 0.05)
    place = F.row_number().over(Window.partitionBy("level", "run").orderBy("addr", "slot", "block")) - 1
    leaves = placed.select(F.concat_ws("/", "level", "run").alias("tree"), place.cast("long").alias("pos"), merkle.leaf("addr", "slot", "block", "value").alias("hash"))
    digests = runs.digests().cache()
    assert {(f"{r.level}/{r.run}", r.root) for r in digests.collect()} == {(r.tree, r.root) for r in merkle.roots(leaves, 4).collect()}, "blocks change no root"
    keys = changes.select("addr", "slot").distinct()
    probes = keys.unionByName(keys.withColumn("addr", F.col("addr") + 50))
    proofs = runs.prove(probes, 1, 60, shared=True).cache()
    verify = lambda p, shared=runs.index: run_proofs.Runs.verify(p, digests, 1, 60, 4, shared)
    found = verify(proofs).cache()
    assert proofs.where("filter is not null").count() == 0 and proofs.where("rows is null").count() > 100, "no proof has a copy of a filter"
    assert proofs.where("size(rows) > 4").count() > 0, "some rows are of several blocks"
    assert found.count() == probes.count() * digests.count() and found.where("not ok").count() == 0
    assert found.agg(F.sum("n_found")).first()[0] == changes.count()
    whole = run_proofs.Runs.verify(runs.prove(probes, 1, 60), digests, 1, 60)
    assert found.exceptAll(whole).count() == whole.exceptAll(found).count() == 0
    # A key that a run holds is not excluded: by no name of a part, by no other part's filter, by no filter that the run is not committed to.
    held = placed.select("addr", "slot", "level", "run").distinct()
    parts = runs.index.select("level", "run", F.col("part"))
    kinds = proofs.schema
    claim = held.join(parts, ["level", "run"]).select("addr", "slot", "level", "run", "part", F.lit(None).cast("binary").alias("filter"), F.lit(None).cast(kinds["rows"].dataType).alias("rows"), F.lit(None).cast(kinds["path"].dataType).alias("path"))
    assert runs.index.agg(F.max("parts")).first()[0] > 1 and claim.count() > 0
    assert verify(claim).where("ok").count() == 0
    assert verify(claim.drop("filter").join(runs.index.select("level", "run", "part", "filter"), ["level", "run", "part"])).where("ok").count() == 0
    assert verify(claim, runs.index.withColumn("filter", F.lit(bloom.BloomFilter(0.05, 64).to_bytes()))).where("ok").count() == 0


def test_bloom_answers_many_keys_at_once():
    f = bloom.BloomFilter(0.1, 20).update(b"k%d" % i for i in range(100))
    keys = [b"k%d" % i for i in range(2000)]
    assert f.contains_all(keys).tolist() == [k in f for k in keys] and f.contains_all([]).tolist() == []


def test_blake2b_equals_the_library(spark, changes):
    import hashlib

    got = changes.select("value", hashing.blake2b("value").alias("d")).collect()
    assert all(r.d == hashlib.blake2b(r.value.encode(), digest_size=32).hexdigest() for r in got)
    v = hashing.uint256
    r = spark.range(1).select(F.hex(hashing.uint256_sub(v(F.lit(0)), v(F.lit(1)))).alias("a"), F.hex(hashing.uint256_add(v(F.lit(255)), v(F.lit(1)))).alias("b")).first()
    assert r.a == "F" * 64 and int(r.b, 16) == 256


@pytest.mark.parametrize("cut", list(provenance.CUTS))
def test_provenance_proofs(changes, cut):
    roots = provenance.version_roots(changes, cut)
    found = provenance.verify(provenance.prove(changes, 10, 30, cut), roots, 10, 30)
    assert found.where("not ok").count() == 0 and found.agg(F.sum("n_found")).first()[0] == changes.where("block between 10 and 30").count()
    forged = provenance.prove(changes.where("block <> 20"), 10, 30, cut)
    hit = changes.where("block = 20").select("addr", "slot").distinct().count()
    assert provenance.verify(forged, roots, 10, 30).where("not ok").count() == hit


def test_trie_snapshots(changes):
    state = changes.groupBy("addr", "slot").agg(F.max_by("value", "block").alias("value"))
    assert trie.proved(state).where("not ok").count() == 0
    assert trie.root(state).first().root == trie.root(state.repartition(5)).first().root
    nodes = trie.node_versions(changes, [10, 20, 30]).cache()
    gone = trie.pruned(nodes, 30)
    assert gone.where("last_block >= 30").count() == 0 and gone.count() + nodes.where("last_block = 30").count() == nodes.count()


def test_trie_root_does_not_depend_on_its_parts(spark, changes):
    state = changes.groupBy("addr", "slot").agg(F.max_by("value", "block").alias("value")).cache()
    for some in (state, state.limit(3), state.limit(1)):
        paths = some.select(trie.path().alias("p"), merkle.leaf("value").alias("v")).collect()
        whole = patricia.Trie({r.p: r.v for r in paths}).root
        assert {trie.root(some, n).first().root for n in (None, 1, 2, 3)} == {whole}
    assert trie.root(state.limit(0)).first().root == "" and trie.proved(state.limit(0)).count() == 0
    assert [trie.nibbles_for(state, most) for most in (10**6, 1)] == [1, 2]


def test_stored_trie_nodes_lead_to_values(spark, changes, tmp_path):
    state = changes.groupBy("addr", "slot").agg(F.max_by("value", "block").alias("value"))
    trie.nodes(state).write.parquet(f"{tmp_path}/nodes")
    held = spark.read.parquet(f"{tmp_path}/nodes")
    absent = state.select((F.col("addr") + 1000).alias("addr"), "slot")
    found = {(r.addr, r.slot): r.hash for r in trie.read(held, state.select("addr", "slot").unionByName(absent)).collect()}
    assert found == {(r.addr, r.slot): r.hash for r in state.select("addr", "slot", merkle.leaf("value").alias("hash")).collect()} | {(r.addr, r.slot): None for r in absent.collect()}
    assert trie.read(held.limit(0), absent).where("hash is not null").count() == 0


@pytest.mark.parametrize("cut", list(provenance.CUTS))
def test_dense_proofs(spark, cut):
    rows = [(1, "a", b, b) for b in (3, 4, 9, 15)] + [(2, "a", 12, 5), (3, "a", 1, 6), (4, "a", 20, 7), (5, "a", 6, None)]
    changes = spark.createDataFrame(rows, "addr long, slot string, block long, value long")
    held = lambda a, b: max(((c, v) for k, _, c, v in rows if k == a and c <= b), default=(0, 0))
    expected = {(a, b): (None if held(a, b) == (0, 0) else "" if held(a, b)[1] is None else str(held(a, b)[1])) for a in range(1, 6) for b in range(4, 13)}
    proofs = provenance.dense_prove(changes, 4, 12, cut).cache()
    shown = provenance.dense_shown(proofs).collect()
    assert {(r.addr, r.block): r.value for r in shown} == expected and all(r.ok for r in shown) and len(shown) == 45
    # A version that is kept back, a root of another key, and a stretch that hides a version.
    forged = provenance.dense_prove(changes.where("block <> 9"), 4, 12, cut).drop("root").join(proofs.select("addr", "root").distinct(), "addr")
    assert {r.addr for r in provenance.dense_shown(forged).where("not ok").collect()} == {1}
    longer = proofs.where("addr = 1 and low = 4").withColumn("high", F.lit(12).cast("long"))
    assert not any(r.ok for r in provenance.dense_shown(longer).collect())
    swapped = proofs.where("addr = 1").withColumn("root", F.lit(proofs.where("addr = 3").first().root))
    assert not any(r.ok or r.value for r in provenance.dense_shown(swapped).collect())


def test_page_proofs(changes):
    state = changes.groupBy("addr", "slot").agg(F.max_by("value", "block").alias("value"))
    pages = trie.page_leaves(state, 1).cache()
    assert pages.agg(F.sum("n_keys")).first()[0] == state.count()
    made = merkle.levels(pages, 16)
    root = merkle.roots(made[0], 16, made=made)
    proofs = merkle.proofs(made[0], 16, made=made)
    assert merkle.verified(proofs, root).where("not ok").count() == 0
    forged = proofs.withColumn("hash", F.reverse("hash"))
    assert merkle.verified(forged, root).where("ok").count() == 0
    key = state.orderBy("addr", "slot").first()
    other = state.withColumn("value", F.when((F.col("addr") == key.addr) & (F.col("slot") == key.slot), F.lit("other")).otherwise(F.col("value")))
    assert trie.page_leaves(other, 1).join(pages, ["page", "hash"], "left_anti").count() == 1
    assert merkle.roots(trie.page_leaves(other, 1), 16).first().root != root.first().root
    assert merkle.roots(trie.page_leaves(state.limit(0), 1), 16).count() == 0
