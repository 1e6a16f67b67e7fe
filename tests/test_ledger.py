"""Reads, runs, rewinds, contracts and metrics against plain Python on small ledgers."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratum.ledger import BACKENDS, Ledger
from stratum.operators import contracts, lsm, metrics, reorg, state
from stratum.plans import scratch
from stratum.schema import ZERO
from stratum.sources.store import Store

SCHEMA = "addr long, slot string, block long, value long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return sorted({(rng.randint(1, 12), rng.choice("abc"), rng.randint(1, 40)) for _ in range(300)})


@pytest.fixture(scope="module")
def changes(spark, rows):
    return spark.createDataFrame([(a, s, b, a * 1000 + b) for a, s, b in rows], SCHEMA).cache()


def versions(rows):
    out = defaultdict(list)
    for a, s, b in rows:
        out[a, s].append(b)
    return out


def test_last_write_of_a_block_counts(spark):
    writes = spark.createDataFrame([(1, "a", 1, 5, 10), (1, "a", 1, 7, 20), (1, "a", 1, 6, 30), (1, "a", 2, 1, None)], "addr long, slot string, block long, seq long, value long")
    assert sorted(map(tuple, state.block_writes(writes).collect())) == [(1, "a", 1, 20), (1, "a", 2, None)]


def test_latest_and_as_of(changes, rows):
    for block in (0, 1, 17, 40):
        expected = {(a, s, max(x for x in v if x <= block)) for (a, s), v in versions(rows).items() if min(v) <= block}
        assert {(r.addr, r.slot, r.block) for r in state.as_of(changes, block).collect()} == expected
    assert state.latest(changes).count() == len(versions(rows))


def test_missing_keys_get_the_default(spark, changes):
    keys = spark.createDataFrame([(1, "a"), (99, "a"), (1, "a")], "addr long, slot string")
    got = {(r.addr, r.slot): r.value for r in state.values_of(keys, changes, F.lit(0)).collect()}
    assert got[99, "a"] == 0 and len(got) == 2


@pytest.mark.parametrize(("low", "high"), [(1, 40), (10, 12), (0, 0), (39, 60)])
def test_provenance_boundary_and_dense(changes, rows, low, high):
    flat, bounds, every = set(), set(), {}
    for (a, s), v in versions(rows).items():
        inside = [b for b in v if low <= b <= high]
        before = [b for b in v if b < low]
        flat |= {(a, s, b) for b in inside}
        bounds |= {(a, s, b, True) for b in inside}
        if before and low not in inside:
            bounds.add((a, s, max(before), False))
        if min(v) <= high:
            every |= {(a, s, b): max((x for x in v if x <= b), default=None) for b in range(low, high + 1)}
    assert {(r.addr, r.slot, r.block) for r in state.provenance(changes, low, high).collect()} == flat
    assert {(r.addr, r.slot, r.block, r.inside) for r in state.provenance_with_boundary(changes, low, high).collect()} == bounds
    assert {(r.addr, r.slot, r.block): r.value and r.value % 1000 for r in state.dense(changes, low, high).collect()} == every


def test_key_predicates_reach_the_scan(spark, changes, tmp_path):
    changes.write.parquet(str(tmp_path / "c"))
    plan = state.keyed(state.latest(spark.read.parquet(str(tmp_path / "c"))), [(1, "a")])._jdf.queryExecution().toString()
    assert "EqualTo(addr,1)" in plan.split("PushedFilters")[-1]


def test_diff_and_prune(changes, rows):
    at = lambda v, b: max((x for x in v if x <= b), default=None)
    expected = {(a, s, at(v, 10), at(v, 30)) for (a, s), v in versions(rows).items() if at(v, 10) != at(v, 30)}
    assert {(r.addr, r.slot, r.old_value and r.old_value % 1000, r.new_value and r.new_value % 1000) for r in state.diff(changes, 10, 30).collect()} == expected
    kept = {(a, s, b) for (a, s), v in versions(rows).items() for b in v if b >= 20 or b == at(v, 20)}
    assert {(r.addr, r.slot, r.block) for r in state.prune_before(changes, 20).collect()} == kept
    assert state.as_of(state.prune_before(changes, 20), 25).exceptAll(state.as_of(changes, 25)).count() == 0


def test_neighbours(spark, changes, rows):
    keys = sorted({(a, s) for a, s, _ in rows})
    probes = [(a, s) for a in range(0, 14) for s in "abz"]
    got = {(r.addr, r.slot): (r.exists, r.before and tuple(r.before), r.after and tuple(r.after)) for r in state.neighbours(changes, spark.createDataFrame(probes, "addr long, slot string")).collect()}
    assert got == {p: (p in keys, max((k for k in keys if k < p), default=None), min((k for k in keys if k > p), default=None)) for p in probes}


def test_neighbours_across_parts_take_one_step_a_row(spark, monkeypatch):
    monkeypatch.setattr(state, "PART_KEYS", 8, raising=False)
    keys = [(a, "m") for a in range(0, 300, 3) if not 90 <= a < 150]  # parts without an existing key between them
    probes = [(a, s) for a in range(-2, 303) for s in ("m", "z")]
    every = spark.createDataFrame([(*k, 1, 1) for k in keys], "addr long, slot string, block long, value long")
    found = state.neighbours(every, spark.createDataFrame(probes, "addr long, slot string"))
    got = {(r.addr, r.slot): (r.exists, r.before and tuple(r.before), r.after and tuple(r.after)) for r in found.collect()}
    assert got == {p: (p in keys, max((k for k in keys if k < p), default=None), min((k for k in keys if k > p), default=None)) for p in probes}
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower(), "such frames are made anew for each row"


def test_lower_bounds_across_parts_take_one_sort(spark, monkeypatch):
    monkeypatch.setattr(state, "PART_KEYS", 8)
    keys = [(a, "m") for a in range(0, 300, 3) if not 90 <= a < 150]
    probes = [(a, s) for a in range(-2, 303) for s in ("a", "m", "z")]
    every = spark.createDataFrame([(*k, 1, 1) for k in keys], "addr long, slot string, block long, value long")
    sorts, plain = [], scratch.positions
    monkeypatch.setattr(scratch, "positions", lambda *a: sorts.append(1) or plain(*a))
    asked = spark.createDataFrame(probes, "addr long, slot string")
    got = {(r.addr, r.slot): r.pos for r in state.lower_bounds(every, asked).collect()}
    assert got == {p: min(sum(k < p for k in keys), len(keys) - 1) for p in probes}
    assert len(sorts) == 1
    assert {r.pos for r in state.lower_bounds(every.where("addr < 0"), asked).collect()} == {None}, "a ledger without keys has no places"


def test_history_samples_and_stale_writes(spark, changes, rows):
    assert {(r.addr, r.slot): [v.block for v in r.versions] for r in state.history(changes).collect()} == versions(rows)
    assert state.sample_keys(changes, 5, 1).collect() == state.sample_keys(changes.repartition(7), 5, 1).collect()
    order = spark.createDataFrame([(1, "a", 5, 0, 1), (1, "a", 3, 0, 2), (1, "a", 6, 0, 3), (2, "a", 1, 0, 4)], "addr long, slot string, block long, value long, seq long")
    assert [(r.block, r.newest) for r in state.checked_versions(order, "seq").collect()] == [(3, 5)]


def simulated(flushes, ratio):
    """Levels as lists of runs of flush numbers, newest last, after each full level became one run of the next."""
    levels = [[]]
    for f in range(flushes):
        levels[0].append([f])
        i = 0
        while len(levels[i]) == ratio:
            if i + 1 == len(levels):
                levels.append([])
            levels[i + 1].append([x for run in levels[i] for x in run])
            levels[i] = []
            i += 1
    return {f: (i, k) for i, level in enumerate(levels) for k, run in enumerate(level) for f in run}


@pytest.mark.parametrize("ratio", [2, 3, 5])
def test_placement_equals_a_simulation(spark, ratio):
    pairs = [(f, n) for n in (0, 1, 2, 7, 26, 27, 28, 100) for f in range(n + 1)]
    level, run = lsm.placed(F.col("f"), F.col("n"), ratio)
    got = {(r.f, r.n): (r.level, r.run) for r in spark.createDataFrame(pairs, "f long, n long").select("f", "n", level.alias("level"), run.alias("run")).collect()}
    assert got == {(f, n): simulated(n, ratio).get(f, (-1, -1)) for f, n in pairs}


def test_placement_beyond_many_levels(spark):
    level, run = lsm.placed(F.col("f"), F.col("n"), 2)
    for n in (4095, 4096, 20_000):
        expected = simulated(n, 2)
        got = {r.f: (r.level, r.run) for r in spark.range(n).select(F.col("id").alias("f"), F.lit(n).cast("long").alias("n")).select("f", level.alias("level"), run.alias("run")).collect()}
        assert got == expected
    top = spark.range(1).select(F.lit(2**61 + 1).alias("n"), F.lit(5).cast("long").alias("f")).select(level.alias("level"), run.alias("run")).first()
    assert (top.level, top.run) == (61, 0)


def test_compaction_numbers_runs_anew(spark):
    rows = spark.createDataFrame([(1, "a", 1, 5, 1, 0), (1, "a", 2, 6, 0, 0), (2, "a", 3, 7, 0, 1), (3, "a", 4, 8, -1, -1)], "addr long, slot string, block long, value long, level int, run long")
    got = {(r.addr, r.block): (r.level, r.run) for r in lsm.compacted(rows, 0).collect()}
    assert got == {(1, 1): (1, 0), (1, 2): (1, 1), (2, 3): (1, 1), (3, 4): (-1, -1)}
    assert {r.addr: r.probed for r in lsm.runs_visited(rows).collect()} == {3: 1, 2: 2, 1: 3}


def test_runs_merge_without_changing_answers(changes, rows):
    placed = lsm.with_runs(changes, 10, 3).cache()
    assert placed.count() == len(rows) and placed.groupBy("flush").count().agg(F.max("count")).first()[0] == 10
    merged = lsm.merged(*(placed.where(F.col("flush") % 2 == i) for i in range(2)))
    assert {(r.addr, r.slot, r.block, r.value) for r in merged.collect()} == {tuple(r) for r in state.latest(changes).collect()}
    probed = {(r.addr, r.slot): r.probed for r in lsm.runs_probed(placed).collect()}
    newest = {}
    for i, (b, a, s) in enumerate(sorted((b, a, s) for a, s, b in rows)):
        newest[a, s] = i // 10
    last = max(newest.values())
    assert probed == {k: last - f + 1 for k, f in newest.items()}
    pages = lsm.pages(placed, 4)
    assert pages.groupBy("flush", "page").count().agg(F.max("count")).first()[0] == 4


def test_rewind_keeps_and_rebuilds(spark, changes, rows):
    assert {(r.addr, r.slot, r.block) for r in reorg.rewound(changes, 5).collect()} == {x for x in rows if x[2] <= max(b for *_, b in rows) - 5}
    runs = spark.createDataFrame([(0, 0, 1, 5), (0, 1, 6, 9), (1, 0, 10, 20)], "level int, run long, block_lo long, block_hi long")
    saved = spark.createDataFrame([(0, 0, 1, 5), (0, 1, 6, 12), (0, 2, 30, 31)], "level int, run long, block_lo long, block_hi long")
    assert [(r.run, r.action, r.n_sources) for r in reorg.plan(runs, reorg.checkpoint(saved, 3)).orderBy("run").collect()] == [(0, "keep", 1), (1, "rebuild", 2), (2, "rebuild", 0)]
    assert {r.block for r in reorg.rebuilt(changes, saved.where("run = 1")).collect()} <= set(range(6, 13))


def test_two_increments_in_a_block_count_once(spark):
    moves = spark.createDataFrame([(1, 5, 6), (1, 5, 7), (2, 5, 6)], "block long, sender long, receiver long")
    assert {r.account: r.n for r in contracts.touches(moves).collect()} == {5: 2, 6: 2, 7: 1}
    assert {r.account: r.n for r in contracts.touches(moves, serial=True).collect()} == {5: 3, 6: 2, 7: 1}


def test_smallbank_wraps_and_reads_the_state_before_the_block(spark):
    rows = [
        (1, 1, contracts.UPDATE_SAVING, 1, 0, 50), (1, 2, contracts.UPDATE_BALANCE, 1, 0, 7), (1, 3, contracts.UPDATE_BALANCE, 1, 0, 9),
        (2, 4, contracts.SEND_PAYMENT, 1, 2, 10), (3, 5, contracts.WRITE_CHECK, 3, 0, 0), (4, 6, contracts.ALMAGATE, 1, 2, 0), (5, 7, contracts.GET_BALANCE, 1, 0, 0),
    ]
    tx = spark.createDataFrame([(0, *r) for r in rows], "shard int, block long, seq long, op int, a long, b long, amount long")
    snapshot = {(r.name, r.account): int(r.value) for r in contracts.execute(tx).collect()}
    assert snapshot == {("saving", 1): 50, ("checking", 1): 0, ("checking", 2): 10, ("checking", 3): 0, ("saving", 2): 60}
    serial = {(r.name, r.account): int(r.value) for r in contracts.execute(tx.where("block <= 2"), serial=True).collect()}
    assert serial["checking", 1] == 6
    check = contracts.apply(contracts.WRITE_CHECK, 1, 0, 0, lambda t, a: 5 if t == "saving" else 0)
    assert check == [("checking", 1, contracts.WORD - 1)]


def test_write_sets_and_balances(spark):
    writes = spark.createDataFrame([(1, "a", 1, 5, False), (1, "b", 2, 6, False), (1, None, 3, None, True), (1, "a", 4, 7, False), (2, "a", 1, 8, False)], "addr long, slot string, seq long, value long, reset boolean")
    assert {tuple(r) for r in contracts.write_sets(writes).collect()} == {(1, "a", 7), (2, "a", 8)}
    deposits = spark.createDataFrame([(1, "checking", 5), (1, "saving", 6), (2, "saving", 1), (3, None, 1)], "account long, kind string, amount long")
    assert {tuple(r) for r in contracts.balances(deposits).collect()} == {(1, 5, 6, 11), (2, 0, 1, 1), (3, 0, 0, 0)}


def test_metrics(spark, changes, rows):
    times = spark.createDataFrame([(0, 10), (10, 30), (30, 31)], "start long, end long")
    r = metrics.block_latency(times).first()
    assert (r.n_blocks, r.mean, r.longest) == (3, pytest.approx(31 / 3), 20)
    got = {r.block: r.n_changes for r in metrics.sampled_storage(changes, 10).collect()}
    assert got == {b: sum(x[2] <= b for x in rows) for b in (10, 20, 30, 40)}
    assert metrics.windows(40, [2, 8]) == [(2, 39, 40), (8, 33, 40)]


def test_all_backends_give_the_same_reads(spark, changes, tmp_path):
    rows = lambda df: sorted(map(tuple, df.select("addr", "slot", "block", "value").collect()))
    plain = {name: make(changes).single_write(1, "a", 77, 50) for name, make in BACKENDS.items()}
    for read in (lambda k: k.latest(), lambda k: k.as_of(20), lambda k: k.provenance(10, 20), lambda k: k.rewind(3).latest(), lambda k: k.pruned().changes):
        answers = {name: rows(read(ledger)) for name, ledger in plain.items()}
        assert all(a == answers["memory"] for a in answers.values())
    digests = {name: plain[name].digest().first().root for name in ("gear", "polynomial", "fixed", "trie")}
    assert len(set(digests.values())) == 4
    assert plain["delta"].digest().first().root not in digests.values()
    assert plain["trie"].verify(plain["trie"].prove(1, 20), 1, 20).where("not ok").count() == 0
    assert plain["delta"].index_size(10, 3).agg(F.sum("n_rows")).first()[0] == plain["delta"].changes.count()
    store = Store(spark, f"file://{tmp_path}/s", 16, 3)
    assert plain["gear"].commit(store)["version"] == 1 and rows(Ledger.opened(store).latest()) == rows(plain["gear"].latest())
    cost = plain["gear"].memory_cost(16, 3).first()
    assert cost.filters > 0 and cost.models > 0


def test_a_pruned_ledger_refuses_what_it_dropped(changes):
    pruned = Ledger(changes).pruned(15)
    assert sorted(map(tuple, pruned.as_of(20).collect())) == sorted(map(tuple, Ledger(changes).as_of(20).collect()))
    assert pruned.verify(pruned.prove(15, 30), 15, 30).where("not ok").count() == 0
    for read in (lambda k: k.as_of(14), lambda k: k.provenance(14, 20), lambda k: k.prove(3, 20), lambda k: Ledger(changes).pruned().prove(1, 2)):
        with pytest.raises(ValueError, match="pruned"):
            read(pruned)


def test_interface(spark, changes):
    ledger = Ledger(changes)
    later = ledger.single_write(1, "a", 77, 50).batch_write(spark.createDataFrame([(2, "nonce", 3, 1), (2, "nonce", 4, 2)], "addr long, slot string, value long, seq long"), 51)
    assert later.as_of(50).where("addr = 1 and slot = 'a'").first().value == 77
    assert {r.addr: r.value for r in later.accounts(Ledger.NONCE, F.lit(0)).collect()}[2] == 4
    assert later.rewind(1).latest().where("slot = 'nonce'").count() == 0
    proofs = later.prove(10, 50)
    assert later.verify(proofs, 10, 50).where("not ok").count() == 0
    assert later.digest().first().root != ledger.digest().first().root
    assert later.pruned().changes.count() == later.latest().count() and later.index_size(10, 3).agg(F.sum("n_rows")).first()[0] == later.changes.count()
    assert len(ZERO) == 32
