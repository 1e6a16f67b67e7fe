"""Traces, the store on disk, and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratum.operators import lsm, state
from stratum.sources import traces
from stratum.sources.parameters import Parameters
from stratum.sources.store import Store, write_metrics
from stratum.streaming import blocks


def test_kv_lines(spark):
    lines = ["READ usertable user1 [ <all fields>]", "READ usertable user1 [ ]", "UPDATE usertable user2 [ field0=abc def ]", "INSERT usertable user3 [ field7=x ]", "# nothing", "", "DELETE usertable user1 [ ]"]
    got = [tuple(r) for r in traces.kv_operations(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got[-3:] == [("READ", "user1", None), ("UPDATE", "user2", "abc def"), ("INSERT", "user3", "x")] and len(got) in (3, 4)


def test_transfers_and_generator(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a b\nc  d\nbad\nx y z\n")
    assert [tuple(r) for r in traces.transfers(traces.read_lines(spark, str(tmp_path / "t.txt"))).collect()] == [("a", "b"), ("c", "d")]
    tx = traces.smallbank(spark, 500, 20, 1)
    assert sorted(tx.collect()) == sorted(traces.smallbank(spark, 500, 20, 1).repartition(3).collect())
    r = tx.agg(F.min("op"), F.max("op"), F.min("a"), F.max("a"), F.min("amount"), F.max("amount"), F.max("block")).first()
    assert tuple(r) == (1, 6, 1, 19, 1, 99, 5)


def test_store_commits_appends_and_drops(spark, tmp_path):
    changes = spark.createDataFrame([(i % 7, "a", i // 7 + 1, i) for i in range(70)], "addr long, slot string, block long, value long")
    store = Store(spark, f"file://{tmp_path}/s", capacity=8, ratio=2)
    assert store.manifest() is None
    assert store.append(changes)["version"] == 1 and store.manifest()["latest_block"] == 10
    store.append(spark.createDataFrame([(0, "a", 10, -1), (9, "b", 11, 5)], changes.schema))
    again = Store(spark, f"file://{tmp_path}/s")
    assert again.manifest()["version"] == 2 and again.changes().count() == 71
    assert state.latest(again.changes()).where("addr = 0").first().value == -1
    assert again.runs().agg(F.sum("n_rows")).first()[0] == 71 and again.files().count() > 3
    assert again.drop_old() == 1 and again.changes().count() == 71
    write_metrics(again.runs(), f"file://{tmp_path}/m")
    assert spark.read.json(f"file://{tmp_path}/m").count() == again.runs().count()


def test_store_appends_like_a_commit_and_rewinds(spark, tmp_path):
    rows = [(i * 7 % 11, "ab"[i % 2], i // 6 + 1, i) for i in range(300)]
    changes = spark.createDataFrame(rows, "addr long, slot string, block long, value long").groupBy("addr", "slot", "block").agg(F.max("value").alias("value")).cache()
    store = Store(spark, f"file://{tmp_path}/s", capacity=16, ratio=3, checkpoint_every=2)
    key = lambda df: sorted(map(tuple, df.select("addr", "slot", "block", "value").collect()))
    for low, high in ((1, 9), (10, 10), (11, 30), (31, 31), (32, 50)):
        before = {r["folder"] for r in (store.manifest() or {"runs": []})["runs"] if r["level"] > 0}
        store.append(changes.where(F.col("block").between(low, high)))
        assert key(store.changes()) == key(changes.where(F.col("block") <= high))
        if low in (10, 31):
            assert before <= {r["folder"] for r in store.manifest()["runs"]}, "a small append leaves deep runs where they are"
    whole = lsm.runs(lsm.with_runs(changes, 16, 3))
    shape = lambda df: sorted((r.level, r.n_rows, r.block_lo, r.block_hi) for r in df.collect())
    assert shape(store.runs()) == shape(whole)
    assert store.checkpoints().select("version").distinct().count() == 5
    shared = {r["folder"] for r in store.manifests()[2]["runs"] if r["level"] >= 0}
    entry = store.rewind(30)  # just what the third commit held
    assert key(store.changes()) == key(changes.where("block <= 30")) and shared <= {r["folder"] for r in entry["runs"]}
    store.rewind(17)
    assert key(store.changes()) == key(changes.where("block <= 17"))
    store.append(changes.where("block between 18 and 40"))
    assert key(store.changes()) == key(changes.where("block <= 40"))
    assert sorted(map(tuple, store.lookup(changes).select("addr", "slot", "block", "value").collect())) == sorted(map(tuple, state.latest(changes.where("block <= 40")).collect()))
    assert key(store.write_latest()) == key(state.latest(store.changes()))
    assert store.drop_old() > 0 and key(store.changes()) == key(changes.where("block <= 40")) and len(store.manifests()) == 4
    with pytest.raises(Exception, match="exist"):
        fs, path = store._hadoop(f"manifest/{store.manifest()['version']:012d}.json")
        fs.create(path, False)


def test_rewind_keeps_blocks_that_came_late(spark, tmp_path):
    schema = "addr long, slot string, block long, value long"
    store = Store(spark, f"file://{tmp_path}/s", capacity=4, ratio=2)
    store.append(spark.createDataFrame([(i, "a", i, i) for i in range(1, 11)], schema))
    store.append(spark.createDataFrame([(i, "a", i, i) for i in range(11, 21)] + [(99, "late", 5, 7)], schema))
    store.rewind(12)
    assert sorted(r.addr for r in store.changes().collect()) == [*range(1, 13), 99]


def test_rewind_leaves_out_commits_of_another_past(spark, tmp_path):
    schema = "addr long, slot string, block long, value long"
    rows = lambda low, high, value: spark.createDataFrame([(i, "a", i, value) for i in range(low, high + 1)], schema)
    held = lambda s: {r.block: r.value for r in s.changes().collect()}
    store = Store(spark, f"file://{tmp_path}/s", capacity=4, ratio=2, checkpoint_every=2)
    store.append(rows(1, 10, 1))
    store.append(rows(11, 20, 1))
    store.rewind(12)
    store.append(rows(13, 30, 2))
    assert store.drop_old() > 0  # versions 2 and 4 stay; version 2 holds blocks that were taken back
    store.rewind(25)
    assert held(store) == {b: 1 if b <= 12 else 2 for b in range(1, 26)}
    store.commit(rows(1, 8, 3))
    store.append(rows(9, 40, 3))
    store.rewind(27)
    assert held(store) == {b: 3 for b in range(1, 28)}


def test_parameters(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"capacity": 8,\n "ratio": 2, "checkpoint_every": 3}')
    given = Parameters.read(spark, f"file://{tmp_path}/p.json")
    assert given == Parameters(capacity=8, ratio=2, checkpoint_every=3) and given.fanout == 4
    store = given.store(spark, f"file://{tmp_path}/s")
    assert (store.capacity, store.ratio, store.checkpoint_every) == (8, 2, 3)
    (tmp_path / "q.json").write_text(Parameters(fanout=9).to_json())
    assert Parameters.read(spark, f"file://{tmp_path}/q.json").fanout == 9
    (tmp_path / "r.json").write_text('{"size": 1}')
    with pytest.raises(ValueError, match="size"):
        Parameters.read(spark, f"file://{tmp_path}/r.json")


def test_streams_keep_the_batch_answers(spark, tmp_path):
    schema = "addr long, slot string, block long, seq long, value long, ts timestamp"
    rows = [(i % 5, "ab"[i % 2], i // 10 + 1, i, i * i) for i in range(100)]
    for part in range(2):
        spark.createDataFrame([(*r, None) for r in rows[part * 50 : part * 50 + 50]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    expected = state.latest(state.block_writes(spark.read.parquet(f"{tmp_path}/in")))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        blocks.append_blocks(source, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(state.latest(spark.read.parquet(f"{tmp_path}/out").drop("batch")).collect()) == sorted(expected.collect())
    query = blocks.latest_stream(source).writeStream.outputMode("complete").format("memory").queryName("latest_test").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("latest_test").collect()) == sorted(expected.collect())


def test_windows_by_event_time(spark, tmp_path):
    schema = "addr long, slot string, block long, seq long, value long, ts timestamp"
    spark.createDataFrame([(i, "a", 1, i, i) for i in range(30)], "addr long, slot string, block long, seq long, value long").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60)).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = blocks.block_counts(source, "ts", "5 minutes", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("windows_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.n_writes for r in spark.table("windows_test").collect()} == {10}
