import time

import pytest
from logloom.api import ClosedError, ConflictError, KeyedLog
from logloom.config import Merge, Storage, Thresholds, Triggers
from logloom.streaming import commands as streaming
from pyspark.sql import functions as F

from tests.helpers import LOG_DDL, plain, random_log, state
from tests.test_replay import DDL, answers, random_commands


def live(store):
    return {bytes(r["key"]): bytes(r["value"]) for r in store.snapshot().collect()}


def test_set_get_delete(spark, tmp_path):
    with KeyedLog.open(spark, str(tmp_path / "s")) as store:
        assert store.get(b"k") is None and live(store) == {}
        store.set(b"k", b"1")
        store.set(b"", b"")
        store.set(b"k", b"2")
        assert (store.get(b"k"), store.get(b"")) == (b"2", b"")
        assert store.delete(b"k", b"k", b"absent") == 1 and store.get(b"k") is None
        store.set(b"k", b"3")
        with pytest.raises(ValueError):
            store.delete()
        with pytest.raises(ValueError):
            store.set_batch(spark.createDataFrame([(b"a", None)], "key binary, value binary"))
        totals = store.stats().agg(F.sum("live_keys"), F.sum("dead_keys")).first()
        assert tuple(totals) == (2, 4)
    again = KeyedLog.open(spark, str(tmp_path / "s"))
    assert live(again) == {b"k": b"3", b"": b""}
    for use in (lambda: store.get(b"k"), lambda: store.set(b"k", b"v"), lambda: store.delete(b"k"), store.stats, store.merge):
        with pytest.raises(ClosedError):
            use()


def test_batches_and_merges(spark, tmp_path):
    merge = Merge(triggers=Triggers(0.3, 10**9), thresholds=Thresholds(0.0, 10**9, 0))
    store = KeyedLog.open(spark, str(tmp_path / "s"), Storage(max_file_size=500, merge=merge))
    assert not store.maybe_merge() and not store.merge()
    rows = [(f"k{i}".encode(), f"v{i}".encode()) for i in range(100)]
    store.set_batch(spark.createDataFrame(rows, "key binary, value binary"))
    store.set_batch(spark.createDataFrame([(k, b"new") for k, _ in rows[:50]], "key binary, value binary"))
    assert store.delete_batch(spark.createDataFrame([(k,) for k, _ in rows[:20]], "key binary")) == 20
    before, old = live(store), store.log()
    assert len(before) == 80 and before[b"k30"] == b"new"
    n = old.count()
    assert store.maybe_merge(3) and live(store) == before
    assert old.count() == n  # a reader keeps what it began with
    assert store.stats().agg(F.sum("dead_keys")).first()[0] == 0
    assert store.hints().count() > 0 and store.vacuum() == [] and len(store.vacuum(0)) > 0
    assert live(KeyedLog.open(spark, str(tmp_path / "s"))) == before


def test_of_two_writers_one_fails(spark, tmp_path):
    a, b = (KeyedLog.open(spark, str(tmp_path / "s")) for _ in range(2))
    m = b.manifest()
    a.set(b"k", b"a")
    with pytest.raises(ConflictError):
        b._commit(m, m["version"])
    assert live(b) == {b"k": b"a"}


def test_vacuum_leaves_what_writers_and_readers_need(spark, tmp_path):
    merge = Merge(thresholds=Thresholds(0.0, 10**9, 0))
    store = KeyedLog.open(spark, str(tmp_path / "s"), Storage(merge=merge))
    store.set(b"k", b"1")
    store.set(b"k", b"2")
    reader = store.log()
    n = reader.count()
    assert store.merge()
    m = store.manifest()
    # A writer between its segment and its manifest.
    store._write_segment(store.log(m), "pending")
    assert store.vacuum() == [] and reader.count() == n
    store._commit(m | {"segments": [*m["segments"], "pending"]}, m["version"])
    m = store.manifest()
    store._write_segment(store.log(m), "late")
    time.sleep(1.1)
    gone = store.vacuum(1.0)
    assert "late" in gone and not set(gone) & set(m["segments"])
    with pytest.raises(FileNotFoundError):
        store._commit(m | {"segments": [*m["segments"], "late"]}, m["version"])
    assert live(store) == {b"k": b"2"} == {b"k": store.get(b"k")}


def test_a_store_that_is_opened_has_an_index(spark, tmp_path):
    merge = Merge(thresholds=Thresholds(0.0, 10**9, 0))
    conf = Storage(max_file_size=200, merge=merge)
    rows = [(f"k{i:03}".encode(), bytes([i])) for i in range(60)]
    with KeyedLog.open(spark, str(tmp_path / "s"), conf) as store:
        store.set_batch(spark.createDataFrame(rows, "key binary, value binary"))
        store.delete_batch(spark.createDataFrame([(k,) for k, _ in rows[:10]], "key binary"))
        assert store.manifest()["index"] is None
    store = KeyedLog.open(spark, str(tmp_path / "s"), conf)
    index = store.manifest()["index"]
    assert len(index["segments"]) == 2 and store._index(store.manifest()).count() == 50
    store.set(b"k000", b"again")
    store.set(b"k020", b"anew")
    expected = dict(rows[10:]) | {b"k000": b"again", b"k020": b"anew"}
    asked = spark.createDataFrame([(k, "x") for k, _ in rows] + [(b"none", "x"), (None, "x"), (b"k020", "x")], "key binary, found string")
    for step in range(3):
        got = store.get_batch(asked).collect()
        assert len(got) == 63 and all((bytes(r["value"]) if r["found"] else None) == (expected.get(bytes(r["key"])) if r["key"] is not None else None) for r in got)
        assert [store.get(k) for k in (b"k000", b"k005", b"k030")] == [b"again", None, b"\x1e"]
        if step == 0:
            store = KeyedLog.open(spark, str(tmp_path / "s"), conf)
            assert store.manifest()["index"]["name"] != index["name"] and len(store.manifest()["index"]["segments"]) == 4
        if step == 1:
            assert store.merge() and store.manifest()["index"] is not None and store.hints().count() > 0
    plan = store.get_batch(asked)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    m = store.manifest()
    here = store._segments(m["segments"]).where("writer = 0 AND fileid = 3")
    assert "PartitionFilters: [isnotnull(writer" in here._jdf.queryExecution().executedPlan().toString()


def test_another_log_is_loaded(spark, tmp_path):
    rows = random_log(3)
    store = KeyedLog.open(spark, str(tmp_path / "s"), Storage(max_file_size=100, sync="always"))
    store.load(spark.createDataFrame(rows, LOG_DDL))
    assert live(store) == {k: r[5] for k, r in state(rows).items()}
    assert store.log().count() == len(set(rows))


def test_a_batch_of_commands_is_applied_once(spark, tmp_path):
    store = KeyedLog.open(spark, str(tmp_path / "s"))
    one, two = random_commands(1, 40), [(s + 40, *r) for s, *r in random_commands(2, 40)]
    for number, batch in enumerate([one, one, two]):
        store.apply(spark.createDataFrame(batch, DDL), str(tmp_path / f"r{number}"), max(number - 1, 0))
    said, held = answers(one + two, {})
    assert live(store) == held
    assert plain(spark.read.parquet(str(tmp_path / "r0"), str(tmp_path / "r2")).collect()) == plain(said)


def feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{folder}/b{i}")
        yield


def test_stream_into_a_store(spark, tmp_path):
    store = KeyedLog.open(spark, str(tmp_path / "s"))
    batches = [random_commands(5, 30), [(s + 30, *r) for s, *r in random_commands(6, 30)]]
    for _ in feed(spark, str(tmp_path / "in"), batches):
        stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "in/*"))
        streaming.serve(stream, store, str(tmp_path / "replies"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    said, held = answers(batches[0] + batches[1], {})
    assert live(store) == held
    assert plain(spark.read.parquet(str(tmp_path / "replies")).drop("batch").collect()) == plain(said)


def test_a_sync_interval_is_the_stream_s_trigger(spark, tmp_path):
    store = KeyedLog.open(spark, str(tmp_path / "s"), Storage(sync=300))
    commands = random_commands(9, 20)
    for _ in feed(spark, str(tmp_path / "in"), [commands]):
        query = streaming.serve(spark.readStream.schema(DDL).parquet(str(tmp_path / "in/*")), store, str(tmp_path / "replies"), str(tmp_path / "cp"))
        assert streaming.stop_gracefully(query, 120) and not query.isActive
    assert live(store) == answers(commands, {})[1]


def test_stream_with_state(spark, tmp_path):
    single = [(s, op, keys[:1], value) for s, op, keys, value in random_commands(7, 60)]
    for _ in feed(spark, str(tmp_path / "in"), [single[:30], single[30:]]):
        stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "in/*"))
        one = stream.select("seq", "op", F.get("keys", F.lit(0)).alias("key"), "value")
        out = streaming.stateful_replies(one).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        out.outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert plain(spark.read.parquet(str(tmp_path / "out")).collect()) == plain(answers(single, {})[0])


def test_merges_run_beside_the_store(spark, tmp_path):
    import threading
    import time

    from logloom.streaming.background import merge_regularly

    merge = Merge(check_interval_ms=1500, check_jitter=0.1, triggers=Triggers(0.3, 10**9), thresholds=Thresholds(0.3, 10**9, 0))
    store = KeyedLog.open(spark, str(tmp_path / "s"), Storage(merge=merge))
    store.set(b"k", b"1")
    store.set(b"k", b"2")
    stop = threading.Event()
    thread = merge_regularly(store, stop)
    began = time.time()
    while not store.manifest()["hints"] and time.time() < began + 120:
        time.sleep(0.2)
    stop.set()
    thread.join(60)
    assert store.stats().agg(F.sum("dead_keys")).first()[0] == 0 and live(store) == {b"k": b"2"}
    assert merge_regularly(KeyedLog.open(spark, str(tmp_path / "t"), Storage(merge=Merge(policy="never"))), stop) is None


def test_a_lookup_filters_in_the_scan(spark, tmp_path):
    store = KeyedLog.open(spark, str(tmp_path / "s"))
    store.set(b"k", b"1")
    plan = store.snapshot().where(F.col("key") == F.lit(bytearray(b"k")))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan.replace("equalto", "EqualTo") or "PushedFilters: [IsNotNull(key), " in plan


def test_command_line(spark, tmp_path):
    from logloom.__main__ import main

    at = str(tmp_path / "s")
    assert [main([at, *a]) for a in (["get", "k"], ["set", "k", "v"], ["get", "k"], ["del", "k", "x"], ["get", "k"])] == [
        "(nil)", '"OK"', '"v"', "(integer) 1", "(nil)",
    ]
