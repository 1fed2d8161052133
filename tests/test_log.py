import pytest
from logloom.config import Merge, Thresholds, Triggers
from logloom.functions import scalars
from logloom.operators import compaction, consolidate, log, stats
from logloom.schema import LOG
from pyspark.sql import functions as F

from tests.helpers import LOG_DDL, in_order, plain, random_log, size, state

BAD = [(None, 1, 1, 1, b"z", b"z"), (1, None, 1, 1, b"z", b"z"), (1, 1, 1, 1, None, b"z")]


def make(spark, rows):
    """A log with rows that hold no record and columns whose names operators use themselves."""
    df = spark.createDataFrame(rows + BAD, LOG_DDL)
    return df.withColumns({c: F.lit("clash") for c in ("n", "live", "rest", "chosen", "newest", "r")})


@pytest.mark.parametrize("seed", range(3))
def test_scan_and_snapshot(spark, seed):
    rows = random_log(seed)
    df = make(spark, rows)
    assert plain(log.scan(df).select("fileid", "pos", "len", "tstamp", "key", "value").collect()) == plain(set(rows))
    got = {bytes(r["key"]): (r["fileid"], r["pos"], bytes(r["value"])) for r in log.snapshot(df).collect()}
    assert got == {k: (r[0], r[1], r[5]) for k, r in state(rows).items()}


def test_get_batch(spark):
    rows = [(1, 0, 27, 5, b"k", b""), (1, 27, 27, 5, b"gone", b"x"), (2, 0, 21, 1, b"gone", None), (2, 21, 25, 1, b"", b"\xff")]
    requests = spark.createDataFrame([(1, b"k", "x"), (2, b"gone", "x"), (3, b"", "x"), (4, None, "x"), (5, b"k", "x"), (5, b"k", "x")], "id int, key binary, found string")
    got = log.get_batch(requests, make(spark, rows))
    assert got.columns == ["id", "key", "found", "value"]
    assert plain(got.drop("key").collect()) == plain([(1, True, b""), (2, False, None), (3, True, b"\xff"), (4, False, None), (5, True, b""), (5, True, b"")])
    assert log.get_batch(requests, make(spark, [])).where("found").count() == 0


def test_deletes(spark):
    rows = [(1, 0, 27, 5, b"a", b"1"), (1, 27, 27, 5, b"b", b"2"), (1, 54, 18, 5, b"b", None)]
    keys = spark.createDataFrame([(b"a",), (b"a",), (b"b",), (b"c",), (None,)], "key binary")
    snap = log.snapshot(make(spark, rows))
    assert log.del_count(keys, snap).first()["deleted"] == 1
    assert plain(log.deleted(keys, snap).collect()) == plain([(b"a", True), (b"b", False), (b"c", False)])
    assert log.del_count(keys.limit(0), snap).first()["deleted"] == 0


def test_appended_batch_keeps_its_order(spark):
    batch = [(i, i, bytes([i % 3]), None if i % 5 == 0 else b"v" * (i % 7)) for i in range(200)]
    new = log.as_records(spark.createDataFrame(batch, "seq long, tstamp long, key binary, value binary").repartition(5), 40, 300).collect()
    new.sort(key=lambda r: (r["fileid"], r["pos"]))
    assert [r["tstamp"] for r in new] == list(range(200)) and new[0]["fileid"] >= 40
    files = {}
    for r in new:
        assert r["pos"] == files.get(r["fileid"], 0) and r["len"] == size(bytes(r["key"]), r["value"])
        assert r["pos"] <= 300
        files[r["fileid"]] = r["pos"] + r["len"]


@pytest.mark.parametrize("limit", [0, 10, 59, 60, 61, 1000])
def test_rotation(spark, limit):
    rows = [(w, i, 10 + (7 * i) % 13 if i else 60) for w in (1, 2, None) for i in range(20)]
    got = log.rotate(spark.createDataFrame(rows, "w int, seq int, len long").repartition(3), "w", ["seq"], limit).collect()
    expected = []
    for w in (1, 2, None):
        segment = filled = 0
        for i in range(20):
            n = next(r[2] for r in rows if r[:2] == (w, i))
            expected.append((w, i, n, segment, filled))
            filled += n
            if filled > limit:
                segment, filled = segment + 1, 0
    assert plain(got) == plain(expected)


def test_sizes_names_and_ids(spark):
    df = spark.createDataFrame([(b"", None), (b"k", b""), (b"kk", b"vvv"), (None, b"v")], "key binary, value binary")
    assert [r[0] for r in df.select(scalars.record_size()).collect()] == [17, 26, 30, None]
    assert [r[0] for r in df.select(scalars.hint_size()).collect()] == [32, 33, 34, None]
    names = ["9.log.data", "10.log.data", "9.log.data", "11.log.hint", "x.data", "1.2.3.data", "12", "-3.x.data", None, "99999999999999999999.data"]
    ids = spark.createDataFrame([(n,) for n in names], "name string").select(scalars.file_id("name").alias("i"))
    assert [r[0] for r in ids.where("i IS NOT NULL").distinct().orderBy("i").collect()] == [1, 9, 10]
    assert log.next_fileid(make(spark, [])).first()[0] == 2
    assert log.next_fileid(spark.createDataFrame([], LOG_DDL)).first()[0] == 0


def totals(df):
    r = stats.segment_stats(df).agg(F.sum("live_keys"), F.sum("dead_keys")).first()
    return (r[0], r[1])


def test_golden_statistics(spark):
    def records(start, first, last, value):
        n = spark.range(first, last)
        key = F.encode(F.concat(F.lit("key"), F.col("id").cast("string")), "UTF-8").alias("key")
        return n.select((F.lit(start) + F.floor(F.col("id") / 700)).cast("long").alias("fileid"), F.col("id").alias("pos"), F.lit(30).cast("long").alias("len"), F.lit(0).cast("long").alias("tstamp"), key, value.cast("binary").alias("value"))

    puts = records(0, 0, 10_000, F.lit("v"))
    assert totals(puts) == (10_000, 0)
    again = puts.union(records(100, 0, 5_000, F.lit("w")))
    assert totals(again) == (10_000, 5_000)
    assert totals(again.union(records(200, 0, 5_000, F.lit(None)))) == (5_000, 15_000)


@pytest.mark.parametrize("seed", range(3))
def test_segment_stats(spark, seed):
    rows = random_log(seed)
    live = {r[:2] for r in state(rows).values()}
    expected = {}
    for r in in_order(rows):
        a = expected.setdefault(r[0], [0, 0, 0, 0])
        a[0 if r[:2] in live else 1] += 1
        a[2] += 0 if r[:2] in live else r[2]
        a[3] += r[2]
    got = {r["fileid"]: r for r in stats.segment_stats(make(spark, rows)).collect()}
    assert {k: list(r)[1:5] for k, r in got.items()} == expected
    assert all(r["fragmentation"] == (r["dead_keys"] / (r["dead_keys"] + r["live_keys"]) if r["dead_keys"] else 0.0) for r in got.values())


def test_triggers_are_strict(spark):
    df = spark.createDataFrame([(1, 100, 0.6, 50)], "fileid long, dead_bytes long, fragmentation double, file_bytes long")
    merge = lambda t: stats.merge_trigger(df, t).first()["merge"]
    assert not merge(Triggers(0.6, 100)) and merge(Triggers(0.59, 100)) and merge(Triggers(0.6, 99))
    assert not stats.merge_trigger(df.limit(0), Triggers(0, 0)).first()["merge"]
    chosen = lambda t: stats.merge_candidates(df, t).count()
    assert not chosen(Thresholds(0.6, 100, 50)) and chosen(Thresholds(0.6, 100, 51)) and chosen(Thresholds(0.5, 100, 50))
    always = Merge(triggers=Triggers(0.1, 1))
    assert stats.may_merge(df, always, 3)
    assert not stats.may_merge(df, Merge(policy="never", triggers=always.triggers), 3)
    window = Merge(policy=(2, 4), triggers=always.triggers)
    assert [stats.may_merge(df, window, h) for h in (1, 2, 4, 5)] == [False, True, True, False]
    assert not stats.may_merge(df, Merge(policy=(22, 3), triggers=always.triggers), 23)


@pytest.mark.parametrize("seed", range(4))
def test_merge_leaves_the_state_as_it_was(spark, tmp_path, seed):
    rows = random_log(seed)
    df = make(spark, rows)
    ids = sorted({r[0] for r in rows})[2:7]
    chosen = spark.createDataFrame([(i, i in ids) for i in sorted({r[0] for r in rows})], "fileid long, chosen boolean")
    made = consolidate.consolidate(df, chosen, str(tmp_path / "m"), 1000, 200)
    merged = made.files.select(*LOG.names)
    again = compaction.rewritten(df, chosen).select("fileid", "pos", "len", "tstamp", "key", "value")
    assert plain(again.collect()) == plain(made.files.select("old_fileid", "old_pos", "len", "tstamp", "key", "value").collect())
    after = compaction.unmerged(df, chosen).unionByName(merged)
    got = {bytes(r["key"]): bytes(r["value"]) for r in log.snapshot(after).collect()}
    assert got == {k: r[5] for k, r in state(rows).items()}
    hints = compaction.hints(merged)
    recovered = {bytes(r["key"]): (r["fileid"], r["pos"]) for r in compaction.recover(after, hints).collect()}
    assert recovered == {bytes(r["key"]): (r["fileid"], r["pos"]) for r in log.snapshot(after).collect()}
    # Every value that a tombstone still hides lies in a file outside the merge.
    outside = {r[4] for r in rows if r[0] not in ids and r[5] is not None}
    assert all(bytes(r["key"]) in outside for r in merged.where("value IS NULL").collect())
    assert compaction.rewritten(df, chosen.withColumn("chosen", F.lit(False))).count() == 0
    none = consolidate.consolidate(df, chosen.withColumn("chosen", F.lit(False)), str(tmp_path / "n"), 1000, 200)
    assert none.files.count() == 0 and none.ranges.count() == 0


def test_merge_by_thresholds(spark, tmp_path):
    rows = random_log(5)
    df = make(spark, rows)
    thresholds = Thresholds(0.5, 10**9, 150)
    index = log.index_of(df)
    assert plain(stats.index_stats(index).collect()) == plain(stats.segment_stats(df).collect())
    chosen, made = compaction.merge(df, thresholds, str(tmp_path / "m"), 1000)
    named = {r["fileid"] for r in stats.merge_candidates(stats.segment_stats(df), thresholds).collect()}
    assert named and {r["fileid"] for r in chosen.where("chosen").collect()} == named
    after = compaction.unmerged(df, chosen).unionByName(made.files.select(*LOG.names))
    assert {bytes(r["key"]): bytes(r["value"]) for r in log.snapshot(after).collect()} == {k: r[5] for k, r in state(rows).items()}


def test_a_writer_with_too_many_files_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(log, "FILES_PER_WRITER", 3)
    batch = spark.createDataFrame([(i, i, bytes([i]), b"v" * 10) for i in range(40)], "seq long, tstamp long, key binary, value binary")
    with pytest.raises(Exception, match="a writer needs more than"):
        log.as_records(batch.coalesce(1), 0, 20).collect()


def test_recovery_prefers_hints(spark):
    rows = [(1, 0, 27, 5, b"a", b"1"), (1, 27, 27, 6, b"b", b"2"), (2, 0, 18, 7, b"b", None), (3, 0, 27, 8, b"c", b"3")]
    hint = [(1, 0, 27, 5, b"a"), (1, 0, 27, 5, b"a"), (9, 0, 27, 5, b"orphan")]
    hints = spark.createDataFrame(hint, "fileid long, pos long, len long, tstamp long, key binary")
    got = compaction.recover(make(spark, rows), hints).select("key", "fileid", "pos").collect()
    assert plain(got) == plain([(b"a", 1, 0), (b"c", 3, 0)])
    assert compaction.recover(make(spark, []).limit(0), hints).count() == 0


def test_backoff_and_jitter(spark):
    waits = [r["wait_ms"] for r in scalars.backoff_schedule(spark, 500, 64000).orderBy("attempt").collect()]
    assert waits == [500 * 2**i for i in range(8)]
    assert scalars.backoff_schedule(spark, 10, 5).count() == 0
    assert all(70 <= scalars.jittered(100, 0.3) <= 130 for _ in range(100))
