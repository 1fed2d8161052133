import random

import pytest
from logloom.llm import ledger
from pyspark.sql import functions as F

FEED = "feed_seq long, key binary, first string, known boolean"


def random_feed(seed, start=0):
    rnd = random.Random(seed)
    rows = [(start + i, None if rnd.random() < 0.1 else b"hot" if rnd.random() < 0.4 else bytes([rnd.randrange(60)]), "x", None) for i in range(150)]
    rnd.shuffle(rows)
    return rows


def seen(history, rows):
    known, found = set(history), []
    for seq, key, *_ in sorted(rows):
        if key is not None:
            if key in known:
                found.append(seq)
            known.add(key)
    return found, known


@pytest.mark.parametrize("seed", range(3))
def test_seen_before(spark, tmp_path, seed):
    rows = random_feed(seed)
    olds = [[bytes([i]) for i in range(20)] * 3, [b"", None, b"\x05", bytes([30])]]
    histories = [spark.createDataFrame([(k, 1) for k in o], "key binary, feed_seq int") for o in olds]
    feed = spark.createDataFrame(rows, FEED)
    found = ledger.seen_before(feed, histories, str(tmp_path / "l"), buckets=3)
    expected = seen([k for o in olds for k in o if k is not None], rows)[0]
    assert sorted(r["feed_seq"] for r in found.collect()) == expected
    assert tuple(ledger.wrong_answers(feed, histories, found).first()) == (sum(r[1] is not None for r in rows), len(expected), 0, 0.0)
    less = found.where(F.col("feed_seq") != expected[0])
    assert ledger.wrong_answers(feed, histories, less).first()["n_wrong"] == 1


def test_batches_and_a_ledger_opened_again(spark, tmp_path):
    root = str(tmp_path / "l")
    known, batches = set(), [random_feed(s, 1000 * s) for s in range(3)]
    for n, rows in enumerate(batches):
        book = ledger.KeyLedger(spark, root, buckets=2 if n == 0 else None)
        batch = spark.createDataFrame(rows, FEED)
        new = book.first_arrivals(batch, "feed_seq").cache()
        found = sorted(r["feed_seq"] for r in book.seen(batch, "feed_seq", new).collect())
        expected, known = seen(known, rows)
        assert found == expected
        book.append(new)
        if n == 1:
            book.append(new)  # as after a failure
        assert {bytes(r["key"]) for r in book.keys().collect()} == known
        book.close()


def test_the_ledger_side_is_not_shuffled(spark, tmp_path):
    book = ledger.KeyLedger(spark, str(tmp_path / "l"), buckets=4)
    book.start(spark.createDataFrame([(bytes([i]),) for i in range(50)], "key binary"))
    batch = spark.createDataFrame(random_feed(1), FEED)
    book.append(spark.createDataFrame([(b"own",)], "key binary"))
    with book._planned():
        plan = book.first_arrivals(batch, "feed_seq")._jdf.queryExecution().executedPlan().toString()
    # One shuffle and one sort, those of the batch; both runs of the history are read as they lie.
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count(" Sort [") == 1
    book.close()


def test_a_ledger_keeps_its_buckets_and_keys(spark, tmp_path):
    root = str(tmp_path / "l")
    keys = [(bytes([i]),) for i in range(200)]
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        ledger.KeyLedger(spark, root).start(spark.createDataFrame(keys, "key binary"))
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        book = ledger.KeyLedger(spark, root)
        assert book.buckets == 8
        batch = spark.createDataFrame([(i, k) for i, (k,) in enumerate(keys)] + [(999, b"new")], "feed_seq long, key binary")
        assert [bytes(r["key"]) for r in book.first_arrivals(batch, "feed_seq").collect()] == [b"new"]
        book.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)
    for wrong in ({"buckets": 16}, {"key_type": "string"}):
        with pytest.raises(ledger.LedgerError):
            ledger.KeyLedger(spark, root, **wrong)


def test_runs_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "FAN_IN", 3)
    book = ledger.KeyLedger(spark, str(tmp_path / "l"), buckets=2)
    for i in range(10):
        # Each key comes in two batches, as after a failure.
        book.append(spark.createDataFrame([(bytes([i]),), (bytes([i + 1]),)], "key binary"))
    assert [r["level"] for r in book.runs()] == [2, 0]
    assert {bytes(r["key"]) for r in book.keys().collect()} == {bytes([i]) for i in range(11)}
    book.vacuum()
    assert len(list((tmp_path / "l/runs").iterdir())) == 2
    batch = spark.createDataFrame([(i, bytes([i])) for i in range(13)], "feed_seq long, key binary")
    assert sorted(r["first"] for r in book.first_arrivals(batch, "feed_seq").collect()) == [11, 12]
    book.close()


@pytest.mark.parametrize("sessions", [None, [3, 7]])
def test_batches_are_as_one(spark, tmp_path, sessions):
    rows = random_feed(4)
    old = [spark.createDataFrame([(bytes([i]),) for i in range(20)], "key binary")]
    parts = [spark.createDataFrame([r for r in rows if r[0] in span], FEED) for span in (range(60), range(60, 150))]
    found = ledger.seen_in_batches(parts, old, str(tmp_path / "l"), sessions=sessions)
    assert sorted(r["feed_seq"] for r in found.collect()) == seen([bytes([i]) for i in range(20)], rows)[0]


def test_empty_tables(spark, tmp_path):
    none, feed = spark.createDataFrame([], "key binary"), spark.createDataFrame([], FEED)
    one = spark.createDataFrame([(1, b"", "x", None), (1, b"", "x", None), (2, b"", "x", None), (3, None, "x", None), (None, b"", "x", None)], FEED)
    assert ledger.seen_before(feed, [none], str(tmp_path / "a")).count() == 0
    assert [r["feed_seq"] for r in ledger.seen_before(one, [none], str(tmp_path / "b")).collect()] == [2]
    found = ledger.seen_before(feed, [none], str(tmp_path / "c"))
    assert tuple(ledger.wrong_answers(feed, [none], found).first()) == (0, 0, 0, 0.0)


def test_stream(spark, tmp_path):
    batches = [random_feed(s, 1000 * s) for s in (1, 2)]
    book = ledger.KeyLedger(spark, str(tmp_path / "l"), buckets=2)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FEED).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
        stream = spark.readStream.schema(FEED).parquet(str(tmp_path / "in/*"))
        ledger.watch(stream, book, str(tmp_path / "found"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    got = [r["feed_seq"] for r in spark.read.parquet(str(tmp_path / "found")).collect()]
    one, known = seen(set(), batches[0])
    assert sorted(got) == one + seen(known, batches[1])[0]
    book.close()
