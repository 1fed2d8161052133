"""Problems 2 to 5 on random small tables, against plain Python."""

import random

import numpy as np
import pytest
from logloom.manifests import ConflictError
from logloom.operators import changes, consolidate, heavy, incremental
from pyspark.sql import functions as F

from tests.helpers import LOG_DDL, in_order, plain, random_log, state

FEED_DDL = "feed_seq bigint, change_no bigint, tstamp bigint, key binary, value binary, part string, seen int"


def random_feed(seed):
    rnd = random.Random(seed)
    rows = []
    for change in range(60):
        key = b"hot" if rnd.random() < 0.4 else rnd.choice([b"", b"a", b"\xff\x00", b"b"])
        value = None if rnd.random() < 0.3 else rnd.choice([b"", b"x", b"\xfe"])
        for _ in range(rnd.choice([1, 1, 1, 3])):
            rows.append((change, rnd.randrange(12), key, value))
    rows += [(None, 3, b"a", b"q"), (200, 99, None, b"q"), (201, 99, None, None)]
    rnd.shuffle(rows)
    return [(i, *r, "x", None) for i, r in enumerate(rows)]


def rebuilt(rows):
    least, held = {}, {}
    for _, change, tstamp, key, value, *_ in rows:
        if key is not None and change is not None:
            old = least.get((key, change))
            least[key, change] = (min(tstamp, old[0]) if old else tstamp, value)
    for (key, change), (tstamp, value) in sorted(least.items(), key=lambda x: (x[1][0], x[0][1])):
        held[key] = (value, tstamp, change)
    return {k: v for k, v in held.items() if v[0] is not None}


@pytest.mark.parametrize("seed", range(4))
def test_rebuild_store(spark, seed):
    rows = random_feed(seed)
    got = changes.rebuild_store(spark.createDataFrame(rows, FEED_DDL)).collect()
    assert {bytes(r["key"]): (bytes(r["value"]), r["tstamp"], r["change_no"]) for r in got} == rebuilt(rows)


def test_rebuild_store_of_nothing(spark):
    assert changes.rebuild_store(spark.createDataFrame([], FEED_DDL)).count() == 0


def test_columns_are_applied_one_by_one(spark):
    rows = [
        (1, 1, "insert", 10, "a"), (1, 2, "update", None, "b"), (1, 3, "update", 30, None),
        (2, 1, "insert", 10, "a"), (2, 2, "delete", None, None), (2, 3, "update", None, "c"),
        (3, 1, "insert", 10, "a"), (3, 5, "delete", None, None), (3, 4, "update", 40, "d"),
        (4, 1, "insert", 10, "a"), (4, 2, "replace", 20, None),
        (5, 1, "delete", None, None), (None, 1, "insert", 1, "n"), (6, None, "insert", 1, "early"), (6, 1, "update", 2, None),
    ]
    df = spark.createDataFrame(rows, "id int, seq int, op string, a int, b string")
    fields = {"a": ("a", "a IS NOT NULL"), "b": ("b", "b IS NOT NULL")}
    out = changes.apply_changes(df.union(df), "id", ["seq"], fields, "op = 'delete'", "op = 'replace'")
    assert {r["id"]: (r["a"], r["b"]) for r in out.collect()} == {
        1: (30, "b"), 2: (None, "c"), 4: (20, None), None: (1, "n"), 6: (2, "early"),
    }


def random_runs(seed, rows):
    rnd = random.Random(seed)
    words = ["succeeded", " Succeeded", "SUCCEEDED ", "failed", "started", None, "succeeded in part", "rolled back"]
    ledger = [(i, r, a, rnd.choice(words)) for i, (r, a) in enumerate((r, a) for r in range(6) for a in (1, 2) for _ in range(2))]
    rnd.shuffle(ledger)
    files = sorted({r[0] for r in rows})
    marks = [(rnd.randrange(6), rnd.choice([1, 2]), rnd.choice(files), rnd.choice([None, 0, 40, 90, 5000])) for _ in range(30)]
    return ledger, marks


def unread(rows, ledger, marks):
    last = {}
    for _, run, attempt, status in sorted(ledger):
        last[run, attempt] = (status or "").strip().lower()
    upto = {}
    for run, attempt, fileid, pos in marks:
        if last.get((run, attempt)) == "succeeded" and pos is not None:
            upto[fileid] = max(pos, upto.get(fileid, -1))
    found = {}
    for r in in_order(rows):
        found.setdefault((r[4], r[3]), []).append((r[0], r[1]))
    return sorted(min(p) for p in found.values() if not any(pos <= upto.get(f, -1) for f, pos in p))


@pytest.mark.parametrize(("seed", "small"), [(0, 8), (1, 0), (2, 0)])
def test_unread_records(spark, tmp_path, monkeypatch, seed, small):
    monkeypatch.setattr(incremental, "SMALL_SHARE", small)
    rows = random_log(seed)
    ledger, marks = random_runs(seed, rows)
    log = spark.createDataFrame(rows, LOG_DDL).withColumn("seen", F.lit("clash")).withColumn("part", F.lit(1))
    runs = spark.createDataFrame(ledger, "line_no bigint, run_id bigint, attempt bigint, status string")
    marked = spark.createDataFrame(marks, "run_id bigint, attempt bigint, fileid bigint, upto_pos bigint")
    got = incremental.unread_records(log, marked, runs, str(tmp_path / "store"), parts=3)
    assert sorted((r["fileid"], r["pos"]) for r in got.collect()) == unread(rows, ledger, marks)


def test_unread_records_without_rows_or_runs(spark, tmp_path):
    runs = spark.createDataFrame([], "line_no bigint, run_id bigint, attempt bigint, status string")
    marked = spark.createDataFrame([], "run_id bigint, attempt bigint, fileid bigint, upto_pos bigint")
    empty = spark.createDataFrame([], LOG_DDL)
    assert incremental.unread_records(empty, marked, runs, str(tmp_path / "a")).count() == 0
    one = spark.createDataFrame([(1, 0, 18, 5, b"k", None), (1, 0, 18, 5, b"k", None), (None, 0, 18, 5, b"k", None)], LOG_DDL)
    assert [tuple(r)[2:] for r in incremental.unread_records(one, marked, runs, str(tmp_path / "b")).collect()] == [(1, 0)]


def brought_out(rows):
    return sorted((r["fileid"], r["pos"]) for r in rows.collect())


def test_runs_bring_out_each_record_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_SETS", 2)
    rows = random_log(7, files=30, most=6)
    files = sorted({r[0] for r in rows})
    reader = incremental.UnreadRecords(spark, str(tmp_path / "s"), parts=4, shelf=2)
    delivered = {}
    for until in (6, 6, 14, 22, 30):
        have = [r for r in rows if r[0] in files[:until]]
        if until == 14:
            # As merges do: a record is copied into a newer file, and the older file is gone.
            have = [r for r in have if r[0] != files[0]] + [(files[13], 10_000 + i, *r[2:]) for i, r in enumerate(rows) if r[0] == files[0]]
        log = spark.createDataFrame(have, LOG_DDL)
        lost, _, _ = reader.prepare(log)
        new = reader.run(log)
        assert brought_out(new) == brought_out(lost)
        for r in new.collect():
            assert (bytes(r["key"]), r["tstamp"]) not in delivered
            delivered[bytes(r["key"]), r["tstamp"]] = (r["fileid"], r["pos"])
        if until == 6 and reader.last_run()["run"] == 2:
            assert reader.last_run()["changed"] == 0 and new.count() == 0
    lowest = {}
    for r in in_order(rows):
        lowest.setdefault((r[4], r[3]), r[:2])
    assert delivered == lowest
    # Partitions have become wider, and still only what changed is read.
    assert reader.last_run()["width"] * 8 >= files[-1] - files[6]
    assert reader.vacuum() > 3 and reader.vacuum() == 0
    again = spark.createDataFrame([*rows, (files[3], 9_999, 1, 77, b"late", None)], LOG_DDL)
    assert brought_out(reader.run(again)) == [(files[3], 9_999)] and reader.last_run()["changed"] == 1


def test_of_two_runs_at_once_one_fails(spark, tmp_path):
    log = spark.createDataFrame(random_log(1), LOG_DDL)
    a, b = (incremental.UnreadRecords(spark, str(tmp_path / "s")) for _ in range(2))
    _, made, number = a.prepare(log)
    b.run(log)
    with pytest.raises(ConflictError):
        a.commit(made, number)
    with pytest.raises(ValueError, match="own runs"):
        a.adopt(log, log, log)


def test_only_changed_partitions_are_computed(spark, tmp_path):
    table = incremental.IncrementalTable(spark, str(tmp_path / "t"))
    given = []

    def compute(rows):
        given.append(sorted({r["p"] for r in rows.collect()}, key=str))
        return rows.where("v IS NOT NULL").select("p", (F.col("v") * 2).alias("twice"))

    def run(rows):
        source = spark.createDataFrame(rows, "p bigint, v int")
        return sorted((r["p"], r["twice"]) for r in table.refresh(source, "p", ["p", "v"], compute).collect())

    assert run([(1, 1), (1, 2), (2, 5), (3, 7)]) == [(1, 2), (1, 4), (2, 10), (3, 14)]
    assert run([(2, 5), (1, 2), (1, 1), (3, 7)]) == [(1, 2), (1, 4), (2, 10), (3, 14)]
    assert run([(1, 1), (1, 3), (2, None), (4, 1)]) == [(1, 2), (1, 6), (4, 2)]
    assert given == [[1, 2, 3], [], [1, 2, 4]]


def test_a_run_that_fails_repeats_its_partitions(spark, tmp_path):
    table = incremental.IncrementalTable(spark, str(tmp_path / "t"))
    source = spark.createDataFrame([(1, 1), (2, 2)], "p bigint, v int")
    failing = lambda rows: rows.select("p", F.expr("CAST(raise_error('lost') AS int)").alias("v"))
    table.refresh(source.where("p = 1"), "p", ["v"], lambda rows: rows.select("p", "v"))
    with pytest.raises(Exception, match="lost"):
        table.refresh(source, "p", ["v"], failing)
    assert [r["part"] for r in table.before().collect()] == [1]
    done = []

    def compute(rows):
        done.extend(r["p"] for r in rows.collect())
        return rows.select("p", "v")

    assert sorted(tuple(r) for r in table.refresh(source, "p", ["v"], compute).select("p", "v").collect()) == [(1, 1), (2, 2)]
    assert done == [2]


def kept(rows, small):
    once = in_order(rows)
    sizes = {}
    for r in once:
        sizes[r[0]] = sizes.get(r[0], 0) + r[2]
    newest, hidden = {}, set()
    for r in once:
        newest[r[4]] = r
        if sizes[r[0]] >= small and r[5] is not None:
            hidden.add(r[4])
    return sorted(r[:2] for r in newest.values() if sizes[r[0]] < small and (r[5] is not None or r[4] in hidden))


@pytest.mark.parametrize("seed", range(3))
def test_consolidation_keeps_what_is_needed(spark, seed):
    rows = random_log(seed, files=14)
    log = spark.createDataFrame([*rows, (None, 1, 1, 1, b"z", b"z"), (1, None, 1, 1, b"z", b"z"), (1, 1, 1, 1, None, b"z")], LOG_DDL)
    small = 250
    got = consolidate.kept_of(log, consolidate.small_files(log, small))
    assert sorted((r["fileid"], r["pos"]) for r in got.collect()) == kept(rows, small)
    # The store is the same after the small files were replaced by what is kept of them.
    sizes = {r["fileid"]: r["bytes"] for r in consolidate.file_sizes(log).collect()}
    at = {(r["fileid"], r["pos"]) for r in got.collect()}
    after = [r for r in rows if sizes[r[0]] >= small or r[:2] in at]
    assert {k: r[5] for k, r in state(after).items()} == {k: r[5] for k, r in state(rows).items()}


@pytest.mark.parametrize(("block", "target"), [(1, 300), (4, 300), (4096, 40), (7, 10**6)])
def test_merged_runs_lose_and_repeat_nothing(spark, tmp_path, monkeypatch, block, target):
    monkeypatch.setattr(consolidate, "BLOCK_RECORDS", block)
    monkeypatch.setattr(consolidate, "FILES_PER_RANGE", 3)
    rows = [*random_log(5, files=20), (900, 0, None, 1, b"no len", b"v")]
    log = spark.createDataFrame(rows, LOG_DDL).withColumn("range_no", F.lit("clash")).repartition(6)
    ranges = consolidate.key_ranges(log, target)
    runs = consolidate.stored(consolidate.sorted_runs(log, ranges), str(tmp_path / "runs"))
    blocks = runs.collect()
    assert len({r["run"] for r in blocks}) > 1 and max(r["records"] for r in blocks) <= block
    got = consolidate.merge_runs(runs, ranges.n, target).collect()
    assert plain([tuple(r)[4:] for r in got]) == plain(rows)
    files = {}
    for r in got:
        assert r["tombstone"] == (r["value"] is None)
        files.setdefault((r["range_no"], r["tombstone"], r["file_no"]), []).append(r)
    assert (ranges.n > 1) == (target < 10**6) and len({f[0] for f in files}) == ranges.n
    before = {}
    for (range_no, gone, no), members in sorted(files.items()):
        assert [r["new_pos"] for r in members] == [sum(r["len"] or 0 for r in members[:i]) for i in range(len(members))]
        # A file is closed after the record that takes it over the target, not before.
        assert sum(r["len"] or 0 for r in members[:-1]) <= target
        order = [(bytes(r["key"]), r["fileid"], r["pos"]) for r in members]
        assert order == sorted(order) and before.get(gone, order[0]) <= order[0]
        before[gone] = order[-1]
        if (range_no, gone, no + 1) in files:
            assert sum(r["len"] or 0 for r in members) > target


def test_consolidated_files_are_a_log_with_ranges(spark, tmp_path):
    rows = random_log(6, files=20)
    log = spark.createDataFrame(rows, LOG_DDL)
    made = consolidate.consolidate_small(log, str(tmp_path / "c"), 250, 300)
    assert sorted((r["old_fileid"], r["old_pos"]) for r in made.files.collect()) == kept(rows, 250)
    first = max(r[0] for r in rows) + 1
    by_file = {}
    for r in made.files.collect():
        by_file.setdefault(r["fileid"], []).append(r)
    meta = {r["fileid"]: r for r in made.ranges.collect()}
    assert set(meta) == set(by_file) and min(meta) >= first
    for i, members in by_file.items():
        assert bytes(meta[i]["min_key"]) == min(bytes(r["key"]) for r in members) and bytes(meta[i]["max_key"]) == max(bytes(r["key"]) for r in members)
        assert (meta[i]["records"], meta[i]["bytes"]) == (len(members), sum(r["len"] for r in members))
        assert {(r["value"] is None) for r in members} == {(i - first) % 2 == 1}
    numbers = {r["fileid"]: (r["tombstone"], r["file_no"]) for r in made.file_numbers().collect()}
    for gone in (False, True):
        assert [numbers[i] for i in sorted(meta) if (i - first) % 2 == gone] == [(gone, k) for k in range(sum((i - first) % 2 == gone for i in meta))]
    assert made.overlaps().first()["n"] == 0
    made.ranges = made.ranges.withColumn("max_key", F.lit(bytearray(b"\xff" * 9)))
    assert made.overlaps().first()["n"] == len(meta) - 2
    empty = consolidate.consolidate_small(log.limit(0), str(tmp_path / "e"))
    assert empty.overlaps().first()["n"] == 0
    assert empty.files.count() == 0 and empty.ranges.count() == 0


def test_too_many_files_in_a_range_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(consolidate, "IDS_PER_RANGE", 2)
    monkeypatch.setattr(consolidate, "MOST_RANGES", 1)
    with pytest.raises(Exception, match="needs more than 2 files"):
        consolidate.consolidate_small(spark.createDataFrame(random_log(6, files=20), LOG_DDL), str(tmp_path / "c"), 10**6, 20)


@pytest.mark.parametrize("limit", [0, 1, 9, 10, 50])
def test_files_are_closed_by_size(limit):
    rnd = random.Random(limit)
    lens = [rnd.choice([0, 0, 1, 5, 9, 30]) for _ in range(200)]
    expected, no, filled = [], 0, 0
    for n in lens:
        expected.append((no, filled))
        filled += n
        if filled > limit:
            no, filled = no + 1, 0
    got, state_ = [], (0, 0)
    for i in range(0, 200, 23):
        files, places, *state_ = consolidate.close_by_size(np.array(lens[i : i + 23]), limit, *state_)
        got += zip(files.tolist(), places.tolist())
    assert got == expected and tuple(state_) == (filled, no)


@pytest.mark.parametrize("seed", range(3))
def test_key_totals_and_heavy_keys(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame([*rows, (1, 1, None, None, b"solo", None), (None, 1, 1, 1, b"z", b"z")], LOG_DDL).withColumn("records", F.lit(0))
    expected = {b"solo": (1, 0, 1, 1, None)}
    for r in in_order(rows):
        n, size, *_ = expected.get(r[4], (0, 0))
        expected[r[4]] = (n + 1, size + r[2], r[0], r[1], r[3])
    assert "SortAggregate" not in heavy.key_totals(log)._jdf.queryExecution().executedPlan().toString()
    got = heavy.with_newest_times(heavy.key_totals(log), log).collect()
    assert {bytes(r["key"]): tuple(r)[1:] for r in got} == expected
    total = sum(v[0] for v in expected.values())
    names = {bytes(r["key"]) for r in heavy.heavy_keys(log, 8).collect()}
    assert names == {k for k, v in expected.items() if v[0] * 8 >= total} and names
    assert heavy.heavy_keys(log.limit(0)).count() == 0
