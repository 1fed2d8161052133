import pytest
from logloom.sources import records

from tests.helpers import LOG_DDL, plain, random_log, state


def test_records_and_hints():
    rows = [(-5, b"", b""), (2**62, b"k\x00", None), (0, b"k", b"v" * 300)]
    data = b"".join(records.encode_data(*r) for r in rows)
    got = list(records.decode_data(data))
    assert [r[2:] for r in got] == rows and [r[1] for r in got] == [25, 19, 326] and [r[0] for r in got] == [0, 25, 44]
    for cut in range(len(data)):
        assert list(records.decode_data(data[:cut])) == [r for r in got if r[0] + r[1] <= cut]
    with pytest.raises(ValueError):
        list(records.decode_data(data[:16] + b"\x07" + data[17:]))


def test_expressions_write_the_same_bytes(spark):
    df = spark.createDataFrame([(-5, 7, 9, b"k\xff", b""), (2**62, 7, 9, b"", None)], "tstamp long, len long, pos long, key binary, value binary")
    for r in df.select("*", records.data_record().alias("d"), records.hint_record().alias("h")).collect():
        value = None if r["value"] is None else bytes(r["value"])
        assert bytes(r["d"]) == records.encode_data(r["tstamp"], bytes(r["key"]), value)
        assert list(records.decode_hints(bytes(r["h"]) + b"\x01")) == [(0, len(r["h"]), r["tstamp"], 7, 9, bytes(r["key"]))]
        assert bytes(r["h"]) == records.encode_hint(r["tstamp"], 7, 9, bytes(r["key"]))


def test_files_in_pieces():
    rows = [(i, bytes([i]) * (i % 5), None if i % 3 == 0 else b"v" * i) for i in range(40)]
    data = b"".join(records.encode_data(*r) for r in rows)
    whole = list(records.decode_data(data))
    for size in (1, 7, 100, 10**6):
        pieces = [data[i : i + size] for i in range(0, len(data), size)]
        assert list(records.decode_pieces(pieces, records.decode_data)) == whole
    assert list(records.decode_pieces([data[:-1]], records.decode_data)) == whole[:-1]
    assert list(records.decode_pieces([], records.decode_data)) == []


def test_files(spark, tmp_path):
    rows = random_log(2)
    log = spark.createDataFrame(rows, LOG_DDL)
    for piece in (1, 50, records.PIECE):
        assert plain(records.from_images(records.images(log, piece)).collect()) == plain(set(rows))
    assert records.from_images(records.images(log.limit(0))).count() == 0
    folder = str(tmp_path / "files")
    records.write_files(log, folder)
    for name in ("notes.data", "5.log.hint"):
        (tmp_path / "files" / name).write_bytes(b"x")
    last = max((tmp_path / "files").glob("[0-9]*.data"), key=lambda p: int(p.name.split(".")[0]))
    last.write_bytes(last.read_bytes() + b"\x01" * 9)  # a record that was cut off
    assert plain(records.read_files(spark, folder).collect()) == plain(set(rows))
    assert plain(spark.read.format("logrecords").load(folder).collect()) == plain(set(rows))
    with pytest.raises(Exception, match="exist|Exist"):
        records.write_files(log, folder)
    assert not list((tmp_path / "files").glob(".[0-9]*"))


def test_recovery_from_a_folder(spark, tmp_path):
    rows = random_log(4)
    log = spark.createDataFrame(rows, LOG_DDL)
    folder = f"file://{tmp_path}/files"
    records.write_files(log, folder)
    hinted = sorted({r[0] for r in rows})[:4]
    # Hints of the first files: their live records, as after a merge. Tombstones of these files are gone with it.
    live = [r for r in state(rows).values() if r[0] in hinted]
    hints = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4]) for r in live] + [(999, 0, 9, 9, b"orphan")], "fileid long, pos long, len long, tstamp long, key binary")
    records.write_hint_files(hints, folder)
    assert plain(records.read_hint_files(spark, folder).collect()) == plain(hints.collect())
    got = {bytes(r["key"]): (r["fileid"], r["pos"]) for r in records.recover_folder(spark, folder).collect()}
    assert got == {k: r[:2] for k, r in state(rows).items()}
    with pytest.raises(Exception, match="exist|Exist"):
        records.write_hint_files(hints, folder)
