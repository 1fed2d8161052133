"""Reading, appending to and looking up in a log.

A log has the columns ``fileid, pos, len, tstamp, key, value``. Its order is ``(fileid, pos)``; the
newest record of a key counts, whatever its ``tstamp``. A NULL value is a tombstone, an empty one a value.
Rows without ``key``, ``fileid`` or ``pos`` hold no record; a record that is there several times
counts once. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.scalars import record_size
from logloom.operators.consolidate import close_by_size
from logloom.operators.replay import BLOCK, with_previous

#: Ids that each writer of a batch may use; one that needs more is an error.
FILES_PER_WRITER = 1 << 20


def records(log: DataFrame) -> DataFrame:
    return log.where("key IS NOT NULL AND fileid IS NOT NULL AND pos IS NOT NULL")


def scan(log: DataFrame) -> DataFrame:
    """Each record once, with all its columns; of rows that disagree on a position, the larger."""
    rest = F.max(F.struct("len", "tstamp", "value")).alias("rest")
    return records(log).groupBy("fileid", "pos", "key").agg(rest).select("fileid", "pos", "rest.len", "rest.tstamp", "key", "rest.value")


def narrow(log: DataFrame) -> DataFrame:
    """``fileid, pos, len, tstamp, key, tombstone`` of each record, as often as it is there."""
    return records(log).select("fileid", "pos", "len", "tstamp", "key", F.col("value").isNull().alias("tombstone"))


def index_of(log: DataFrame) -> DataFrame:
    """``fileid, pos, key, len, tstamp, tombstone`` of each record, once: the log without its values."""
    last = [F.max("len").alias("len"), F.max("tstamp").alias("tstamp"), F.min(F.col("value").isNull()).alias("tombstone")]
    return records(log).groupBy("fileid", "pos", "key").agg(*last)


def newest(log: DataFrame) -> DataFrame:
    """``key, value, fileid, pos, len, tstamp, tombstone`` of the newest record of each key.

    Both aggregates fold the records of a key in each task before the shuffle, so that a hot
    key moves as one row for each task. A window over the key would gather it in one. Values
    move only if they are asked for.
    """
    at = F.struct("fileid", "pos")
    last = F.max(F.struct("fileid", "pos", "len", "tstamp", F.col("value").isNull().alias("tombstone"))).alias("r")
    return records(log).groupBy("key").agg(F.max_by("value", at).alias("value"), last).select("key", "value", "r.*")


def snapshot(log: DataFrame) -> DataFrame:
    """``key, value, fileid, pos, len, tstamp`` of each live key. A filter on ``key`` reaches the scan."""
    return newest(log).where("NOT tombstone").drop("tombstone")


def _with_values(requests: DataFrame, hits: DataFrame) -> DataFrame:
    own = [c for c in requests.columns if c not in ("found", "value")]
    joined = requests.select(*own).join(hits, "key", "left")
    return joined.select(*own, F.col("_value").isNotNull().alias("found"), F.col("_value").alias("value"))


def get_batch(requests: DataFrame, log: DataFrame) -> DataFrame:
    """All columns of ``requests``, then ``found`` and ``value``: what each request's key holds.

    ``requests`` has ``key``; a NULL or absent key is not found. A column of it that is called
    ``found`` or ``value`` is replaced. Only records of asked keys are folded; AQE
    splits keys that are asked for very often.
    """
    asked = requests.select("key").where("key IS NOT NULL").distinct()
    hits = snapshot(records(log).select("key", "value", "fileid", "pos", "len", "tstamp").join(asked, "key", "left_semi"))
    return _with_values(requests, hits.select("key", F.col("value").alias("_value")))


def get_by_index(requests: DataFrame, index: DataFrame, log: DataFrame, bits: int) -> DataFrame:
    """The same by an index, ``key, fileid, pos, tombstone``, of whose rows the newest of each key counts.

    ``log`` has also ``writer``, the file id without its last ``bits`` bits, by which it is partitioned. Places of the asked keys are found
    without values; then only the partitions that hold them are read.
    """
    asked = requests.select("key").where("key IS NOT NULL").distinct()
    last = F.max(F.struct("fileid", "pos", "tombstone")).alias("r")
    places = index.join(asked, "key", "left_semi").groupBy("key").agg(last).select("key", "r.*").where("NOT tombstone").drop("tombstone")
    # File ids aren't negative. Spark prunes partitions by a join only if it takes the other side for selective, as after a comparison.
    places = places.where("fileid >= 0").withColumn("writer", F.shiftright("fileid", bits))
    values = log.select("writer", "fileid", "pos", F.col("value").alias("_value")).join(places, ["writer", "fileid", "pos"]).select("key", "_value")
    return _with_values(requests, values.dropDuplicates(["key"]))


def read_at(log: DataFrame, places: DataFrame) -> DataFrame:
    """The records at some places, ``fileid, pos``, with all columns of a log, each once; places where none begins give no row.

    Their files are a filter of the scan, before values move.
    """
    own = records(log).select("fileid", "pos", "len", "tstamp", "key", "value")
    asked = places.where("fileid IS NOT NULL AND pos IS NOT NULL").select("fileid", "pos").distinct()
    return scan(own.join(asked.select("fileid").distinct(), "fileid", "left_semi").join(asked, ["fileid", "pos"], "left_semi"))


def next_fileid(log: DataFrame) -> DataFrame:
    """``fileid`` of the next file: one more than the largest, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("fileid") + 1, F.lit(0)).cast("bigint").alias("fileid"))


def positions(log: DataFrame) -> DataFrame:
    """``fileid, pos, new_pos``: where each record lies if files are laid out without gaps.

    The window runs within a file, whose size is bounded.
    """
    before = Window.partitionBy("fileid").orderBy("pos", "key").rowsBetween(Window.unboundedPreceding, -1)
    return scan(log).select("fileid", "pos", F.coalesce(F.sum("len").over(before), F.lit(0)).alias("new_pos"))


def rotate(rows: DataFrame, by: str, order: list[str], max_bytes: int) -> DataFrame:
    """Adds ``segment`` and ``segment_pos`` to rows with ``len``: files closed by size.

    Each value of ``by`` is a writer of its own, which appends its rows by ``order``. A file is
    closed after the record that takes it over ``max_bytes``, so it may exceed that by one
    record. The fold over a writer's rows can't be split; rows stream through it one batch at
    a time, and writers spread over all tasks. A NULL ``len`` counts as no bytes.
    """
    ready = rows.repartition(by).sortWithinPartitions(by, *order)
    schema = ready.select("*", F.lit(0).cast("bigint").alias("segment"), F.lit(0).cast("bigint").alias("segment_pos")).schema
    at_by, at_len = rows.columns.index(by), rows.columns.index("len")

    def fold(batches):
        import pyarrow as pa

        now, filled, segment, begun = None, 0, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            writers = batch.column(at_by)
            lens = batch.column(at_len).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            # Where the writer changes: equal values lie together, and NULL is a writer like others.
            codes = writers.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            segments, places = np.empty(len(lens), np.int64), np.empty(len(lens), np.int64)
            for i, j in zip(edges, edges[1:], strict=False):
                writer = writers[i].as_py()
                if not begun or writer != now:
                    now, filled, segment, begun = writer, 0, 0, True
                segments[i:j], places[i:j], filled, segment = close_by_size(lens[i:j], max_bytes, filled, segment)
            columns = [*batch.columns, pa.array(segments), pa.array(places)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ready.mapInArrow(fold, schema)


def as_records(batch: DataFrame, first_fileid: int, max_bytes: int, order: str = "seq") -> DataFrame:
    """A batch of ``seq, tstamp, key, value`` as records of new files from ``first_fileid`` on.

    Spark's range partitions are writers: each takes a run of ``order`` and fills files of its own
    ids, so that ``(fileid, pos)`` goes up with ``order`` over the whole batch without a global
    count. Ids have gaps. Rows without ``key`` are left out; equal ``order`` goes by key.
    """
    ready = (
        batch.where("key IS NOT NULL")
        .select(order, "tstamp", "key", "value", record_size().alias("len"))
        .repartitionByRange(order, "key")
        .sortWithinPartitions(order, "key")
        .withColumn("writer", F.spark_partition_id())
    )
    schema = ready.select(
        F.lit(0).cast("bigint").alias("fileid"), F.lit(0).cast("bigint").alias("pos"), "len", "tstamp", "key", "value"
    ).schema

    def fold(batches):
        import pyarrow as pa

        filled, file_no = 0, 0
        for rows in batches:
            if not rows.num_rows:
                continue
            lens = rows.column("len").to_numpy(zero_copy_only=False)
            files, places, filled, file_no = close_by_size(lens, max_bytes, filled, file_no)
            if file_no >= FILES_PER_WRITER:
                raise ValueError(f"a writer needs more than {FILES_PER_WRITER} files; take larger files or smaller batches")
            ids = first_fileid + rows.column("writer").to_numpy(zero_copy_only=False).astype(np.int64) * FILES_PER_WRITER + files
            columns = [pa.array(ids), pa.array(places), *(rows.column(c) for c in ("len", "tstamp", "key", "value"))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ready.mapInArrow(fold, schema)


def deleted(keys: DataFrame, snap: DataFrame) -> DataFrame:
    """``key, existed`` for each distinct key to delete: whether it was live."""
    asked = keys.where("key IS NOT NULL").select("key").distinct()
    live = snap.select("key", F.lit(True).alias("live"))
    return asked.join(live, "key", "left").select("key", F.coalesce("live", F.lit(False)).alias("existed"))


def del_count(keys: DataFrame, snap: DataFrame) -> DataFrame:
    """``deleted``: how many of the keys were live; a key counts once however often it is named."""
    return deleted(keys, snap).agg(F.count_if("existed").alias("deleted"))


def replaced(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """``fileid, pos, old_fileid, old_pos``: what each record of a key replaced, NULL if the key wasn't live.

    A key's history is cut into blocks of about ``block`` records of the log, as in a replay, so a hot key is spread.
    """
    at = F.encode(F.concat(F.col("fileid").cast("string"), F.lit(":"), F.col("pos").cast("string")), "UTF-8")
    op = F.when(F.col("tombstone"), "DEL").otherwise("SET")
    rows = index_of(log).select(F.col("fileid").alias("seq"), F.col("pos").alias("idx"), op.alias("op"), "key", at.alias("value"))
    old = F.when(F.col("previous.op") == "SET", F.split(F.col("previous.value").cast("string"), ":"))
    return with_previous(rows, None, block).select(
        F.col("seq").alias("fileid"), F.col("idx").alias("pos"), F.get(old, F.lit(0)).cast("bigint").alias("old_fileid"), F.get(old, F.lit(1)).cast("bigint").alias("old_pos")
    )
