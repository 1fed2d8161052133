"""Many small files made into few well-sized ones, by merging sorted runs per key range."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.schema import LOG

SMALL_FILE_BYTES = 4096
TARGET_FILE_BYTES = 64 * 1024
#: A key range is planned for so many files; there are so many ranges at most, and longer ones beyond that.
FILES_PER_RANGE, MOST_RANGES = 16, 4096
#: Keys sampled for each range, to find where ranges begin. The result doesn't depend on it.
SAMPLES_PER_RANGE = 64
#: The most records and bytes of a block of a run.
BLOCK_RECORDS, BLOCK_BYTES = 4096, 1 << 20
#: File ids that a key range may use; a range that needs more is an error.
IDS_PER_RANGE = 1 << 20


def file_sizes(log: DataFrame) -> DataFrame:
    """``fileid, records, bytes`` of each file, each position counted once; rows without a key hold no record.

    Positions are made unique before they are summed, so that neither a row that is there very
    often nor a very large file gathers in one task.
    """
    return (
        log.where("key IS NOT NULL AND fileid IS NOT NULL AND pos IS NOT NULL")
        .groupBy("fileid", "pos")
        .agg(F.max("len").alias("len"))
        .groupBy("fileid")
        .agg(F.count("*").alias("records"), F.coalesce(F.sum("len"), F.lit(0)).alias("bytes"))
    )


def kept_of(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """``key, fileid, pos, len, tombstone`` of the records that merging some files must keep.

    ``log`` has ``value``, or instead of it ``tombstone``.
    ``chosen`` has ``fileid`` and the flag ``chosen`` for each file. A record is kept if it lies
    in a chosen file, is the newest of its key by ``(fileid, pos)``, and has a value or is a
    tombstone that hides a value in a file that isn't chosen. Rows without ``key``, ``fileid``
    or ``pos`` hold no record.

    Per key this takes two mergeable states, its newest record and whether another file holds
    a value. They are folded before the shuffle, so that a hot key moves as a row for each
    task. ``chosen`` grows with the files: Spark broadcasts it only below its threshold and
    else joins by sorting, splitting what is skewed.
    """
    tombstone = F.col("tombstone") if "value" not in log.columns else F.col("value").isNull()
    rows = log.where("key IS NOT NULL AND fileid IS NOT NULL AND pos IS NOT NULL").select(
        "key", "fileid", "pos", "len", tombstone.alias("tombstone")
    )
    newest = F.max(F.struct("fileid", "pos", "len", "tombstone", "chosen")).alias("newest")
    hidden = F.max(~F.col("tombstone") & ~F.col("chosen")).alias("hidden")
    return (
        rows.join(chosen.select("fileid", "chosen"), "fileid")
        .groupBy("key")
        .agg(newest, hidden)
        .select("key", "newest.*", "hidden")
        .where("chosen AND (NOT tombstone OR hidden)")
        .select("key", "fileid", "pos", "len", "tombstone")
    )


def small_files(log: DataFrame, small_bytes: int = SMALL_FILE_BYTES) -> DataFrame:
    """``fileid, chosen``: for each file whether it is small."""
    return file_sizes(log).select("fileid", (F.col("bytes") < small_bytes).alias("chosen"))


def copied(log: DataFrame, chosen: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept records with all columns of a log. Values of files that aren't merged don't move."""
    own = log.where("key IS NOT NULL AND fileid IS NOT NULL AND pos IS NOT NULL").select(*LOG.names)
    own = own.join(chosen.where("chosen").select("fileid"), "fileid", "left_semi")
    rest = F.max(F.struct("len", "tstamp", "value")).alias("rest")
    once = own.join(kept.select("fileid", "pos"), ["fileid", "pos"], "left_semi").groupBy("fileid", "pos", "key").agg(rest)
    return once.select("fileid", "pos", "rest.len", "rest.tstamp", "key", "rest.value")


def close_by_size(lengths: np.ndarray, limit: int, filled: int = 0, file_no: int = 0) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The file and the offset of each record, and how full the last file is and its number.

    A file is closed after the record that takes it over ``limit``, so it may exceed that by one record. ``filled`` and ``file_no``
    go on from the batch before.
    """
    n = len(lengths)
    files, places = np.empty(n, np.int64), np.empty(n, np.int64)
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    at = 0
    while at < n:
        over = int(np.searchsorted(total, limit - filled + total[at], side="right"))
        end = min(over, n)
        files[at:end] = file_no
        places[at:end] = filled + total[at:end] - total[at]
        if over <= n:
            file_no, filled = file_no + 1, 0
        else:
            filled += int(total[n] - total[at])
        at = end
    return files, places, filled, file_no


@dataclass(frozen=True)
class Ranges:
    """Key ranges: range ``n`` begins at the ``n``-th of ``begins``, a tuple of key, file id and position; range 0 before all."""

    begins: list[tuple[bytes, int, int]]

    @property
    def n(self) -> int:
        return len(self.begins) + 1


def key_ranges(records: DataFrame, target_bytes: int = TARGET_FILE_BYTES, most: int = MOST_RANGES) -> Ranges:
    """Ranges of about ``FILES_PER_RANGE`` files each. ``records``, with ``key, fileid, pos, len``, is read twice.

    The driver gets a sample of some ``SAMPLES_PER_RANGE`` keys for each range, at most 262,144.
    """
    n, size = records.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    ranges = min(most, max(1, -(-size // (FILES_PER_RANGE * target_bytes))))
    if ranges == 1:
        return Ranges([])
    some = records.select("key", "fileid", "pos").sample(min(1.0, SAMPLES_PER_RANGE * ranges / n), 7).collect()
    places = sorted({(bytes(r["key"]), r["fileid"], r["pos"]) for r in some})
    ranges = min(ranges, len(places))
    return Ranges([places[len(places) * i // ranges] for i in range(1, ranges)])


RUN = T.StructType(
    [
        T.StructField("range_no", T.IntegerType()), T.StructField("run", T.IntegerType()),
        T.StructField("first_key", T.BinaryType()), T.StructField("first_fileid", T.LongType()), T.StructField("first_pos", T.LongType()),
        T.StructField("last_key", T.BinaryType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType()),
        T.StructField("body", T.BinaryType()),
    ]
)
MERGED = T.StructType(
    [
        T.StructField("range_no", T.IntegerType()), T.StructField("tombstone", T.BooleanType()), T.StructField("file_no", T.IntegerType()),
        T.StructField("new_pos", T.LongType()), *LOG.fields,
    ]
)


def _place(table, i: int) -> tuple[bytes, int, int]:
    return tuple(table.column(c)[i].as_py() for c in ("key", "fileid", "pos"))


def _before(table, place: tuple[bytes, int, int], low: int = 0) -> int:
    """How many rows of a sorted table come before a place."""
    high = table.num_rows
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if _place(table, middle) < place else (low, middle)
    return low


def sorted_runs(records: DataFrame, ranges: Ranges) -> DataFrame:
    """``records``, with the columns of a log, as sorted runs: one for each task, by key, file id and position.

    A run is cut into blocks, at the latest after ``BLOCK_RECORDS`` or ``BLOCK_BYTES``, and where a key range begins. A row of
    the result is a block: its range and run, its first and last keys, how many records and bytes it has, and its
    records as an Arrow stream. So what a block covers can be read without opening it. Spark sorts each task's
    records, spilling as it must; nothing is shuffled.
    """
    begins = ranges.begins

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        run = TaskContext.get().partitionId()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            at = 0
            while at < table.num_rows:
                no = _range_of(begins, _place(table, at))
                end = min(table.num_rows, at + BLOCK_RECORDS)
                if no < len(begins):
                    end = min(end, _before(table, begins[no], at))
                lens = table.column("len").slice(at, end - at).fill_null(0).to_numpy()
                fits = int(np.searchsorted(np.cumsum(lens), BLOCK_BYTES, side="right"))
                end = at + max(1, min(end - at, fits))
                block = table.slice(at, end - at)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, block.schema) as out:
                    out.write_table(block)
                first = _place(block, 0)
                row = {
                    "range_no": no, "run": run, "first_key": first[0], "first_fileid": first[1], "first_pos": first[2],
                    "last_key": _place(block, block.num_rows - 1)[0], "records": block.num_rows,
                    "bytes": int(lens[: end - at].sum()), "body": sink.getvalue().to_pybytes(),
                }
                yield pa.RecordBatch.from_pylist([row], schema=_arrow(RUN))
                at = end

    return records.select(*LOG.names).sortWithinPartitions("key", "fileid", "pos").mapInArrow(cut, RUN)


def _range_of(begins: list[tuple[bytes, int, int]], place: tuple[bytes, int, int]) -> int:
    import bisect

    return bisect.bisect_right(begins, place)


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class _Merge:
    """The blocks of one range, merged as they come by their first records.

    Open are the blocks that aren't used up. What lies before the first record of the newest block can't be followed by anything
    smaller, so it goes out: of each open block the rows up to there, merged. A run has one or two blocks open, so memory is
    needed for as many blocks as there are runs.
    """

    def __init__(self):
        self.open: list = []

    def take(self, block) -> list:
        place = _place(block, 0)
        out, still = [], []
        for table in self.open:
            n = _before(table, place)
            if n:
                out.append(table.slice(0, n))
            if n < table.num_rows:
                still.append(table.slice(n))
        self.open = [*still, block]
        return _merged(out)

    def rest(self) -> list:
        out, self.open = self.open, []
        return _merged(out)


def _merged(slices: list) -> list:
    import pyarrow as pa
    import pyarrow.compute as pc

    if len(slices) < 2:
        return slices
    table = pa.concat_tables(slices)
    return [table.take(pc.sort_indices(table, [(c, "ascending") for c in ("key", "fileid", "pos")]))]


def merge_runs(runs: DataFrame, ranges: int, target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """The records of sorted runs, merged per key range and given to files: a k-way merge of as many runs as there are.

    Adds to each record, with the columns of a log, ``range_no, tombstone, file_no, new_pos``. Each range is one task's, to which its
    blocks come in order of their first records; only blocks are shuffled and sorted, never records. Rows come by key, file id
    and position, all of them, repeated ones too. Within a range tombstones have files of their own: hints tell of
    live records only, and recovery doesn't read a file that has hints. A file is closed after the record that takes it over
    ``target_bytes``. A NULL ``len`` counts as no bytes.
    """
    ordered = runs.repartitionById(ranges, F.col("range_no")).sortWithinPartitions("range_no", "first_key", "first_fileid", "first_pos")

    def merge(batches):
        import pyarrow as pa

        schema, kind = _arrow(MERGED), _arrow(LOG)
        now, work, ends, waiting, n = None, _Merge(), {}, [], 0

        def out():
            table = pa.concat_tables(waiting).cast(kind)
            lens = table.column("len").fill_null(0).to_numpy()
            gone = table.column("value").is_null().to_numpy(zero_copy_only=False)
            files, places = np.empty(len(lens), np.int64), np.empty(len(lens), np.int64)
            for mark in (False, True):
                own = gone == mark
                files[own], places[own], *ends[mark] = close_by_size(lens[own], target_bytes, *ends.get(mark, (0, 0)))
                if ends[mark][1] >= IDS_PER_RANGE:
                    raise ValueError(f"a key range needs more than {IDS_PER_RANGE} files; take larger files")
            columns = [np.full(len(lens), now, np.int32), gone, files.astype(np.int32), places, *table.columns]
            whole = pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], schema=schema)
            yield from whole.combine_chunks().to_batches()

        for batch in batches:
            for no, body in zip(batch.column("range_no").to_pylist(), batch.column("body"), strict=True):
                if no != now:
                    waiting += work.rest()
                    if waiting:
                        yield from out()
                    now, ends, waiting, n = no, {}, [], 0
                done = work.take(pa.ipc.open_stream(body.as_buffer()).read_all())
                waiting += done
                n += sum(t.num_rows for t in done)
                if n >= BLOCK_RECORDS:
                    yield from out()
                    waiting, n = [], 0
        waiting += work.rest()
        if waiting:
            yield from out()

    return ordered.select("range_no", "body").mapInArrow(merge, MERGED)


def with_ids(merged: DataFrame, first_fileid: int) -> DataFrame:
    """Merged records where they lie now: the columns of a log, then ``old_fileid, old_pos``. Ids have gaps; those of tombstones' files
    are odd offsets."""
    fileid = F.lit(first_fileid) + 2 * (F.col("range_no").cast("bigint") * IDS_PER_RANGE + F.col("file_no")) + F.col("tombstone").cast("int")
    return merged.select(
        fileid.alias("fileid"), F.col("new_pos").alias("pos"), "len", "tstamp", "key", "value",
        F.col("fileid").alias("old_fileid"), F.col("pos").alias("old_pos"),
    )


def range_of_id(fileid: Column, first_fileid: int) -> tuple[Column, Column, Column]:
    """The key range of a new file, its number in it, and whether it is one of tombstones."""
    offset = fileid - F.lit(first_fileid)
    number = F.shiftright(offset, 1)
    return F.floor(number / F.lit(IDS_PER_RANGE)).cast("int"), F.pmod(number, F.lit(IDS_PER_RANGE)), F.pmod(offset, F.lit(2)) == 1


def range_metadata(log: DataFrame) -> DataFrame:
    """Key range, records and bytes of each file: ``fileid, min_key, max_key, records, bytes``."""
    return log.groupBy("fileid").agg(
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.count("*").alias("records"),
        F.coalesce(F.sum("len"), F.lit(0)).alias("bytes"),
    )


def stored(df: DataFrame, folder: str) -> DataFrame:
    """A table written to a folder and read from there, so that it is computed once and its lineage ends."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@dataclass
class Consolidation:
    """What a consolidation wrote: ``files`` as a log with ``old_fileid, old_pos``, and ``ranges`` with what each file covers."""

    files: DataFrame
    ranges: DataFrame
    kept: DataFrame
    first_fileid: int

    def file_numbers(self) -> DataFrame:
        """``fileid, tombstone, file_no``: the number of each file by key order, apart for values and tombstones. Counted within
        key ranges, of which there are few."""
        range_no, number, tombstone = range_of_id(F.col("fileid"), self.first_fileid)
        files = self.ranges.select("fileid", range_no.alias("range_no"), number.alias("number"), tombstone.alias("tombstone"))
        before = Window.partitionBy("tombstone").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
        n = files.groupBy("tombstone", "range_no").agg(F.count("*").alias("n"))
        n = n.select("tombstone", "range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        return files.join(n, ["tombstone", "range_no"]).select("fileid", "tombstone", (F.col("before") + F.col("number")).alias("file_no"))

    def overlaps(self) -> DataFrame:
        """``n``: files of values, or of tombstones, whose keys begin before those of the file before end. Neighbours are compared within
        key ranges, and then the ranges, of which there are few, with each other."""
        range_no, _, tombstone = range_of_id(F.col("fileid"), self.first_fileid)
        files = self.ranges.withColumns({"range_no": range_no, "tombstone": tombstone})
        within = F.lag("max_key").over(Window.partitionBy("tombstone", "range_no").orderBy("fileid"))
        found = files.withColumn("over", F.coalesce(F.col("min_key") < within, F.lit(False)))
        whole = found.groupBy("tombstone", "range_no").agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"), F.count_if("over").alias("n"))
        between = F.lag("high").over(Window.partitionBy("tombstone").orderBy("range_no"))
        return whole.withColumn("over", F.coalesce(F.col("low") < between, F.lit(False))).agg(F.coalesce(F.sum("n") + F.count_if("over"), F.lit(0)).alias("n"))


def consolidate(
    log: DataFrame, chosen: DataFrame, root: str, first_fileid: int, target_bytes: int = TARGET_FILE_BYTES, index: DataFrame | None = None
) -> Consolidation:
    """Writes what merging the ``chosen`` files of a log must keep into new files below ``root``.

    Stored are the kept records without values, then the sorted runs, then the files, then their ranges. ``log`` is read
    twice: without values to find what must be kept (or ``index``, which has ``tombstone`` instead of values, in its place), and once
    more to copy. ``chosen`` has ``fileid`` and ``chosen`` for each file, and is read twice. Files that aren't chosen, and the log, stay as they are.
    """
    kept = stored(kept_of(log if index is None else index, chosen), f"{root}/kept")
    ranges = key_ranges(kept, target_bytes)
    runs = stored(sorted_runs(copied(log, chosen, kept), ranges), f"{root}/runs")
    files = stored(with_ids(merge_runs(runs, ranges.n, target_bytes), first_fileid), f"{root}/files")
    return Consolidation(files, stored(range_metadata(files), f"{root}/ranges"), kept, first_fileid)


def consolidate_small(log: DataFrame, root: str, small_bytes: int = SMALL_FILE_BYTES, target_bytes: int = TARGET_FILE_BYTES) -> Consolidation:
    """Consolidates the small files of a log into new files, whose ids follow the log's."""
    chosen = stored(small_files(log, small_bytes), f"{root}/chosen")
    last = chosen.agg(F.max("fileid")).first()[0]
    return consolidate(log, chosen, root, 0 if last is None else last + 1, target_bytes)
