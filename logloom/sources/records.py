"""Data and hint files as bytes: one record after the other, in a fixed little-endian layout.

A data record is its time (8 bytes), the length of its key (8) and the key, then a byte that
tells whether there is a value, and if so its length (8) and the value. A hint is its time, the length and the
position of its record (8 each), and the length of its key and the key.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from logloom.functions.scalars import DATA_SUFFIX, HINT_SUFFIX
from logloom.operators.compaction import recover
from logloom.operators.log import records, scan
from logloom.schema import HINT, LOG

#: Bytes of a file that are held at a time; bytes that a task reads, if files are small, and what opening a file counts as.
PIECE, PARTITION, OPENING = 4 << 20, 64 << 20, 256 << 10


def _le(value: Column) -> Column:
    big = F.unhex(F.lpad(F.hex(value.cast("bigint")), 16, "0"))
    return F.concat(*[F.substring(big, i, 1) for i in range(8, 0, -1)])


def data_record(tstamp: str = "tstamp", key: str = "key", value: str = "value") -> Column:
    """The bytes of a data record, as an expression."""
    key, value = F.col(key), F.col(value)
    head = F.concat(_le(F.col(tstamp)), _le(F.octet_length(key)), key)
    put = F.concat(head, F.lit(bytearray(b"\x01")), _le(F.octet_length(value)), value)
    return F.when(value.isNull(), F.concat(head, F.lit(bytearray(b"\x00")))).otherwise(put)


def hint_record(tstamp: str = "tstamp", length: str = "len", pos: str = "pos", key: str = "key") -> Column:
    """The bytes of a hint, as an expression."""
    return F.concat(_le(F.col(tstamp)), _le(F.col(length)), _le(F.col(pos)), _le(F.octet_length(key)), F.col(key))


def encode_data(tstamp: int, key: bytes, value: bytes | None) -> bytes:
    head = struct.pack("<qQ", tstamp, len(key)) + key
    return head + b"\x00" if value is None else head + b"\x01" + struct.pack("<Q", len(value)) + value


def decode_data(data: bytes) -> Iterator[tuple[int, int, int, bytes, bytes | None]]:
    """``pos, len, tstamp, key, value`` of each record. A record that is cut off ends the file, as after a
    crash; a byte that is neither 0 nor 1 where one of them must be is an error."""
    at, n = 0, len(data)
    while at + 17 <= n:
        tstamp, size = struct.unpack_from("<qQ", data, at)
        end = at + 16 + size
        if end >= n:
            return
        key, mark = data[at + 16 : end], data[end]
        if mark > 1:
            raise ValueError(f"no record at byte {at}")
        end += 1
        value = None
        if mark:
            if end + 8 > n:
                return
            (size,) = struct.unpack_from("<Q", data, end)
            if end + 8 + size > n:
                return
            value, end = data[end + 8 : end + 8 + size], end + 8 + size
        yield at, end - at, tstamp, key, value
        at = end


def decode_hints(data: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """Place and size of each hint, then its ``tstamp, len, pos, key``; one that is cut off ends the file."""
    at, n = 0, len(data)
    while at + 32 <= n:
        tstamp, length, pos, size = struct.unpack_from("<qQQQ", data, at)
        if at + 32 + size > n:
            return
        yield at, 32 + size, tstamp, length, pos, data[at + 32 : at + 32 + size]
        at += 32 + size


def encode_hint(tstamp: int, length: int, pos: int, key: bytes) -> bytes:
    return struct.pack("<qQQQ", tstamp, length, pos, len(key)) + key


def decode_pieces(pieces: Iterable[bytes], decode: Callable[[bytes], Iterator[tuple]]) -> Iterator[tuple]:
    """The records of a file that comes in pieces cut anywhere; their first number is the place in the whole file."""
    rest, base = b"", 0
    for piece in pieces:
        data = rest + piece
        end = 0
        for at, size, *others in decode(data):
            yield (base + at, size, *others)
            end = at + size
        rest, base = data[end:], base + end


def images(log: DataFrame, piece: int = PIECE) -> DataFrame:
    """``fileid, piece_no, content``: each data file as bytes, its records by position, in pieces of some MB that records don't span."""
    import pyarrow as pa

    rows = scan(log).select("fileid", "pos", data_record().alias("record")).repartition("fileid").sortWithinPartitions("fileid", "pos")

    def join(batches):
        now, no, held, size = None, 0, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([no], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["fileid", "piece_no", "content"])

        for batch in batches:
            for fileid, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (fileid != now or size >= piece):
                    yield out()
                    held, size, no = [], 0, no + 1
                if fileid != now:
                    now, no = fileid, 0
                held.append(record)
                size += len(record)
        if held:
            yield out()

    return rows.select("fileid", "record").mapInArrow(join, "fileid bigint, piece_no bigint, content binary")


def _batches(rows: Iterator[tuple], schema, most: int = 8192):
    """Rows as Arrow batches."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    while some := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)


def from_images(files: DataFrame) -> DataFrame:
    """The log in files given as pieces, ``fileid, piece_no, content``. NULL content is no bytes."""
    ordered = files.select("fileid", "piece_no", "content").repartition("fileid").sortWithinPartitions("fileid", "piece_no")

    def run(batches):
        pieces = ((i, c or b"") for b in batches for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        rows = ((i, *r) for i, own in itertools.groupby(pieces, lambda p: p[0]) for r in decode_pieces((c for _, c in own), decode_data))
        yield from _batches(rows, LOG)

    return ordered.select("fileid", "content").mapInArrow(run, LOG)


def _open(folder: str):
    """The file system of a folder that all executors can reach, local, HDFS or an object store, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else folder.replace("file:", "file://", 1))


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class _Reader(DataSourceReader):
    """Small files share a partition, up to ``PARTITION`` bytes, where opening a file counts as ``OPENING``; files are read in pieces."""

    def __init__(self, folder: str, ending: str, schema, decode: Callable[[bytes], Iterator[tuple]]):
        self.folder, self.ending, self.kind, self.decode = folder, ending, schema, decode

    def partitions(self):
        from pyarrow import fs

        system, at = _open(self.folder)
        found = []
        for info in system.get_file_info(fs.FileSelector(at)):
            stem = info.base_name.split(".")[0]
            if info.type == fs.FileType.File and info.base_name.endswith(self.ending) and stem.isdigit() and int(stem) < 1 << 63:
                found.append((int(stem), info.path, info.size or 0))
        parts, filled = [[]], 0
        for fileid, path, size in sorted(found):
            if parts[-1] and filled + size + OPENING > PARTITION:
                parts, filled = [*parts, []], 0
            parts[-1].append((fileid, path))
            filled += size + OPENING
        return [_Files(p) for p in parts]

    def read(self, partition):
        yield from _batches(self.rows(partition.files), self.kind)

    def rows(self, files: list[tuple[int, str]]) -> Iterator[tuple]:
        system, _ = _open(self.folder)
        for fileid, path in files:
            with system.open_input_stream(path) as f:
                for r in decode_pieces(iter(lambda f=f: f.read(PIECE), b""), self.decode):
                    yield (fileid, *self.row(r))

    def row(self, record: tuple) -> tuple:
        return record


class _HintReader(_Reader):
    def row(self, record: tuple) -> tuple:
        _, _, tstamp, length, pos, key = record
        return pos, length, tstamp, key


class _Done(WriterCommitMessage):
    def __init__(self, made: list[tuple[str, str]]):
        self.made = made


class _Writer(DataSourceWriter):
    """Each task writes hidden files of its own; the commit names them, so a failed job leaves no data file."""

    def __init__(self, folder: str, ending: str, encode: Callable):
        self.folder, self.ending, self.encode = folder, ending, encode
        system, at = _open(folder)
        system.create_dir(at, recursive=True)

    def write(self, iterator):
        import uuid

        from pyarrow import fs

        system, at = _open(self.folder)
        made, now, out = [], None, None
        for row in iterator:
            if row.fileid != now:
                if out:
                    out.close()
                final = f"{at}/{row.fileid}{self.ending}"
                hidden = f"{at}/.{row.fileid}-{uuid.uuid4().hex}"
                if system.get_file_info(final).type != fs.FileType.NotFound or any(f == final for _, f in made):
                    raise FileExistsError(final)
                made.append((hidden, final))
                now, out = row.fileid, system.open_output_stream(hidden)
            out.write(self.encode(row))
        if out:
            out.close()
        return _Done(made)

    def commit(self, messages):
        import os

        from pyarrow import fs

        system, _ = _open(self.folder)
        for m in messages:
            for hidden, final in m.made if m else []:
                if isinstance(system, fs.LocalFileSystem):
                    os.link(hidden, final)
                    os.unlink(hidden)
                else:
                    if system.get_file_info(final).type != fs.FileType.NotFound:
                        raise FileExistsError(final)
                    system.move(hidden, final)

    def abort(self, messages):
        from pyarrow import fs

        system, _ = _open(self.folder)
        for m in messages:
            for hidden, _ in m.made if m else []:
                if system.get_file_info(hidden).type != fs.FileType.NotFound:
                    system.delete_file(hidden)


def _data_bytes(row) -> bytes:
    return encode_data(row.tstamp, bytes(row.key), None if row.value is None else bytes(row.value))


def _hint_bytes(row) -> bytes:
    return encode_hint(row.tstamp, row.len, row.pos, bytes(row.key))


class RecordFiles(DataSource):
    """``spark.read.format("logrecords").load(folder)`` and the same for writing, on a shared folder. Other files are ignored."""

    @classmethod
    def name(cls):
        return "logrecords"

    def schema(self):
        return LOG

    def reader(self, schema):
        return _Reader(self.options["path"], ".data", LOG, decode_data)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], DATA_SUFFIX, _data_bytes)


class HintFiles(DataSource):
    """The same for hints: ``spark.read.format("loghints")``."""

    @classmethod
    def name(cls):
        return "loghints"

    def schema(self):
        return HINT

    def reader(self, schema):
        return _HintReader(self.options["path"], ".hint", HINT, decode_hints)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], HINT_SUFFIX, _hint_bytes)


def _read(spark: SparkSession, source: type[DataSource], folder: str) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The log in the data files of a folder that all executors can reach. Other files are ignored."""
    return _read(spark, RecordFiles, folder)


def read_hint_files(spark: SparkSession, folder: str) -> DataFrame:
    """The hints in the hint files of a folder, as ``fileid, pos, len, tstamp, key``."""
    return _read(spark, HintFiles, folder)


def _write(rows: DataFrame, source: type[DataSource], folder: str) -> None:
    rows.sparkSession.dataSource.register(source)
    ready = rows.repartition("fileid").sortWithinPartitions("fileid", "pos")
    ready.write.format(source.name()).mode("append").option("path", folder).save()


def write_files(log: DataFrame, folder: str) -> None:
    """Writes each file of a log as a data file; it is an error if one is there already."""
    _write(scan(log).select(*LOG.names), RecordFiles, folder)


def write_hint_files(hints: DataFrame, folder: str) -> None:
    """Writes the hints of each file as a hint file; it is an error if one is there already."""
    _write(records(hints).select(*HINT.names).distinct(), HintFiles, folder)


def recover_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the data files of a folder, ``key, fileid, pos, len, tstamp`` of each live key: of a file that has a hint file from this,
    of others from their records. Hint files without a data file are ignored."""
    return recover(read_files(spark, folder), read_hint_files(spark, folder))
