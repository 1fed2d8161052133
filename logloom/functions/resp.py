"""The wire format of commands and replies: length-prefixed frames (RESP2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.schema import FRAMES

CRLF = b"\r\n"
I64 = 1 << 63


def _bytes(value: bytes) -> Column:
    return F.lit(bytearray(value))


def _text(*parts: Column | str) -> Column:
    return F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), "UTF-8")


def bulk(value: Column) -> Column:
    """A bulk string; NULL becomes the null frame."""
    whole = F.concat(_text("$", F.octet_length(value), "\r\n"), value, _bytes(CRLF))
    return F.coalesce(whole, _bytes(b"$-1\r\n"))


def encode_command(parts: Column) -> Column:
    """A command, as an array of its name and arguments, as an array frame of bulk strings."""
    head = _text("*", F.size(parts), "\r\n")
    return F.aggregate(parts, head, lambda done, part: F.concat(done, bulk(part)))


def encode_reply(kind: Column, int_val: Column, bytes_val: Column) -> Column:
    """A reply frame by its kind: simple, error, integer, bulk or null."""
    return (
        F.when(kind == "simple", F.concat(_bytes(b"+"), bytes_val, _bytes(CRLF)))
        .when(kind == "error", F.concat(_bytes(b"-"), bytes_val, _bytes(CRLF)))
        .when(kind == "integer", _text(":", int_val, "\r\n"))
        .when(kind == "bulk", bulk(bytes_val))
        .when(kind == "null", _bytes(b"$-1\r\n"))
    )


class FrameError(Exception):
    """``kind``: Incomplete, BadEncoding, NotInteger, NotUtf8 or ConnectionReset; ``text``: what couldn't be read."""

    def __init__(self, kind: str, text: str = ""):
        super().__init__(f"{kind}: {text}" if text else kind)
        self.kind, self.text = kind, text


def _line(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes up to a carriage return, which must not be the last byte; the byte after it is skipped."""
    end = data.find(b"\r", at, len(data) - 1)
    feed = data.find(b"\n", at, end if end >= 0 else max(len(data) - 1, at))
    if feed >= 0:
        raise FrameError("BadEncoding")
    if end < 0:
        raise FrameError("Incomplete")
    return data[at:end], end + 2


def _integer(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data):
        raise FrameError("Incomplete")
    first = at + (data[at] in b"+-")
    end = first
    while end < len(data) - 1 and 48 <= data[end] <= 57:
        end += 1
    if end >= len(data) - 1:
        raise FrameError("Incomplete")
    if end == first or data[end] != 13:
        raise FrameError("NotInteger", data[at : end + 1].decode("utf-8", "replace"))
    digits = data[first:end].lstrip(b"0")
    value = int(digits or b"0") if len(digits) < 20 else I64 + 1
    value = -value if data[at] == 45 else value
    if not -I64 <= value < I64:
        raise FrameError("NotInteger", data[at:end].decode("utf-8", "replace"))
    return value, end + 2


def decode(data: bytes, at: int = 0) -> tuple[list[tuple], int]:
    """The frame at a place, as rows ``(path, kind, int_val, bytes_val, n_items)``, and where the next begins.

    An array comes before its items; ``path`` has the places of an item within its arrays. What
    is found wrong though the frame is whole, such as a text that isn't UTF-8, is raised only
    once all of it is there; what can't be whole yet is Incomplete. Arrays may be nested to any depth.
    """
    rows: list[tuple] = []
    late: FrameError | None = None
    todo: list[list[int]] = []  # of each open array: items to come, items so far
    path: list[int] = []
    while True:
        if at >= len(data):
            raise FrameError("Incomplete")
        mark, at = data[at], at + 1
        wrong: FrameError | None = None
        if mark in b"+-":
            text, at = _line(data, at)
            try:
                text.decode("utf-8")
            except UnicodeDecodeError as e:
                wrong = FrameError("NotUtf8", str(e))
            rows.append((list(path), "simple" if mark == 43 else "error", None, text, None))
        elif mark == 58:
            value, at = _integer(data, at)
            rows.append((list(path), "integer", value, None, None))
        elif mark == 36:
            if at >= len(data):
                raise FrameError("Incomplete")
            if data[at] == 45:
                if at + 4 > len(data):
                    raise FrameError("Incomplete")
                try:
                    if _line(data, at)[0] != b"-1":
                        wrong = FrameError("BadEncoding")
                except FrameError as e:
                    wrong = e
                at += 4
                rows.append((list(path), "null", None, None, None))
            else:
                n, at = _integer(data, at)
                if at + n + 2 > len(data):
                    raise FrameError("Incomplete")
                rows.append((list(path), "bulk", None, data[at : at + n], None))
                at += n + 2
        elif mark == 42:
            n, at = _integer(data, at)
            if n < 0:
                wrong = FrameError("BadEncoding")
            rows.append((list(path), "array", None, None, max(n, 0)))
            if n > 0:
                late = late or wrong
                todo.append([n, 0])
                path.append(0)
                continue
        else:
            raise FrameError("BadEncoding")
        late = late or wrong
        while todo:
            todo[-1][1] += 1
            path[-1] += 1
            if todo[-1][1] < todo[-1][0]:
                break
            todo.pop()
            path.pop()
        if not todo:
            if late:
                raise late
            return rows, at


class FrameReader:
    """Takes the frames off the bytes of a connection as they come; what isn't a whole frame yet is kept for later."""

    def __init__(self, rest: bytes = b""):
        self.rest = rest

    def push(self, data: bytes) -> Iterator[tuple[bytes, list[tuple]]]:
        """The bytes and the rows of each frame that is whole now. A frame that can't be right raises, and the rest is kept."""
        self.rest += data
        at = 0
        try:
            while at < len(self.rest):
                try:
                    rows, end = decode(self.rest, at)
                except FrameError as e:
                    if e.kind != "Incomplete":
                        raise
                    return
                frame, at = self.rest[at:end], end
                yield frame, rows
        finally:
            self.rest = self.rest[at:]

    def close(self) -> None:
        """The connection ended. Within a frame, that is an error."""
        if self.rest:
            raise FrameError("ConnectionReset")


def command_fault(rows: list[tuple]) -> str | None:
    """What ``command_error`` says of a decoded frame, for one at a time."""
    if rows[0][1] != "array":
        return "BadFrame"
    if len(rows) == 1:
        return "BadCommand: "
    items = [(r[3] if r[1] == "bulk" else None) for r in rows[1:] if len(r[0]) == 1]
    name, given = items[0], items[1:]
    if name is None:
        return "BadFrame"
    if name not in (b"GET", b"SET", b"DEL"):
        return f"BadCommand: {name.decode('utf-8', 'replace')}"
    if not given:
        return "BadArguments: Keys are empty" if name == b"DEL" else "BadArguments: Key is not given"
    for key in given if name == b"DEL" else given[:1]:
        if key is None:
            return "BadFrame"
        try:
            key.decode("utf-8")
        except UnicodeDecodeError:
            return "NotUtf8"
    if name == b"SET":
        if len(given) == 1:
            return "BadArguments: Value is not given"
        if given[1] is None:
            return "BadFrame"
    if name != b"DEL" and len(given) > (2 if name == b"SET" else 1):
        return "BadArguments: Frame contains extra data"
    return None


READ = "connection string, frame_no bigint, status string, frame binary"


def frames_of_chunks(
    reader: FrameReader, number: int, chunks: Iterator[bytes], ended: bool, commands: bool = False
) -> Iterator[tuple[int, str, bytes]]:
    """``frame_no, status, frame`` of the chunks of one connection: ``frame`` for each whole frame, then, if the connection
    ended or can't go on, ``end``, ``ConnectionReset`` or what is wrong. With ``commands`` a frame that is no right command ends it too."""
    try:
        for chunk in chunks:
            for frame, rows in reader.push(chunk):
                if commands and (wrong := command_fault(rows)):
                    yield number, wrong, frame
                    return
                yield number, "frame", frame
                number += 1
        if ended:
            reader.close()
            yield number, "end", b""
    except FrameError as e:
        yield number, e.kind, reader.rest


def read_frames(chunks: DataFrame, connection: str = "connection", order: str = "n", data: str = "bytes") -> DataFrame:
    """``connection, frame_no, status, frame``: the frames of each connection, whose bytes come as chunks cut anywhere.

    Each connection is read by ``order`` until it ends, or until what can't be a frame, after which nothing of it is read. Its
    chunks stream through one task, since where a frame begins depends on all before it; connections are spread. NULL bytes
    are no bytes. Rows without a connection are left out.
    """
    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    ready = (
        chunks.where(F.col(connection).isNotNull())
        .select(F.col(connection).cast("string").alias("connection"), F.col(order).alias("n"), F.col(data).alias("bytes"))
        .repartition("connection").sortWithinPartitions("connection", "n").select("connection", "bytes")
    )
    arrow = to_arrow_schema(_parse_datatype_string(READ))

    def run(batches):
        now, reader, number, over = None, None, 0, True
        out: list[tuple] = []

        def take(chunks, ended):
            nonlocal number, over
            for row in frames_of_chunks(reader, number, chunks, ended):
                out.append((now, *row))
                number, over = row[0] + 1, row[1] != "frame"

        for batch in batches:
            for name, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != now:
                    if not over:
                        take([], True)
                    now, reader, number, over = name, FrameReader(), 0, False
                if not over:
                    take([chunk or b""], False)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, arrow, strict=True)], schema=arrow)
            out.clear()
        if not over:
            take([], True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return ready.mapInArrow(run, READ)


KINDS = ["simple", "error", "integer", "bulk", "null", "array"]
#: So many items of each message are read side by side; longer messages are read one by one.
STEPS = 64


@dataclass
class Flat:
    """Frames of many messages as arrays, a row for each frame by message and place: its message, its place in the array that it
    is in (-1 outside), its kind, its integer, where its bytes are, and how many items it has. ``slow``: messages not read."""

    of: np.ndarray
    place: np.ndarray
    kind: np.ndarray
    number: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    slow: np.ndarray


def _numbers(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers written in some runs of bytes, and which of them are sure: a sign or none, then 1 to 18 digits."""
    first = data[np.minimum(begin, len(data) - 1)]
    signed = ((first == 43) | (first == 45)) & (begin < end)
    at = begin + signed
    n = end - at
    sure = (n >= 1) & (n <= 18)
    value = np.zeros(len(begin), np.int64)
    for k in range(int(n[sure].max(initial=0))):
        inside = sure & (k < n)
        digit = data[np.where(inside, at + k, 0)].astype(np.int64) - 48
        sure &= ~inside | ((digit >= 0) & (digit <= 9))
        value = np.where(inside, value * 10 + digit, value)
    return np.where(signed & (first == 45), -value, value), sure


def decode_flat(data: np.ndarray, offsets: np.ndarray) -> Flat:
    """Decodes the frames that messages begin with, all messages side by side, one frame of each at a time.

    Read are whole frames that are right: texts in ASCII, integers of up to 18 digits, bulk strings, the null frame, and arrays of
    these. A message with anything else, and one with more items than ``STEPS``, is left to ``decode``.
    """
    total, m = len(data), len(offsets) - 1
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    breaks = np.append(np.flatnonzero(data[:total] == 13), total)
    bad = np.concatenate([[0], np.cumsum((data[:total] == 10) | (data[:total] >= 128))])
    stop, at = offsets[1:], offsets[:-1].copy()
    slow = np.zeros(m, bool)
    left = np.ones(m, np.int64)
    rows: list[tuple] = []
    lanes, step = np.arange(m), -1
    while len(lanes):
        p, e = at[lanes], stop[lanes]
        ok = p < e
        mark = np.where(ok, data[np.minimum(p, total)], 0)
        line = breaks[np.searchsorted(breaks, np.minimum(p + 1, total))]
        whole = ok & (line + 1 < e)
        line = np.where(whole, line, np.minimum(p + 1, total))
        value, sure = _numbers(data, p + 1, line)
        kind = np.full(len(lanes), -1)
        begin, end, following = p + 1, line.copy(), line + 2
        text = whole & ((mark == 43) | (mark == 45)) & (bad[line] == bad[np.minimum(p + 1, total)])
        kind[text] = np.where(mark[text] == 43, 0, 1)
        kind[whole & (mark == 58) & sure] = 2
        null = ok & (mark == 36) & (p + 5 <= e) & (data[np.minimum(p + 1, total)] == 45) & (data[np.minimum(p + 2, total)] == 49) & (data[np.minimum(p + 3, total)] == 13)
        fits = whole & (mark == 36) & sure & (value >= 0) & (data[np.minimum(p + 1, total)] != 45) & (value <= total)
        fits &= line + 2 + np.where(fits, value, 0) + 2 <= e
        begin = np.where(fits, line + 2, begin)
        end = np.where(fits, line + 2 + np.where(fits, value, 0), end)
        following = np.where(fits, end + 2, np.where(null, p + 5, following))
        kind[fits], kind[null] = 3, 4
        if step < 0:
            kind[whole & (mark == 42) & sure & (value >= 0)] = 5
        good = kind >= 0
        slow[lanes[~good]] = True
        own = lanes[good]
        kind, value, begin, end = kind[good], value[good], begin[good], end[good]
        rows.append((own, np.full(len(own), step), kind, value, begin, end))
        at[own] = following[good]
        left[own] = np.where(kind == 5, value, left[own] - 1)
        lanes, step = own[left[own] > 0], step + 1
        if step >= STEPS:
            slow[lanes] = True
            break
    of, place, kind, value, begin, end = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 6
    keep = ~slow[of]
    of, place, kind, value, begin, end = (x[keep] for x in (of, place, kind, value, begin, end))
    order = np.lexsort([place, of])
    return Flat(*(x[order] for x in (of, place, kind, value, begin, end)), slow)


def _message_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray, valid: np.ndarray):
    """Some runs of bytes as an Arrow column, NULL where not valid."""
    import pyarrow as pa

    n = np.where(valid, end - begin, 0)
    ends = np.cumsum(n)
    raw = data[np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(n), [mask, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def decode_frames(messages: DataFrame, key: str = "frame_id", data: str = "bytes") -> DataFrame:
    """``frame_id, path, kind, int_val, bytes_val, n_items``: the frame that each message begins with.

    Arrays are flattened: a row for the array, then one for each item. A message that can't be
    decoded gives one row of kind ``Incomplete``, ``BadEncoding``, ``NotInteger`` or ``NotUtf8`` with what
    couldn't be read in ``bytes_val``; NULL is like no bytes, Incomplete. The usual messages are decoded side by side as arrays of
    bytes; only nested, very long and wrong ones go one by one.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = messages.select(messages[key].cast("bigint"), messages[data])
    arrow = to_arrow_schema(FRAMES)

    def run(batches):
        for batch in batches:
            raw, offsets = _message_bytes(batch.column(1))
            flat = decode_flat(raw, offsets)
            n = len(flat.of)
            item = (flat.place >= 0).astype(np.int32)
            paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(item)]).astype(np.int32)), pa.array(flat.place[flat.place >= 0].astype(np.int32)))
            columns = [
                batch.column(0).take(pa.array(flat.of)), paths, pa.array(KINDS).take(pa.array(flat.kind)),
                pa.array(flat.number, mask=flat.kind != 2), _slices(raw, flat.begin, flat.end, np.isin(flat.kind, (0, 1, 3))),
                pa.array(flat.number.astype(np.int32), mask=flat.kind != 5),
            ]
            if n:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            out = []
            for i in np.flatnonzero(flat.slow).tolist():
                name = batch.column(0)[i].as_py()
                try:
                    out += [(name, *row) for row in decode(raw[offsets[i] : offsets[i + 1]].tobytes())[0]]
                except FrameError as e:
                    out.append((name, [], e.kind, None, e.text.encode(), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, FRAMES)


def check_frames(messages: DataFrame, key: str = "frame_id", data: str = "bytes") -> DataFrame:
    """``frame_id, status``: whether each message begins with a whole frame, ``OK``, or what is wrong with it."""
    frames = decode_frames(messages, key, data).where(F.size("path") == 0)
    return frames.select("frame_id", F.when(F.col("kind").isin(KINDS), "OK").otherwise(F.col("kind")).alias("status"))


def parse_commands(messages: DataFrame, key: str = "seq", data: str = "bytes") -> DataFrame:
    """``seq, op, keys, value, error``: the command in each message, or what is wrong with it.

    A message is the bytes of one frame. One that can't be decoded has the decoder's ``error``, a
    command that isn't right that of ``command_error``; both have no ``op``.
    """
    import pyarrow as pa

    rows = messages.select(messages[key].cast("bigint").alias("seq"), messages[data])
    arrow = pa.schema([("seq", pa.int64()), ("parts", pa.list_(pa.binary())), ("fault", pa.string())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = _message_bytes(batch.column(1))
            flat = decode_flat(raw, offsets)
            item = flat.place >= 0
            n = np.bincount(flat.of[item], minlength=batch.num_rows)
            arrays = np.zeros(batch.num_rows, bool)
            arrays[flat.of[~item]] = flat.kind[~item] == 5
            values = _slices(raw, flat.begin[item], flat.end[item], flat.kind[item] == 3)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            quick = np.flatnonzero(~flat.slow)
            if len(quick):
                parts = pa.ListArray.from_arrays(ends, values, mask=pa.array(~arrays))
                take = pa.array(quick)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), parts.take(take), pa.nulls(len(quick), pa.string())], schema=arrow)
            out = []
            for i in np.flatnonzero(flat.slow).tolist():
                own, fault = None, None
                try:
                    frames = decode(raw[offsets[i] : offsets[i + 1]].tobytes())[0]
                    if frames[0][1] == "array":
                        own = [f[3] if f[1] == "bulk" else None for f in frames[1:] if len(f[0]) == 1]
                except FrameError as e:
                    fault = str(e)
                out.append((batch.column(0)[i].as_py(), own, fault))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    parts = F.col("parts")
    parsed = rows.mapInArrow(run, "seq bigint, parts array<binary>, fault string")
    parsed = parsed.withColumn("error", F.coalesce("fault", command_error(parts)))
    right = F.col("error").isNull()
    op = F.when(right, F.get(parts, F.lit(0)).cast("string"))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    keys = F.when(right, F.when(op == "DEL", rest).otherwise(F.array(F.get(parts, F.lit(1)))))
    value = F.when(op == "SET", F.get(parts, F.lit(2)))
    return parsed.select("seq", op.alias("op"), keys.alias("keys"), value.alias("value"), "error")


def command_error(parts: Column) -> Column:
    """What is wrong with a command given as an array of its name and arguments; NULL if nothing is.

    An item that is NULL stands for a frame that isn't a bulk string; a NULL array for a frame that isn't
    an array. Names are upper-case. Arguments are looked at in their order, so the first fault counts.
    """
    name, n = F.get(parts, F.lit(0)), F.size(parts)
    fault = lambda x: F.when(x.isNull(), "BadFrame").when(~F.is_valid_utf8(x), "NotUtf8")
    keys = F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0)))
    in_keys = F.get(F.filter(F.transform(keys, fault), lambda f: f.isNotNull()), F.lit(0))
    key = F.get(parts, F.lit(1))
    extra, no_key = F.lit("BadArguments: Frame contains extra data"), F.lit("BadArguments: Key is not given")
    return (
        F.when(parts.isNull(), "BadFrame")
        .when(n == 0, "BadCommand: ")
        .when(name.isNull(), "BadFrame")
        .when(name == _bytes(b"DEL"), F.when(n == 1, "BadArguments: Keys are empty").otherwise(in_keys))
        .when(
            name == _bytes(b"GET"),
            F.when(n == 1, no_key).when(fault(key).isNotNull(), fault(key)).when(n > 2, extra),
        )
        .when(
            name == _bytes(b"SET"),
            F.when(n == 1, no_key)
            .when(fault(key).isNotNull(), fault(key))
            .when(n == 2, "BadArguments: Value is not given")
            .when(F.get(parts, F.lit(2)).isNull(), "BadFrame")
            .when(n > 3, extra),
        )
        .otherwise(F.concat(F.lit("BadCommand: "), F.make_valid_utf8(name.cast("string"))))
    )


def reply_error(op: Column, kind: Column, bytes_val: Column) -> Column:
    """What is wrong with a reply to a command; NULL if nothing is.

    GET takes ``bulk`` and ``null``, SET only ``simple`` OK, DEL only ``integer``. An ``error`` reply is a fault of the
    store, no reply at all a lost connection.
    """
    right = (
        F.when(op == "GET", kind.isin("bulk", "null"))
        .when(op == "SET", (kind == "simple") & (bytes_val == _bytes(b"OK")))
        .when(op == "DEL", kind == "integer")
    )
    return (
        F.when(kind.isNull(), "ConnectionReset")
        .when(kind == "error", F.concat(F.lit("Storage: "), F.make_valid_utf8(bytes_val.cast("string"))))
        .when(~F.coalesce(right, F.lit(False)), "BadFrame")
    )


def render(kind: Column, int_val: Column, bytes_val: Column) -> Column:
    """A reply as a command line shows it: texts in quotes, other bytes as an escaped byte string."""
    digits = F.hex(bytes_val)
    special = {"0A": "\\n", "0D": "\\r", "09": "\\t", "5C": "\\\\", "22": '\\"', "00": "\\0"}

    def shown(i: Column) -> Column:
        pair = F.substr(digits, i * 2 + 1, F.lit(2))
        out = None
        for code, text in special.items():
            out = F.when(pair == code, text) if out is None else out.when(pair == code, text)
        plain = pair.between("20", "7E")
        return out.when(plain, F.unhex(pair).cast("string")).otherwise(F.concat(F.lit("\\x"), F.lower(pair)))

    places = F.sequence(F.lit(0), F.octet_length(bytes_val) - 1)
    escaped = F.when(F.octet_length(bytes_val) > 0, F.concat_ws("", F.transform(places, shown))).otherwise("")
    quoted = F.concat(F.lit('"'), bytes_val.cast("string"), F.lit('"'))
    return (
        F.when(kind == "null", "(nil)")
        .when(kind == "integer", F.concat(F.lit("(integer) "), int_val.cast("string")))
        .when(kind == "simple", quoted)
        .when(kind == "error", F.concat(F.lit("(error) "), bytes_val.cast("string")))
        .when(F.is_valid_utf8(bytes_val), quoted)
        .otherwise(F.concat(F.lit('b"'), escaped, F.lit('"')))
    )
