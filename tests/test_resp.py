import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from logloom.functions import resp
from pyspark.sql import functions as F

#: A frame as these tests write it: its kind and its value; that of an array is a list of frames.
TEXT = st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\r\n"), max_size=9).map(str.encode)
SCALAR = st.one_of(
    st.tuples(st.sampled_from(["simple", "error"]), TEXT),
    st.tuples(st.just("integer"), st.one_of(st.integers(-(2**63), 2**63 - 1), st.integers(-99, 99))),
    st.tuples(st.just("bulk"), st.binary(max_size=20)),
    st.just(("null", None)),
)
FLAT = st.one_of(SCALAR, st.tuples(st.just("array"), st.lists(SCALAR, max_size=5)))
NESTED = st.recursive(SCALAR, lambda inner: st.tuples(st.just("array"), st.lists(inner, max_size=4)), max_leaves=12)


def wire(frame):
    kind, value = frame
    if kind == "array":
        return b"*%d\r\n" % len(value) + b"".join(map(wire, value))
    if kind == "bulk":
        return b"$%d\r\n%b\r\n" % (len(value), value)
    if kind == "null":
        return b"$-1\r\n"
    return {"simple": b"+", "error": b"-", "integer": b":"}[kind] + (b"%d" % value if kind == "integer" else value) + b"\r\n"


def rows_of(frame, path=()):
    kind, value = frame
    if kind == "array":
        yield list(path), kind, None, None, len(value)
        for i, item in enumerate(value):
            yield from rows_of(item, (*path, i))
    else:
        yield list(path), kind, value if kind == "integer" else None, value if kind in ("simple", "error", "bulk") else None, None


def fault(data):
    with pytest.raises(resp.FrameError) as e:
        resp.decode(data)
    return e.value.kind, e.value.text


@settings(deadline=None)
@given(NESTED, st.binary(max_size=4))
def test_what_is_written_is_read(frame, after):
    data = wire(frame)
    assert resp.decode(data + after) == (list(rows_of(frame)), len(data))


@settings(max_examples=40, deadline=None)
@given(NESTED)
def test_each_beginning_of_a_frame_is_incomplete(frame):
    data = wire(frame)
    assert all(fault(data[:n])[0] == "Incomplete" for n in range(len(data)))


def test_integers_have_64_bits():
    for n in (2**63 - 1, -(2**63)):  # fixed values: the limits
        assert resp.decode(b":%d\r\n" % n)[0][0][2] == n
        beyond = n + (1 if n > 0 else -1)
        assert fault(b":%d\r\n" % beyond) == ("NotInteger", str(beyond))
    assert resp.decode(b":+0042\r\n")[0][0][2] == 42
    assert fault(b":%b1\r\n" % (b"9" * 40))[0] == "NotInteger"


@pytest.mark.parametrize(
    ("data", "kind", "text"),
    [
        (b"!loud\r\n", "BadEncoding", ""), (b"-two\nlines\r\n", "BadEncoding", ""), (b":4 2\r\n", "NotInteger", "4 "), (b":+\r\n", "NotInteger", "+\r"),
        (b"$-17\r\nx", "BadEncoding", ""), (b"*-1\r\n", "BadEncoding", ""), (b"*-40\r\n", "BadEncoding", ""), (b"*3\r\n$1\r\nq\r\n!", "BadEncoding", ""),
        (b"$x\r\n", "NotInteger", "x"),
    ],
)
def test_what_cannot_be_right(data, kind, text):
    assert fault(data) == (kind, text)


def test_faults_of_whole_frames_wait_until_all_is_there():
    wrong = b"*2\r\n-\x80\xfe\r\n"
    assert fault(wrong)[0] == "Incomplete" and fault(wrong + b":8\r\n")[0] == "NotUtf8"
    assert fault(b"*2\r\n$-6\r\n")[0] == "Incomplete" and fault(b"*2\r\n$-6\r\n:8\r\n")[0] == "BadEncoding"


def test_a_line_ends_at_its_first_carriage_return():
    rows, end = resp.decode(b"+half\r+\r\n")
    assert rows[0][3] == b"half" and end == 7


def test_deep_arrays():
    rows, end = resp.decode(b"*1\r\n" * 3000 + b"+x\r\n")
    assert len(rows) == 3001 and len(rows[-1][0]) == 3000 and end == 12004


def flat_rows(messages):
    raw, offsets = resp._message_bytes(pa.array(messages, pa.binary()))
    flat = resp.decode_flat(raw, offsets)
    out = {i: [] for i in range(len(messages)) if not flat.slow[i]}
    for of, place, kind, number, begin, end in zip(flat.of, flat.place, flat.kind, flat.number, flat.begin, flat.end, strict=True):
        name = resp.KINDS[kind]
        out[of].append((
            [int(place)] if place >= 0 else [], name, int(number) if name == "integer" else None,
            raw[begin:end].tobytes() if name in ("simple", "error", "bulk") else None, int(number) if name == "array" else None,
        ))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(FLAT, NESTED), st.integers(0, 30), st.binary(max_size=3)), max_size=12))
def test_side_by_side_as_one_by_one(cases):
    messages = []
    for frame, cut, noise in cases:
        data = wire(frame)
        messages += [data, data[: max(0, len(data) - cut)], data[:cut] + noise + data[cut:]]
    for i, rows in flat_rows([*messages, None]).items():
        assert resp.decode(messages[i])[0] == rows


def test_usual_messages_are_read_side_by_side():
    usual = [wire(("array", [("bulk", b"SET"), ("bulk", b"k%d" % i), ("bulk", bytes([i % 256]) * i)])) for i in range(60)]
    usual += [b"+fine\r\n", b":-7\r\n", b"$-1\r\n", b"*0\r\n", b"$0\r\n\r\n", wire(("array", [("null", None), ("integer", 5)]))]
    assert len(flat_rows(usual)) == len(usual)
    assert flat_rows([wire(("array", [("integer", 1)] * (resp.STEPS + 1))), wire(("simple", "é".encode())), b"", wire(("integer", 2**62))]) == {}
    assert flat_rows([]) == {}


def cut_up(rnd, data):
    at = sorted(rnd.randrange(len(data) + 1) for _ in range(rnd.randrange(1, 9)))
    return [data[i:j] for i, j in zip([0, *at], [*at, len(data)], strict=True)]


def conversations(rnd):
    frames = [("array", [("bulk", b"GET"), ("bulk", bytes(rnd.randrange(256) for _ in range(rnd.randrange(6))))]) for _ in range(4)]
    whole = [wire(f) for f in frames]
    joined = b"".join(whole)
    said = [(i, "frame", w) for i, w in enumerate(whole)]
    return {
        "ends": (joined, [*said, (4, "end", b"")]),
        "cut": (joined + whole[0][:-1], [*said, (4, "ConnectionReset", whole[0][:-1])]),
        "wrong": (joined + b"?\r\n" + joined, [*said, (4, "BadEncoding", None)]),
        "silent": (b"", [(0, "end", b"")]),
    }


def test_frames_are_taken_off_as_they_come():
    rnd = random.Random(3)
    for _ in range(20):
        for data, expected in conversations(rnd).values():
            got = list(resp.frames_of_chunks(resp.FrameReader(), 0, iter(cut_up(rnd, data)), True))
            assert [g[:2] for g in got] == [e[:2] for e in expected]
            assert all(e[2] in (None, g[2]) for g, e in zip(got, expected, strict=True))
    reader = resp.FrameReader()
    assert list(reader.push(b"+a\r")) == [] and reader.rest == b"+a\r"
    assert [f for f, _ in reader.push(b"\n:1\r\n$")] == [b"+a\r\n", b":1\r\n"] and reader.rest == b"$"


def test_connections_in_a_table(spark):
    rnd = random.Random(9)
    said, rows = {}, []
    for name, (data, expected) in conversations(rnd).items():
        said[name] = [e[:2] for e in expected]
        rows += [(name, i, c or None, "x") for i, c in enumerate(cut_up(rnd, data))]
    rows += [(None, 1, b"+x\r\n", "x")]
    rnd.shuffle(rows)
    got = {}
    for r in resp.read_frames(spark.createDataFrame(rows, "connection string, n int, bytes binary, status string").repartition(3)).collect():
        got.setdefault(r["connection"], []).append((r["frame_no"], r["status"]))
    assert {k: sorted(v) for k, v in got.items()} == said
    assert resp.read_frames(spark.createDataFrame([], "connection string, n int, bytes binary")).count() == 0


def test_a_stream_of_connections(spark, tmp_path):
    from logloom.config import Net
    from logloom.streaming import frames

    rnd = random.Random(4)
    said, waves = {}, [[], [], []]
    for name, (data, expected) in conversations(rnd).items():
        said[name] = [e[:2] for e in expected]
        for i, c in enumerate(cut_up(rnd, data)):
            waves[min(i, 2)].append((name, i, c, False))
        waves[2].append((name, 99, None, True))
    for i, rows in enumerate(waves):
        spark.createDataFrame(rows, frames.CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = frames.chunk_files(spark, str(tmp_path / "in"), Net(max_connections=1))
        out = frames.stream_frames(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        out.outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r["connection"], []).append((r["frame_no"], r["status"]))
    assert {k: sorted(v) for k, v in got.items()} == said


@pytest.mark.parametrize(
    "parts",
    [
        [b"GET", b"a"], [b"GET"], [b"GET", b"a", b"b"], [b"GET", b"\xfe", b"b"], [b"SET", b"a", b"\xfe"], [b"SET"], [b"SET", b"a"], [b"SET", b"a", b"v", b"x"], [b"SET", b"a", None],
        [b"SET", None, b"v"], [b"DEL", b"x", b"y"], [b"DEL"], [b"DEL", b"x", b"\xfe"], [b"DEL", None, b"\xfe"], [b"del", b"a"], [b"\xff"], [], [None],
    ],
)
def test_commands_are_checked_alike_one_at_a_time(spark, parts):
    rows = list(rows_of(("array", [("bulk", p) if p is not None else ("integer", 1) for p in parts])))
    df = spark.createDataFrame([(parts,)], "p array<binary>")
    assert resp.command_fault(rows) == df.select(resp.command_error(F.col("p"))).first()[0]
    assert resp.command_fault([([], "simple", None, b"GET", None)]) == "BadFrame"


def test_a_served_connection(spark, tmp_path):
    from logloom.api import KeyedLog
    from logloom.streaming import commands, frames

    def sent(*parts):
        return wire(("array", [("bulk", p) for p in parts]))

    rnd = random.Random(2)
    talk = {
        "a": ([sent(b"SET", b"k", b"1"), sent(b"GET", b"k"), sent(b"DEL", b"k", b"none"), sent(b"GET", b"k"), sent(b"SET", b"k", b"")], [b"+OK\r\n", b"$1\r\n1\r\n", b":1\r\n", b"$-1\r\n", b"+OK\r\n"]),
        "b": ([sent(b"SET", b"own", b"x"), sent(b"get", b"own"), sent(b"SET", b"own", b"never")], [b"+OK\r\n"]),
        "c": ([sent(b"GET", b"absent")[:-1]], []),
    }
    waves = [[], []]
    for name, (messages, _) in talk.items():
        for i, c in enumerate(cut_up(rnd, b"".join(messages))):
            waves[min(i // 2, 1)].append((name, i, c, False))
    store = KeyedLog.open(spark, str(tmp_path / "s"))
    for rows in waves:
        spark.createDataFrame(rows, frames.CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = frames.serve_connections(frames.chunk_files(spark, str(tmp_path / "in")), store, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert commands.stop_gracefully(query, 120)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r["connection"], []).append((r["frame_no"], bytes(r["bytes"])))
    assert {k: sorted(v) for k, v in got.items()} == {name: list(enumerate(said)) for name, (_, said) in talk.items() if said}
    assert store.get(b"k") == b"" and store.get(b"own") == b"x"


def test_messages_in_a_table(spark):
    rows = [(1, wire(("array", [("integer", 5), ("array", [])]))), (2, b"$9\r\nshort"), (3, None), (4, b":7z\r\n"), (4, "+ü\r\n".encode()), (5, b"*1\r\n$2\r\nab\r\n")]
    df = spark.createDataFrame(rows, "frame_id int, bytes binary").withColumn("kind", F.lit("clash"))
    got = sorted((r["frame_id"], r["path"], r["kind"], r["int_val"], bytes(r["bytes_val"]) if r["bytes_val"] is not None else None, r["n_items"]) for r in resp.decode_frames(df).collect())
    assert got == [
        (1, [], "array", None, None, 2), (1, [0], "integer", 5, None, None), (1, [1], "array", None, None, 0), (2, [], "Incomplete", None, b"", None),
        (3, [], "Incomplete", None, b"", None), (4, [], "NotInteger", None, b"7z", None), (4, [], "simple", None, "ü".encode(), None),
        (5, [], "array", None, None, 1), (5, [0], "bulk", None, b"ab", None),
    ]
    assert sorted(tuple(r) for r in resp.check_frames(df).collect()) == [(1, "OK"), (2, "Incomplete"), (3, "Incomplete"), (4, "NotInteger"), (4, "OK"), (5, "OK")]
    assert resp.decode_frames(df.limit(0)).count() == 0


def test_encoding_is_undone_by_decoding(spark):
    replies = [("simple", None, b"OK"), ("error", None, b"ERR full"), ("integer", -5, None), ("bulk", None, b"a\r\n\xff"), ("bulk", None, b""), ("null", None, None)]
    df = spark.createDataFrame(replies, "kind string, i long, b binary")
    frames = df.select(resp.encode_reply(F.col("kind"), F.col("i"), F.col("b"))).collect()
    for reply, frame in zip(replies, frames, strict=True):
        assert resp.decode(bytes(frame[0]))[0] == [([], reply[0], reply[1], reply[2], None)]
    commands = [[b"SET", b"k", b"\x00\r\n"], [b"GET"], []]
    parts = spark.createDataFrame([(c,) for c in commands], "p array<binary>")
    got = [bytes(r[0]) for r in parts.select(resp.encode_command(F.col("p"))).collect()]
    assert got == [wire(("array", [("bulk", p) for p in c])) for c in commands]


def test_commands_are_checked(spark):
    extra = "BadArguments: Frame contains extra data"
    cases = [
        ([b"GET", b"a"], None), ([b"GET"], "BadArguments: Key is not given"), ([b"GET", b"a", b"b"], extra), ([b"GET", b"\xfe", b"b"], "NotUtf8"),
        ([b"SET", b"a", b"\xfe"], None), ([b"SET"], "BadArguments: Key is not given"), ([b"SET", b"a"], "BadArguments: Value is not given"),
        ([b"SET", b"a", b"v", b"x"], extra), ([b"SET", b"a", None], "BadFrame"), ([b"DEL", b"a"], None), ([b"DEL", b"x", b"y", b"x"], None),
        ([b"DEL"], "BadArguments: Keys are empty"), ([b"DEL", b"x", b"\xfe"], "NotUtf8"), ([b"DEL", None, b"\xfe"], "BadFrame"),
        ([b"del", b"a"], "BadCommand: del"), ([b"FLUSH"], "BadCommand: FLUSH"), ([], "BadCommand: "), ([None], "BadFrame"), (None, "BadFrame"),
    ]
    df = spark.createDataFrame([(p,) for p, _ in cases], "p array<binary>")
    assert [r[0] for r in df.select(resp.command_error(F.col("p"))).collect()] == [e for _, e in cases]


def test_messages_are_parsed(spark):
    def command(*parts):
        return wire(("array", [p if isinstance(p, tuple) else ("bulk", p) for p in parts]))

    rows = [
        (1, command(b"SET", b"a", b"\xfe")), (2, command(b"DEL", b"x", b"")), (3, command(b"GET", ("integer", 4))), (4, wire(("simple", b"GET"))),
        (5, command(b"GET", b"abc")[:-4]), (6, None), (7, command(b"get", b"a")), (8, command(b"GET", ("array", [("bulk", b"a")]))),
        (9, command(b"DEL", *[b"%d" % i for i in range(100)])),
    ]
    got = {r["seq"]: tuple(r)[1:] for r in resp.parse_commands(spark.createDataFrame(rows, "seq int, bytes binary")).collect()}
    assert got[1] == ("SET", [b"a"], b"\xfe", None) and got[2] == ("DEL", [b"x", b""], None, None) and len(got[9][1]) == 100
    assert [got[i][3] for i in range(3, 9)] == ["BadFrame", "BadFrame", "Incomplete", "Incomplete", "BadCommand: get", "BadFrame"]
    assert all(got[i][:3] == (None, None, None) for i in range(3, 9))


def test_replies_are_shown(spark):
    rows = [("simple", None, b"OK"), ("bulk", None, b"tea"), ("bulk", None, b""), ("bulk", None, b'\xfe\x00z"\\\n\x02'), ("null", None, None), ("integer", 12, None)]
    df = spark.createDataFrame(rows, "k string, i long, b binary")
    assert [r[0] for r in df.select(resp.render(F.col("k"), F.col("i"), F.col("b"))).collect()] == [
        '"OK"', '"tea"', '""', 'b"\\xfe\\0z\\"\\\\\\n\\x02"', "(nil)", "(integer) 12",
    ]


def test_replies_are_checked(spark):
    cases = [("GET", "bulk", b"v", None), ("GET", "null", None, None), ("GET", "simple", b"OK", "BadFrame"), ("SET", "simple", b"OK", None), ("SET", "simple", b"no", "BadFrame"),
             ("DEL", "integer", None, None), ("DEL", "null", None, "BadFrame"), ("DEL", "error", b"x", "Storage: x"), ("GET", None, None, "ConnectionReset"), ("PUT", "simple", b"OK", "BadFrame")]
    df = spark.createDataFrame(cases, "op string, k string, b binary, e string")
    assert [r[0] for r in df.select(resp.reply_error(F.col("op"), F.col("k"), F.col("b"))).collect()] == [c[3] for c in cases]
