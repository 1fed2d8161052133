import random

import pytest
from logloom.operators import replay
from pyspark.sql import functions as F

from tests.helpers import plain

DDL = "seq long, op string, keys array<binary>, value binary"


def random_commands(seed, n=120):
    rnd = random.Random(seed)
    keys = [b"hot", b"hot", b"hot", b"", b"a", b"\xff"]
    out = []
    for seq in range(n):
        op = rnd.choice(["GET", "SET", "DEL"])
        if op == "DEL":
            out.append((seq, op, [rnd.choice(keys) for _ in range(rnd.randrange(1, 4))], None))
        else:
            out.append((seq, op, [rnd.choice(keys)], rnd.choice([b"", b"v", bytes([seq])]) if op == "SET" else None))
    return out


def answers(commands, held):
    held, out = dict(held), []
    for seq, op, keys, value in commands:
        if op == "SET":
            held[keys[0]] = value
            out.append((seq, "simple", None, b"OK"))
        elif op == "GET":
            v = held.get(keys[0])
            out.append((seq, "null" if v is None else "bulk", None, v))
        else:
            out.append((seq, "integer", sum(held.pop(k, None) is not None for k in keys), None))
    return out, held


@pytest.mark.parametrize("block", [7, 100, 1000])
@pytest.mark.parametrize("seed", range(2))
def test_replay(spark, seed, block):
    # Places are spaced as time stamps are, not by one.
    commands = [(seq**3 * 10**12 + (1 << 60), *r) for seq, *r in random_commands(seed)]
    df = spark.createDataFrame(random.Random(1).sample(commands, len(commands)), DDL)
    initial = {b"hot": b"first", b"z": b"1"}
    start = spark.createDataFrame(list(initial.items()), "key binary, value binary")
    assert plain(replay.replay(df, start, block).collect()) == plain(answers(commands, initial)[0])
    assert plain(replay.replay(df, None, block).collect()) == plain(answers(commands, {})[0])


def test_replay_of_nothing_and_of_odd_commands(spark):
    assert replay.replay(spark.createDataFrame([], DDL)).count() == 0
    many = spark.createDataFrame([(1, "SET", [b"k", b"l"], b"v"), (2, "GET", [b"k", b"l"], None), (3, "GET", [b"l"], None), (None, "GET", [b"k"], None)], DDL)
    assert plain(replay.replay(many).collect()) == plain([(1, "simple", None, b"OK"), (2, "bulk", None, b"v"), (3, "null", None, None)])
    odd = spark.createDataFrame([(1, "set", [b"k"], b"v"), (2, None, [b"k"], None), (3, "SET", [b"k"], None), (4, "GET", [b"k"], None), (5, "GET", [], None), (6, "DEL", None, None)], DDL)
    assert plain(replay.replay(odd).collect()) == plain([(3, "simple", None, b"OK"), (4, "bulk", None, b"")])


def test_blocks_have_even_rows(spark):
    rows = spark.range(1000).select((F.col("id") * F.col("id") * F.col("id")).alias("seq"))
    assert replay.block_of(rows, 1000) is None
    sizes = [r["count"] for r in rows.groupBy(replay.block_of(rows, 100).alias("b")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 130
    same = spark.range(500).select(F.lit(7).alias("seq"))
    assert same.groupBy(replay.block_of(same, 100).alias("b")).count().count() == 1


def test_final_changes(spark):
    commands = random_commands(3)
    got = {bytes(r["key"]): r["value"] for r in replay.final_changes(spark.createDataFrame(commands, DDL)).collect()}
    assert {k: bytes(v) for k, v in got.items() if v is not None} == answers(commands, {})[1]
