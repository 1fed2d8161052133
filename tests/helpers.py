"""Small tables and plain Python versions of what the operators compute."""

import os
import random

LOG_DDL = "fileid bigint, pos bigint, len bigint, tstamp bigint, key binary, value binary"
DATA = "/root/testdata/sf0.001"


def size(key, value):
    return 17 + len(key) if value is None else 25 + len(key) + len(value)


def random_log(seed, files=12, most=12, keys=9):
    """Rows of a log with tombstones, empty keys and values, repeated rows, and ids with gaps; one key is hot."""
    rnd = random.Random(seed)
    names = [b"", b"hot", *[bytes([rnd.randrange(256) for _ in range(rnd.randrange(1, 5))]) for _ in range(keys)]]
    rows, fileid = [], 7
    for _ in range(files):
        fileid += rnd.randrange(1, 4)
        pos = 0
        for _ in range(rnd.randrange(1, most)):
            key = b"hot" if rnd.random() < 0.35 else rnd.choice(names)
            value = None if rnd.random() < 0.25 else bytes(rnd.randrange(256) for _ in range(rnd.randrange(0, 30)))
            rows.append((fileid, pos, size(key, value), rnd.randrange(50), key, value))
            pos += size(key, value)
    rows += rnd.sample(rows, len(rows) // 5)
    rnd.shuffle(rows)
    return rows


def plain(rows):
    """Rows as tuples with bytes instead of bytearrays, sorted."""
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows), key=repr)


def in_order(rows):
    return sorted(set(rows), key=lambda r: r[:2])


def state(rows):
    """What a log holds: the newest record of each live key."""
    held = {}
    for r in in_order(rows):
        held[r[4]] = r
    return {k: r for k, r in held.items() if r[5] is not None}


def compare_with_sql(spark, queries, oracle, folder=DATA):
    """The names of queries whose rows differ from those of their SQL in DuckDB."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")

    def shape(rows, columns):
        at = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at]) for r in rows)

    differ = []
    for name, sql in oracle.items():
        df = queries[name](spark, folder)
        cursor = con.execute(sql)
        expected = cursor.fetchall()
        columns = [c[0] for c in cursor.description]
        if sorted(columns) != sorted(df.columns) or shape(df.collect(), df.columns) != shape(expected, columns):
            differ.append(name)
    return differ
