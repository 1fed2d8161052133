"""Scalar expressions of the store."""

from __future__ import annotations

import random
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a record besides key and value, of a tombstone and of a hint besides the key.
RECORD_BYTES, TOMBSTONE_BYTES, HINT_BYTES = 25, 17, 32
DATA_SUFFIX, HINT_SUFFIX = ".log.data", ".log.hint"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record_size(key: Column | str = "key", value: Column | str = "value") -> Column:
    """Bytes of a record in a data file; a NULL value makes it a tombstone. NULL for a NULL key."""
    key, value = _col(key), _col(value)
    put = F.octet_length(key) + F.octet_length(value) + F.lit(RECORD_BYTES)
    return F.coalesce(put, F.octet_length(key) + F.lit(TOMBSTONE_BYTES)).cast("bigint")


def hint_size(key: Column | str = "key") -> Column:
    return (F.octet_length(_col(key)) + F.lit(HINT_BYTES)).cast("bigint")


def fragmentation(dead: Column | str = "dead_keys", live: Column | str = "live_keys") -> Column:
    """The share of dead records; 0 where none is dead, also where there are no records."""
    dead, live = _col(dead), _col(live)
    return F.when(dead == 0, F.lit(0.0)).otherwise(dead / (dead + live))


def data_file_name(fileid: Column | str = "fileid") -> Column:
    return F.concat(_col(fileid).cast("string"), F.lit(DATA_SUFFIX))


def file_id(name: Column | str) -> Column:
    """The id in the name of a data file: the digits before the first dot. NULL for other names."""
    name = _col(name)
    stem = F.when(name.endswith(".data"), F.regexp_extract(name, r"^\+?([0-9]+)\.", 1))
    return F.try_to_number(F.when(F.length(stem) > 0, stem), F.lit("9" * 19)).cast("bigint")


def is_utf8(column: Column | str) -> Column:
    return F.is_valid_utf8(_col(column))


def place_number(fileid: str = "fileid", pos: str = "pos") -> Column:
    """The place of a record as one number, which orders as ``(fileid, pos)`` does; neither is negative.

    Aggregates of numbers fold in hash tables, those of structs only after sorting.
    """
    return F.expr(f"CAST({fileid} AS decimal(19, 0)) * 10000000000000000000BD + {pos}").cast("decimal(38, 0)")


def place_of(number: Column) -> tuple[Column, Column]:
    """The file id and the position of such a number."""
    step = F.expr("10000000000000000000BD")
    return F.floor(number / step).cast("bigint"), (number % step).cast("bigint")


def in_window(hour: Column | str, start: int, end: int) -> Column:
    """Whether an hour lies in a merge window, both ends included. A window doesn't go past midnight."""
    return _col(hour).between(start, end)


def now_nanos() -> Column:
    """The time of the call in nanoseconds since the epoch; Spark's own clock gives microseconds."""
    return F.lit(time.time_ns())


def jitter_bounds(interval: Column | str, jitter: Column | str) -> tuple[Column, Column]:
    """The least and the most that a jittered interval takes."""
    interval, jitter = _col(interval), _col(jitter)
    return interval - interval * jitter, interval + interval * jitter


def jittered(interval: float, jitter: float) -> float:
    return random.uniform(interval - interval * jitter, interval + interval * jitter)


def backoff_schedule(spark: SparkSession, least: int, most: int) -> DataFrame:
    """``attempt, wait_ms``: how long to wait after each failed attempt, twice as long each time.

    The first attempt that fails when the wait would be longer than ``most`` is an error: the
    schedule ends before it.
    """
    if least <= 0:
        raise ValueError("the first wait must be positive")
    steps, wait = [], least
    while wait <= most:
        steps.append(wait)
        wait *= 2
    return spark.range(len(steps)).select(
        (F.col("id") + 1).alias("attempt"), (F.lit(least) * F.pow(F.lit(2), F.col("id"))).cast("bigint").alias("wait_ms")
    )
