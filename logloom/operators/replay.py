"""Streams of GET, SET and DEL commands, each answered by the state at its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the stream that share a block of a key's history, and the most blocks; with more rows, blocks become longer.
BLOCK, MOST_BLOCKS = 1_000_000, 1 << 14


def touches(commands: DataFrame) -> DataFrame:
    """``seq, idx, op, key, value``: a row for each key of each command, in the order of its keys."""
    return commands.select("seq", "op", "value", F.posexplode("keys").alias("idx", "key")).select("seq", "idx", "op", "key", "value")


def block_of(rows: DataFrame, block: int = BLOCK) -> Column | None:
    """The block of each row by its ``seq``, or None if one holds all: blocks have about ``block`` rows each, however ``seq`` is spaced.

    Where blocks begin comes from quantiles of ``seq``, of which the driver gets at most ``MOST_BLOCKS``; a few rows more or less make
    no difference to any result.
    """
    n = rows.count()
    if n <= block:
        return None
    blocks = min(MOST_BLOCKS, -(-n // block))
    shares = [i / blocks for i in range(1, blocks)]
    begins = sorted(set(rows.agg(F.percentile_approx("seq", shares, max(10_000, 2 * blocks)).alias("q")).first()["q"] or []))
    # A binary search for the number of blocks that begin at or before a row.
    steps = F.array(*[F.lit(1 << i) for i in range(len(begins).bit_length() - 1, -1, -1)])
    known = F.lit(begins)
    return F.reduce(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= F.col("seq"), at + step).otherwise(at))


def with_previous(rows: DataFrame, initial: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Adds ``previous``, the last SET or DEL of the same key before each row, NULL without one.

    ``rows``: ``seq, idx, op, key, value``, with ``seq`` not NULL. ``initial``: ``key, value`` that hold before the first.

    A key's history is cut into blocks of the stream. Within a block a window finds the last
    change before each row. What holds at the start of a block comes from one row for each
    block and key, folded before the shuffle. So a key that a third of all commands use is
    spread over as many tasks as the stream has blocks. A stream of one block needs only the window.
    """
    number = block_of(rows, block)
    at = F.struct("seq", "idx")
    change = F.when(F.col("op").isin("SET", "DEL"), F.struct("op", "value"))
    if number is None:
        all_rows = rows
        if initial is not None:
            none = F.lit(None).cast(rows.schema["seq"].dataType)
            all_rows = rows.unionByName(initial.select(none.alias("seq"), F.lit(0).alias("idx"), F.lit("SET").alias("op"), "key", "value"))
        own = Window.partitionBy("key").orderBy(F.col("seq").asc_nulls_first(), "idx").rowsBetween(Window.unboundedPreceding, -1)
        found = all_rows.withColumn("previous", F.last(change, ignorenulls=True).over(own))
        return found.where("seq IS NOT NULL").select("seq", "idx", "op", "key", "value", "previous")
    cut = rows.withColumn("block", number.cast("bigint")).withColumn("change", change)
    own = Window.partitionBy("key", "block").orderBy("seq", "idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by("change", F.when(F.col("change").isNotNull(), at)).alias("end")
    blocks = cut.groupBy("key", "block").agg(last)
    if initial is not None:
        first = initial.select(
            "key", F.lit(None).cast("bigint").alias("block"), F.struct(F.lit("SET").alias("op"), F.col("value")).alias("end")
        )
        blocks = blocks.unionByName(first)
    earlier = Window.partitionBy("key").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("key", "block", F.last("end", ignorenulls=True).over(earlier).alias("carry")).where("carry IS NOT NULL")
    return (
        cut.withColumn("inner", F.last("change", ignorenulls=True).over(own))
        .join(carry, ["key", "block"], "left")
        .select("seq", "idx", "op", "key", "value", F.coalesce("inner", "carry").alias("previous"))
    )


def replay(commands: DataFrame, initial: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``seq, kind, int_val, bytes_val``: the reply to each command, as if they ran one by one.

    ``commands``: ``seq, op, keys, value``; ``seq`` is unique and gives the order. GET replies with
    the value as ``bulk`` or with ``null``, SET with ``simple`` OK, DEL with the ``integer`` of keys
    that were live; a key named twice in one DEL counts once. GET and SET have one key; should they have more, the first counts.
    Commands of another ``op``, without keys or without ``seq`` get no reply. A NULL value in a SET sets the empty value.
    """
    rows = with_previous(touches(_known(commands)), initial, block)
    live = F.coalesce(F.col("previous.op") == "SET", F.lit(False))
    op = F.first("op")
    deleted = F.count_if(live)
    held = F.first(F.when(live, F.col("previous.value")))
    return rows.groupBy("seq").agg(
        F.when(op == "DEL", "integer").when(op == "SET", "simple").when(deleted > 0, "bulk").otherwise("null").alias("kind"),
        F.when(op == "DEL", deleted).alias("int_val"),
        F.when(op == "SET", F.lit(bytearray(b"OK"))).when(op == "GET", held).alias("bytes_val"),
    )


def _known(commands: DataFrame) -> DataFrame:
    keys = F.when(F.col("op") == "DEL", F.col("keys")).otherwise(F.slice("keys", 1, 1))
    value = F.when(F.col("op") == "SET", F.coalesce("value", F.lit(bytearray(b""))))
    return commands.where("op IN ('GET', 'SET', 'DEL') AND seq IS NOT NULL").withColumns({"keys": keys, "value": value})


def final_changes(commands: DataFrame) -> DataFrame:
    """``key, seq, value`` of the last SET or DEL of each key; DEL has a NULL value."""
    rows = touches(_known(commands).where("op != 'GET'"))
    last = F.max_by(F.struct("seq", "value"), F.struct("seq", "idx")).alias("last")
    return rows.groupBy("key").agg(last).select("key", "last.*")
