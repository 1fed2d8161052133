"""Results per key where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.scalars import place_number, place_of


def key_totals(log: DataFrame) -> DataFrame:
    """``key, records, bytes, fileid, pos`` of each key: its records, their bytes and
    where its newest record lies.

    A position counts once, however often its row is there. Rows without ``key``, ``fileid`` or
    ``pos`` hold no record; a NULL ``len`` counts as no bytes. No row is dropped or sampled.

    First each position becomes one row, spread by the position, which no key can make uneven; for that
    all rows are shuffled once, without values.
    Then all results per key are algebraic: each task folds its rows into a bounded hash table
    of mergeable states, which spills if it must, and only one state for each key and task is
    shuffled. A key that holds a third of all rows so costs its reducer a row for each task. Places are folded as
    numbers, so that no step sorts.
    """
    newest = F.max(place_number()).alias("newest")
    totals = once(log).groupBy("key").agg(F.count("*").alias("records"), F.coalesce(F.sum("len"), F.lit(0)).alias("bytes"), newest)
    fileid, pos = place_of(F.col("newest"))
    return totals.select("key", "records", "bytes", fileid.alias("fileid"), pos.alias("pos"))


def once(log: DataFrame) -> DataFrame:
    """``fileid, pos, key, len, tstamp`` of each record, once."""
    return (
        log.where("key IS NOT NULL AND fileid IS NOT NULL AND pos IS NOT NULL")
        .groupBy("fileid", "pos", "key")
        .agg(F.max("len").alias("len"), F.max("tstamp").alias("tstamp"))
    )


def with_newest_times(totals: DataFrame, log: DataFrame) -> DataFrame:
    """``key_totals`` with ``tstamp`` of each newest record: a row for each key is joined to the records by place."""
    return totals.join(once(log).select("fileid", "pos", "key", "tstamp"), ["fileid", "pos", "key"]).select(*totals.columns, "tstamp")


def heavy_keys(log: DataFrame, share: int = 100) -> DataFrame:
    """Keys that hold at least one ``share``-th of all records: ``key, records, total``."""
    return log.sparkSession.sql(
        """
        WITH totals AS (SELECT key, records FROM {totals})
        SELECT key, records, (SELECT sum(records) FROM totals) AS total
        FROM totals
        WHERE records * CAST({share} AS BIGINT) >= (SELECT sum(records) FROM totals)
        """.replace("{share}", str(int(share))),
        totals=key_totals(log),
    )
