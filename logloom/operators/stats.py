"""Statistics of data files, and which files to merge and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.config import Merge, Thresholds, Triggers
from logloom.functions.scalars import fragmentation, in_window, place_number, place_of
from logloom.operators.log import narrow


def segment_stats(log: DataFrame) -> DataFrame:
    """``fileid, live_keys, dead_keys, dead_bytes, file_bytes, fragmentation`` of each file.

    A record is live if it has a value and is the newest of its key; each tombstone is dead.
    """
    return index_stats(narrow(log))


def index_stats(index: DataFrame) -> DataFrame:
    """The same of a log's index: its records, as often as they are there, with ``tombstone`` instead of the value.

    The newest place of each key is folded in hash tables before the shuffle, so that a hot key moves as a row for each task, and
    then marks the one record that is live. Records are made unique by their places, which spread whatever key they have.
    """
    at, gone = F.max(place_number()), F.max(F.when(F.col("tombstone"), place_number()))
    last = index.groupBy("key").agg(at.alias("at"), gone.alias("gone")).where("gone IS NULL OR gone < at")
    fileid, pos = place_of(F.col("at"))
    live = last.select(fileid.alias("fileid"), pos.alias("pos"), F.lit(True).alias("live"))
    once = index.groupBy("fileid", "pos").agg(F.max("len").alias("len"))
    dead = F.col("live").isNull()
    return (
        once.join(live, ["fileid", "pos"], "left")
        .groupBy("fileid")
        .agg(
            F.count("live").alias("live_keys"),
            F.count_if(dead).alias("dead_keys"),
            F.coalesce(F.sum(F.when(dead, F.col("len"))), F.lit(0)).alias("dead_bytes"),
            F.coalesce(F.sum("len"), F.lit(0)).alias("file_bytes"),
        )
        .withColumn("fragmentation", fragmentation())
    )


def merge_trigger(stats: DataFrame, triggers: Triggers) -> DataFrame:
    """``merge``: whether any file is above a trigger; false without files."""
    above = (F.col("dead_bytes") > triggers.dead_bytes) | (F.col("fragmentation") > triggers.fragmentation)
    return stats.agg(F.coalesce(F.bool_or(above), F.lit(False)).alias("merge"))


def is_candidate(thresholds: Thresholds) -> Column:
    """Whether a merge takes in a file, by its statistics."""
    return (
        (F.col("dead_bytes") > thresholds.dead_bytes)
        | (F.col("fragmentation") > thresholds.fragmentation)
        | (F.col("file_bytes") < thresholds.small_file)
    )


def merge_candidates(stats: DataFrame, thresholds: Thresholds) -> DataFrame:
    """The statistics of the files that a merge takes in."""
    return stats.where(is_candidate(thresholds))


def allowed(merge: Merge, hour: int) -> bool:
    """Whether the policy and its hours allow a merge at an hour."""
    if isinstance(merge.policy, tuple):
        return merge.policy[0] <= hour <= merge.policy[1]
    return merge.policy != "never"


def may_merge(stats: DataFrame, merge: Merge, hour: int) -> bool:
    """Whether to merge now: the policy and its hours allow it, and a file is above a trigger."""
    return allowed(merge, hour) and merge_trigger(stats, merge.triggers).first()["merge"]


def by_merge_hour(times: DataFrame, column: str, start: int, end: int) -> DataFrame:
    """``open, n``: how many of the times lie in a merge window, and how many not; NULL times do not."""
    is_open = F.coalesce(in_window(F.hour(column), start, end), F.lit(False))
    return times.groupBy(is_open.alias("open")).agg(F.count("*").alias("n"))
