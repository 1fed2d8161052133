"""Merging chosen files of a log, hints for what was merged, and recovery from both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.config import Thresholds
from logloom.operators import stats
from logloom.operators.consolidate import TARGET_FILE_BYTES, Consolidation, consolidate, copied, kept_of, stored
from logloom.operators.log import index_of, newest, records


def flags_of(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """``fileid, chosen``: for each file of an index whether it is one of ``chosen``, which has unique ``fileid``."""
    marked = chosen.select("fileid", F.lit(True).alias("mark"))
    files = index.select("fileid").distinct()
    return files.join(marked, "fileid", "left").select("fileid", F.coalesce("mark", F.lit(False)).alias("chosen"))


def chosen_by(index: DataFrame, thresholds: Thresholds) -> DataFrame:
    """``fileid, chosen``: for each file of an index whether a merge by these thresholds takes it in."""
    of = stats.index_stats(index)
    return of.select("fileid", stats.is_candidate(thresholds).alias("chosen"))


def rewritten(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """The records of the chosen files that a merge copies, with all columns and ``tombstone``.

    ``chosen``: ``fileid, chosen`` of each file. Live records are copied, and newest
    tombstones that still hide a value in a file outside the merge; without those the value
    would come back.
    """
    return copied(log, chosen, kept_of(log, chosen)).withColumn("tombstone", F.col("value").isNull())


def merge(
    log: DataFrame, thresholds: Thresholds, root: str, first_fileid: int, target_bytes: int = TARGET_FILE_BYTES
) -> tuple[DataFrame, Consolidation]:
    """Merges the files of a log that the thresholds name. Returns ``fileid, chosen`` of each file, and what was written.

    The log is read once without values, for an index that is stored below ``root`` and serves all decisions, and once more
    to copy what must be kept.
    """
    index = stored(index_of(log), f"{root}/index")
    chosen = stored(chosen_by(index, thresholds), f"{root}/chosen")
    return chosen, consolidate(log, chosen, root, first_fileid, target_bytes, index)


def unmerged(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """The records of files that aren't merged. ``chosen``: ``fileid, chosen`` of each file."""
    gone = chosen.where("chosen").select("fileid")
    return records(log).join(gone, "fileid", "left_anti").select("fileid", "pos", "len", "tstamp", "key", "value")


def hints(log: DataFrame) -> DataFrame:
    """The hints of a log: where its live records lie, without their values."""
    return newest(log).where("NOT tombstone").select("fileid", "pos", "len", "tstamp", "key")


def recovery_index(log: DataFrame, hint: DataFrame) -> DataFrame:
    """``fileid, pos, len, tstamp, key, tombstone``: what recovery reads of each file.

    Of a file with hints only these, of others its records without their values. Hints of a
    file that the log lacks are ignored. Repeated rows count once.
    """
    columns = ["fileid", "pos", "len", "tstamp", "key"]
    files = records(log).select("fileid").distinct()
    own = records(hint).select(*columns).distinct().join(files, "fileid", "left_semi")
    hinted = own.select("fileid").distinct()
    data = records(log).select(*columns, F.col("value").isNull().alias("tombstone")).distinct()
    return own.withColumn("tombstone", F.lit(False)).unionByName(data.join(hinted, "fileid", "left_anti"))


def newest_of_index(index: DataFrame) -> DataFrame:
    """``key, fileid, pos, len, tstamp, tombstone`` of the newest record of each key of an index."""
    r = F.max(F.struct("fileid", "pos", "len", "tstamp", "tombstone")).alias("r")
    return index.groupBy("key").agg(r).select("key", "r.*")


def recover(log: DataFrame, hint: DataFrame) -> DataFrame:
    """The index after recovery: ``key, fileid, pos, len, tstamp`` of each live key."""
    return newest_of_index(recovery_index(log, hint)).where("NOT tombstone").drop("tombstone")
