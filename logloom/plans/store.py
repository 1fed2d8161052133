"""Queries of the problems on the keyed-log store that aren't about language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import changes, consolidate, heavy, incremental
from logloom.session import new_folder
from logloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.rebuild_store(table(spark, d, "change_feed")).select(F.hex("key").alias("key_hex"), "change_no")


def p2_store(spark: SparkSession, d: str) -> DataFrame:
    store = changes.rebuild_store(table(spark, d, "change_feed"))
    return store.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "tstamp", "change_no")


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """The feed as changes of a table with two fields, of which a change sets those that it has: the value, and who set it.

    A change without a value deletes the row; no change replaces it. So a change that lacks a producer leaves the one before.
    """
    feed = table(spark, d, "change_feed")
    rows = feed.withColumn("producer", F.when(F.pmod("change_no", F.lit(3)) != 0, F.col("producer")))
    one = changes.distinct_changes(rows, "key", "change_no", "tstamp", ["value", "producer"])
    fields = {"value": ("value", "value_set"), "producer": ("producer", "producer_set")}
    out = changes.apply_changes(one, "key", ["tstamp", "change_no"], fields, deletes="NOT value_set")
    return out.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "producer")


def _unread(spark: SparkSession, d: str) -> DataFrame:
    return incremental.unread_records(
        table(spark, d, "log_entries"), table(spark, d, "run_marks"), table(spark, d, "run_ledger"), new_folder(spark, "unread")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _unread(spark, d).select("fileid", "pos")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return _unread(spark, d).select(F.hex("key").alias("key_hex"), "tstamp", "fileid", "pos")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs, between which the newer half of the log's files arrives, and one that fails: what they bring out together."""
    rows, marks, ledger = (table(spark, d, name) for name in ("log_entries", "run_marks", "run_ledger"))
    reader = incremental.UnreadRecords(spark, new_folder(spark, "unread"))
    reader.adopt(rows, marks, ledger)
    low, high = rows.agg(F.min("fileid"), F.max("fileid")).first()
    first = reader.run(rows.where(F.col("fileid") <= ((low or 0) + (high or 0)) // 2))
    reader.prepare(rows)  # never committed, as if it failed at its end
    return first.unionByName(reader.run(rows)).select("fileid", "pos")


def _consolidated(spark: SparkSession, d: str) -> consolidate.Consolidation:
    return consolidate.consolidate_small(table(spark, d, "log_entries"), new_folder(spark, "consolidated"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Where the records of the new files, as these are read again, were before."""
    return _consolidated(spark, d).files.select(F.col("old_fileid").alias("fileid"), F.col("old_pos").alias("pos"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of the new files, with values and times."""
    return _consolidated(spark, d).files.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "tstamp", "len")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """The new files with their key ranges, as their metadata says."""
    return _consolidated(spark, d).ranges.withColumns({c: F.hex(c) for c in ("min_key", "max_key")})


def p4_sums(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the new files, by their metadata: records and bytes in all, no file longer than the target and a record, and
    no two files of values, or of tombstones, with keys of one another."""
    made = _consolidated(spark, d)
    longest = made.files.agg(F.max("len")).first()[0] or 0
    sums = made.ranges.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("bytes") > F.lit(longest) + consolidate.TARGET_FILE_BYTES).alias("too_long"),
    )
    return sums.withColumn("overlapping", F.lit(made.overlaps().first()["n"]))


def p4_small(spark: SparkSession, d: str) -> DataFrame:
    """Files by what the log says of them: how many, and how many of them are small."""
    sizes = consolidate.file_sizes(table(spark, d, "log_entries"))
    return sizes.groupBy((F.col("bytes") < consolidate.SMALL_FILE_BYTES).alias("small")).agg(
        F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_keys(table(spark, d, "log_entries")).select(F.hex("key").alias("key_hex"))


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "log_entries")
    totals = heavy.with_newest_times(heavy.key_totals(rows), rows)
    return totals.select(F.hex("key").alias("key_hex"), "records", "bytes", "fileid", "pos", "tstamp")


QUERIES = {f.__name__: f for f in (p2_found, p2_store, p2_fields, p3_found, p3_records, p3_runs, p4_found, p4_records, p4_files, p4_sums, p4_small, p5_found, p5_totals)}

_P2 = """
WITH one AS (
  SELECT key, change_no, min(tstamp) AS tstamp, min(value) AS value
  FROM change_feed WHERE key IS NOT NULL AND change_no IS NOT NULL GROUP BY key, change_no
), last AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY tstamp DESC, change_no DESC) AS n FROM one
)
SELECT hex(key) AS key_hex, {} FROM last WHERE n = 1 AND value IS NOT NULL
"""
_P3 = """
WITH last AS (
  SELECT run_id, attempt, status,
    row_number() OVER (PARTITION BY run_id, attempt ORDER BY line_no DESC) AS n
  FROM run_ledger
), upto AS (
  SELECT m.fileid, max(m.upto_pos) AS upto FROM run_marks m
  JOIN last l ON l.run_id = m.run_id AND l.attempt = m.attempt
  WHERE l.n = 1 AND lower(trim(l.status)) = 'succeeded' GROUP BY m.fileid
), rows AS (
  SELECT l.key, l.tstamp, l.fileid, l.pos, coalesce(l.pos <= u.upto, false) AS seen,
    row_number() OVER (PARTITION BY l.key, l.tstamp ORDER BY l.fileid, l.pos) AS n
  FROM log_entries l LEFT JOIN upto u ON u.fileid = l.fileid
), unread AS (
  SELECT key, tstamp FROM rows GROUP BY key, tstamp HAVING NOT bool_or(seen)
)
SELECT {} FROM rows r JOIN unread u ON u.key = r.key AND u.tstamp = r.tstamp WHERE r.n = 1
"""
_P4 = """
WITH one AS (
  SELECT DISTINCT fileid, pos, len, tstamp, key, value, value IS NULL AS tombstone FROM log_entries
), sizes AS (
  SELECT fileid, count(*) AS records, sum(len) AS bytes FROM one GROUP BY fileid
)"""
_KEPT = (
    _P4
    + """, ranked AS (
  SELECT o.*, s.bytes < 4096 AS small,
    row_number() OVER (PARTITION BY o.key ORDER BY o.fileid DESC, o.pos DESC) AS n
  FROM one o JOIN sizes s ON s.fileid = o.fileid
), large AS (SELECT DISTINCT key FROM ranked WHERE NOT small AND NOT tombstone),
kept AS (
  SELECT r.* FROM ranked r LEFT JOIN large l ON l.key = r.key
  WHERE r.n = 1 AND r.small AND (NOT r.tombstone OR l.key IS NOT NULL)
) """
)
_P5 = """
WITH one AS (SELECT DISTINCT fileid, pos, len, tstamp, key FROM log_entries)
"""

ORACLE = {
    "p2_found": _P2.format("change_no"),
    "p2_store": _P2.format("hex(value) AS value_hex, tstamp, change_no"),
    "p2_fields": """
WITH one AS (
  SELECT key, change_no, min(tstamp) AS tstamp, min(value) AS value, min(CASE WHEN change_no % 3 <> 0 THEN producer END) AS producer
  FROM change_feed WHERE key IS NOT NULL AND change_no IS NOT NULL GROUP BY key, change_no
), placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tstamp, change_no) AS n FROM one),
gone AS (SELECT key, max(n) FILTER (WHERE value IS NULL) AS n FROM placed GROUP BY key),
after AS (SELECT p.* FROM placed p JOIN gone g ON g.key = p.key WHERE g.n IS NULL OR p.n > g.n)
SELECT hex(key) AS key_hex, hex(arg_max(value, n)) AS value_hex, arg_max(producer, n) FILTER (WHERE producer IS NOT NULL) AS producer
FROM after GROUP BY key
""",
    "p3_found": _P3.format("r.fileid, r.pos"),
    "p3_runs": _P3.format("r.fileid, r.pos"),
    "p3_records": _P3.format("hex(r.key) AS key_hex, r.tstamp, r.fileid, r.pos"),
    "p4_found": _KEPT + "SELECT fileid, pos FROM kept",
    "p4_records": _KEPT + "SELECT hex(key) AS key_hex, hex(value) AS value_hex, tstamp, len FROM kept",
    "p4_sums": _KEPT
    + """SELECT count(*) AS records, CAST(coalesce(sum(len), 0) AS BIGINT) AS bytes,
  CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS overlapping FROM kept""",
    "p4_small": _P4
    + """
SELECT bytes < 4096 AS small, count(*) AS files, CAST(sum(records) AS BIGINT) AS records,
  CAST(sum(bytes) AS BIGINT) AS bytes
FROM sizes GROUP BY 1
""",
    "p5_found": _P5
    + """
SELECT hex(key) AS key_hex FROM one GROUP BY key HAVING count(*) * 100 >= (SELECT count(*) FROM one)
""",
    "p5_totals": _P5
    + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY fileid DESC, pos DESC) AS n FROM one
), sums AS (SELECT key, count(*) AS records, CAST(sum(len) AS BIGINT) AS bytes FROM one GROUP BY key)
SELECT hex(r.key) AS key_hex, s.records, s.bytes, r.fileid, r.pos, r.tstamp
FROM ranked r JOIN sums s ON s.key = r.key WHERE r.n = 1
""",
}
