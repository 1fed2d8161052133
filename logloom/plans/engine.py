"""Queries of the store's own operators: log, lookups, statistics, merges, recovery, commands, wire format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.api import KeyedLog
from logloom.config import Merge, Net, Storage, Thresholds, Triggers
from logloom.functions import resp, scalars
from logloom.operators import compaction, log, replay, stats
from logloom.schema import COMMANDS, LOG, REPLIES
from logloom.session import new_folder
from logloom.sources import records as files
from logloom.sources.tables import table
from logloom.streaming import commands, frames

#: The test store's files are at most 64 KiB, so its limits are lower than the defaults.
TRIGGERS = Triggers(fragmentation=0.6, dead_bytes=48_000)
THRESHOLDS = Thresholds(fragmentation=0.9, dead_bytes=40_000, small_file=4096)
SEGMENT_BYTES, MERGE_HOURS = 4096, (2, 9)


def _h(*columns: str) -> list[Column]:
    return [F.hex(c).alias(f"{c}_hex") for c in columns]


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "log_entries")


def _feed(spark: SparkSession, d: str, sets: bool) -> DataFrame:
    feed = table(spark, d, "change_feed").where(f"key IS NOT NULL AND value IS {'NOT ' * sets}NULL")
    return feed.select(F.col("feed_seq").alias("seq"), "tstamp", "key", "value")


def _commands(spark: SparkSession, d: str, several: bool = False) -> DataFrame:
    """The events as commands: purchases and signups set a key, errors delete, views and clicks read."""
    e = table(spark, d, "events")
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    op = F.when(F.col("event_type").isin("purchase", "signup"), "SET").when(F.col("event_type") == "error", "DEL").otherwise("GET")
    if several:
        kind = lambda k: F.encode(F.concat(user, F.lit(f":{k}")), "UTF-8")
        own = F.encode(F.concat(user, F.lit(":"), F.when(F.col("event_type") == "signup", "signup").otherwise("purchase")), "UTF-8")
        keys = F.when(op == "DEL", F.array(kind("purchase"), kind("signup"), kind("purchase"))).otherwise(F.array(own))
    else:
        keys = F.array(F.encode(user, "UTF-8"))
    value = F.when(op == "SET", F.encode(F.col("event_id").cast("string"), "UTF-8"))
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), keys.alias("keys"), value.alias("value"))


def _parts(commands: DataFrame) -> Column:
    name = F.array(F.encode(F.col("op"), "UTF-8"))
    value = F.when(F.col("op") == "SET", F.array("value")).otherwise(F.array().cast("array<binary>"))
    return F.concat(name, F.col("keys"), value)


def log_scan(spark: SparkSession, d: str) -> DataFrame:
    return log.scan(_log(spark, d)).select("fileid", "pos", "len", "tstamp", *_h("key", "value"))


def log_file_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The log written as the bytes of its data files and read from these again."""
    read = files.from_images(files.images(_log(spark, d)))
    return read.select("fileid", "pos", "len", "tstamp", *_h("key", "value"))


def log_positions(spark: SparkSession, d: str) -> DataFrame:
    return log.positions(_log(spark, d))


def record_size(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("fileid", "pos", scalars.record_size().alias("size"), scalars.hint_size().alias("hint_size"))


def file_ids(spark: SparkSession, d: str) -> DataFrame:
    """Names of data files, hint files and others; the ids of the data files among them."""
    ids = table(spark, d, "segment_stats").select("fileid")
    names = ids.select(scalars.data_file_name().alias("name")).unionByName(
        table(spark, d, "hint_entries").select(F.concat(F.col("fileid").cast("string"), F.lit(scalars.HINT_SUFFIX)).alias("name"))
    )
    names = names.unionByName(table(spark, d, "nation").select(F.concat("n_name", F.lit(".data")).alias("name")))
    return names.select(scalars.file_id("name").alias("fileid")).where("fileid IS NOT NULL").distinct()


def next_fileid(spark: SparkSession, d: str) -> DataFrame:
    return log.next_fileid(_log(spark, d))


def file_rotation(spark: SparkSession, d: str) -> DataFrame:
    rows = log.scan(_log(spark, d)).select("fileid", "pos", "len")
    return log.rotate(rows, "fileid", ["pos"], SEGMENT_BYTES).select("fileid", "pos", "segment", "segment_pos")


def snapshot_latest(spark: SparkSession, d: str) -> DataFrame:
    return log.snapshot(_log(spark, d)).select(*_h("key", "value"), "fileid", "pos", "len", "tstamp")


def replaced_records(spark: SparkSession, d: str) -> DataFrame:
    return log.replaced(_log(spark, d))


def get_batch(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "change_feed").select("feed_seq", "key")
    return log.get_batch(requests, _log(spark, d)).select("feed_seq", "found", *_h("value"))


def store_get(spark: SparkSession, d: str) -> DataFrame:
    """The log loaded into a store and merged, the store opened again, and the feed's keys looked up by the recovered index."""
    root, conf = new_folder(spark, "store"), Storage(max_file_size=65_536, merge=Merge(thresholds=THRESHOLDS))
    with KeyedLog.open(spark, root, conf) as store:
        store.load(_log(spark, d))
        store.merge()
    requests = table(spark, d, "change_feed").select("feed_seq", "key")
    return KeyedLog.open(spark, root, conf).get_batch(requests).select("feed_seq", "found", *_h("value"))


def store_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a store holds after another log was loaded, the feed's sets came as one batch and its deletes as another, and it was opened anew."""
    root, conf = new_folder(spark, "store"), Storage(max_file_size=65_536)
    with KeyedLog.open(spark, root, conf) as store:
        store.load(_log(spark, d))
        store.set_batch(_feed(spark, d, True), order="seq")
        store.delete_batch(_feed(spark, d, False))
    return KeyedLog.open(spark, root, conf).snapshot().select(*_h("key", "value"))


def served_replies(spark: SparkSession, d: str) -> DataFrame:
    """The commands as a stream of files, run on a store batch by batch."""
    root = new_folder(spark, "served")
    _commands(spark, d, True).repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(f"{root}/in")
    with KeyedLog.open(spark, f"{root}/store") as store:
        stream = spark.readStream.schema(COMMANDS).parquet(f"{root}/in")
        commands.serve(stream, store, f"{root}/replies", f"{root}/checkpoint", availableNow=True).awaitTermination()
    replies = spark.read.schema(REPLIES).parquet(f"{root}/replies")
    return replies.select("seq", "kind", "int_val", F.col("bytes_val").cast("string").alias("text"))


def served_connections(spark: SparkSession, d: str) -> DataFrame:
    """The commands as bytes of connections, cut anywhere; the bytes that come back."""
    root = new_folder(spark, "served")
    sent = _pieces(spark, d).select(F.col("user").alias("connection"), "n", "bytes", F.lit(False).alias("ended"))
    sent.coalesce(1).write.parquet(f"{root}/in")
    with KeyedLog.open(spark, f"{root}/store") as store:
        stream = frames.chunk_files(spark, f"{root}/in")
        frames.serve_connections(stream, store, f"{root}/replies", f"{root}/checkpoint", availableNow=True).awaitTermination()
    replies = spark.read.schema("connection string, frame_no bigint, bytes binary").parquet(f"{root}/replies")
    return replies.select("connection", "frame_no", F.hex("bytes").alias("frame_hex"))


def read_at(spark: SparkSession, d: str) -> DataFrame:
    """The records at the places that an old index names."""
    return log.read_at(_log(spark, d), table(spark, d, "keydir")).select("fileid", "pos", "len", "tstamp", *_h("key", "value"))


def hint_files(spark: SparkSession, d: str) -> DataFrame:
    """The hints written as the bytes of hint files, and read from these."""
    root = new_folder(spark, "files")
    files.write_hint_files(table(spark, d, "hint_entries"), root)
    return files.read_hint_files(spark, root).select("fileid", "pos", "len", "tstamp", *_h("key"))


def folder_recovery(spark: SparkSession, d: str) -> DataFrame:
    """The log and the hints written as data and hint files, and the index recovered from the folder."""
    root = new_folder(spark, "files")
    files.write_files(_log(spark, d), root)
    files.write_hint_files(table(spark, d, "hint_entries"), root)
    return files.recover_folder(spark, root).select(*_h("key"), "fileid", "pos", "len", "tstamp")


def merge_gate(spark: SparkSession, d: str) -> DataFrame:
    """At which hours of the day a store with merge hours merges."""
    policy = Merge(policy=MERGE_HOURS, triggers=TRIGGERS)
    above = stats.merge_trigger(stats.segment_stats(_log(spark, d)), TRIGGERS).first()["merge"]
    hours = [(h, above and stats.allowed(policy, h)) for h in range(24)]
    return spark.createDataFrame(hours, "hour int, merges boolean")


def set_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The store after all sets of the feed were appended to its log, in their order."""
    old = _log(spark, d)
    first = log.next_fileid(old).first()["fileid"]
    new = log.as_records(_feed(spark, d, True), first, 65_536)
    return log.snapshot(log.records(old).select(*new.columns).unionByName(new)).select(*_h("key", "value"), "tstamp")


def del_apply(spark: SparkSession, d: str) -> DataFrame:
    """The store after tombstones of all deletes of the feed were appended to its log."""
    old = _log(spark, d)
    first = log.next_fileid(old).first()["fileid"]
    new = log.as_records(_feed(spark, d, False), first, 65_536)
    return log.snapshot(log.records(old).select(*new.columns).unionByName(new)).select(*_h("key", "value"), "tstamp")


def del_existed(spark: SparkSession, d: str) -> DataFrame:
    return log.deleted(_feed(spark, d, False), log.snapshot(_log(spark, d))).select(*_h("key"), "existed")


def del_count(spark: SparkSession, d: str) -> DataFrame:
    return log.del_count(_feed(spark, d, False), log.snapshot(_log(spark, d)))


def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.segment_stats(_log(spark, d)).drop("fragmentation")


def fragmentation(spark: SparkSession, d: str) -> DataFrame:
    return stats.segment_stats(_log(spark, d)).select("fileid", F.round("fragmentation", 9).alias("fragmentation"))


def merge_trigger(spark: SparkSession, d: str) -> DataFrame:
    return stats.merge_trigger(stats.segment_stats(_log(spark, d)), TRIGGERS)


def merge_window(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_merge_hour(table(spark, d, "change_feed"), "received_at", *MERGE_HOURS)


def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return stats.merge_candidates(stats.segment_stats(_log(spark, d)), THRESHOLDS).select("fileid")


def merge_rewrite_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a merge writes, read again from its new files, with where each record was before."""
    _, made = _merge(spark, d)
    rows = made.files.select(F.col("old_fileid").alias("fileid"), F.col("old_pos").alias("pos"), "len", "tstamp", "key", "value")
    return rows.select("fileid", "pos", "len", "tstamp", *_h("key", "value"), F.col("value").isNull().alias("tombstone"))


def _merge(spark: SparkSession, d: str):
    rows = _log(spark, d)
    first = log.next_fileid(rows).first()["fileid"]
    return compaction.merge(rows, THRESHOLDS, new_folder(spark, "merge"), first)


def _compacted(spark: SparkSession, d: str) -> DataFrame:
    chosen, made = _merge(spark, d)
    rest = compaction.unmerged(_log(spark, d), chosen).distinct().withColumn("merged", F.lit(False))
    return rest.unionByName(made.files.select(*LOG.names).withColumn("merged", F.lit(True)))


def merged_places(spark: SparkSession, d: str) -> DataFrame:
    """How the new files of a merge are laid out: of each record the number of its file, by key order, and its offset."""
    _, made = _merge(spark, d)
    rows = made.files.join(made.file_numbers(), "fileid")
    return rows.select("tombstone", "file_no", "pos", *_h("key"), "old_fileid", "old_pos")


def compacted_log(spark: SparkSession, d: str) -> DataFrame:
    return _compacted(spark, d).select("merged", "len", "tstamp", *_h("key", "value"))


def compacted_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """What the store holds after the merge: the same as before."""
    return log.snapshot(_compacted(spark, d)).select(*_h("key", "value"), "len", "tstamp")


def compacted_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of all files after the merge, added up."""
    total = lambda c: F.sum(c).alias(c)
    return stats.segment_stats(_compacted(spark, d)).agg(*map(total, ("live_keys", "dead_keys", "dead_bytes", "file_bytes")))


def hint_index(spark: SparkSession, d: str) -> DataFrame:
    return compaction.hints(_log(spark, d)).select("fileid", "pos", "len", "tstamp", *_h("key"))


def recovery_union(spark: SparkSession, d: str) -> DataFrame:
    rows = compaction.recovery_index(_log(spark, d), table(spark, d, "hint_entries"))
    return rows.select("fileid", "pos", "len", "tstamp", *_h("key"), "tombstone")


def recovered_index(spark: SparkSession, d: str) -> DataFrame:
    rows = compaction.recover(_log(spark, d), table(spark, d, "hint_entries"))
    return rows.select(*_h("key"), "fileid", "pos", "len", "tstamp")


def command_replay(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay(_commands(spark, d)).select("seq", "kind", "int_val", F.col("bytes_val").cast("string").alias("text"))


def del_multi_replay(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay(_commands(spark, d, True)).select("seq", "kind", "int_val", F.col("bytes_val").cast("string").alias("text"))


def _feed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the feed as commands of which many are bad: the names are the producers' own."""
    name = (
        F.when(F.col("op").isin("insert", "i", "INSERT"), "SET").when(F.col("op").isin("update", "UPDATE"), "GET")
        .when(F.col("op").isin("delete", "d"), "DEL").otherwise(F.coalesce("op", F.lit("")))
    )
    arguments = F.filter(F.array("key", "value"), lambda x: x.isNotNull())
    given = F.concat(F.array(F.encode(name, "UTF-8")), arguments)
    return table(spark, d, "change_feed").select("feed_seq", given.alias("parts"))


def command_validate(spark: SparkSession, d: str) -> DataFrame:
    rows = _feed_parts(spark, d)
    return rows.select("feed_seq", F.coalesce(resp.command_error(F.col("parts")), F.lit("OK")).alias("outcome"))


def key_utf8_check(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("key").distinct().select(*_h("key"), scalars.is_utf8("key").alias("valid"))


def resp_encode_commands(spark: SparkSession, d: str) -> DataFrame:
    commands = _commands(spark, d, True)
    return commands.select("seq", F.hex(resp.encode_command(_parts(commands))).alias("frame_hex"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    replies = replay.replay(_commands(spark, d))
    frame = resp.encode_reply(F.col("kind"), F.col("int_val"), F.col("bytes_val"))
    return replies.withColumn("frame", frame)


def resp_encode_replies(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("seq", F.hex("frame").alias("frame_hex"))


def resp_decode(spark: SparkSession, d: str) -> DataFrame:
    """The replies encoded and decoded again."""
    frames = resp.decode_frames(_replies(spark, d), "seq", "frame")
    return frames.select(F.col("frame_id").alias("seq"), "kind", "int_val", F.col("bytes_val").cast("string").alias("text"))


def resp_decode_commands(spark: SparkSession, d: str) -> DataFrame:
    """The commands encoded and decoded again, one row for each argument."""
    commands = _commands(spark, d, True)
    encoded = commands.select("seq", resp.encode_command(_parts(commands)).alias("frame"))
    frames = resp.decode_frames(encoded, "seq", "frame").where("kind = 'bulk'")
    return frames.select(F.col("frame_id").alias("seq"), F.get("path", F.lit(0)).alias("place"), F.col("bytes_val").cast("string").alias("text"))


def _cut_commands(spark: SparkSession, d: str) -> DataFrame:
    """``user, seq, frame, size, cut``: a connection for each user, whose commands are sent in pieces that end anywhere within a frame."""
    commands = _commands(spark, d, True).withColumn("user", F.regexp_extract(F.get("keys", F.lit(0)).cast("string"), "^(user:[0-9]+)", 1))
    sent = commands.select("user", "seq", resp.encode_command(_parts(commands)).alias("frame")).withColumn("size", F.octet_length("frame"))
    return sent.withColumn("cut", F.pmod(F.col("seq") * 7, F.col("size") + 1).cast("int"))


def resp_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first bytes of each command are a whole frame."""
    cut = _cut_commands(spark, d).select("seq", F.expr("substring(frame, 1, cut)").alias("bytes"))
    return resp.check_frames(cut, "seq").select(F.col("frame_id").alias("seq"), "status")


def resp_faults(spark: SparkSession, d: str) -> DataFrame:
    """Messages that can't be right, each in one of six ways, and what is said of them."""
    n = F.col("event_id").cast("string")
    messages = [
        F.encode(F.concat(F.lit(":"), n, F.lit("x\r\n")), "UTF-8"), F.encode(F.concat(F.lit("~"), n, F.lit("\r\n")), "UTF-8"),
        F.encode(F.concat(F.lit(":"), n, F.lit("0" * 19 + "\r\n")), "UTF-8"), F.encode(F.concat(F.lit("$-3\r\n"), n), "UTF-8"),
        F.concat(F.lit(bytearray(b"*1\r\n+")), F.encode(n, "UTF-8"), F.lit(bytearray(b"\xfe\r\n"))), F.encode(F.concat(F.lit("*-"), n, F.lit("\r\n")), "UTF-8"),
    ]
    rows = table(spark, d, "events").where("event_id > 0").select("event_id", F.element_at(F.array(*messages), (F.pmod("event_id", F.lit(6)) + 1).cast("int")).alias("bytes"))
    said = F.when(F.col("kind") == "NotInteger", F.col("bytes_val").cast("string"))
    return resp.decode_frames(rows, "event_id").select(F.col("frame_id").alias("seq"), "kind", said.alias("text"))


def connection_frames(spark: SparkSession, d: str) -> DataFrame:
    """What connections send, put together again from pieces that are cut within commands; the end of the last one is lost."""
    return resp.read_frames(_pieces(spark, d), "user", "n").select("connection", "frame_no", "status", *_h("frame"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """``user, n, bytes``: each command in two pieces; of the last one of a user only the first is sent."""
    sent = _cut_commands(spark, d)
    last = sent.groupBy("user").agg(F.max("seq").alias("last"))
    first, rest = F.expr("substring(frame, 1, cut)"), F.expr("substring(frame, cut + 1)")
    begins = sent.select("user", (F.col("seq") * 2).alias("n"), first.alias("bytes"))
    ends = sent.join(last, "user").where("seq < last").select("user", (F.col("seq") * 2 + 1).alias("n"), rest.alias("bytes"))
    return begins.unionByName(ends)


def reply_checks(spark: SparkSession, d: str) -> DataFrame:
    """Replies of which three in four were changed on their way, and what a client says of them."""
    ops = _commands(spark, d).select("seq", "op")
    way = F.pmod("seq", F.lit(4))
    kind = F.when(way == 1, "error").when(way == 3, "simple").when(way != 2, F.col("kind"))
    value = F.when(way == 1, F.encode(F.concat(F.lit("no "), F.col("op")), "UTF-8")).when(way == 3, F.lit(bytearray(b"OK"))).otherwise(F.col("bytes_val"))
    said = replay.replay(_commands(spark, d)).join(ops, "seq").select("seq", "op", kind.alias("kind"), value.alias("bytes_val"))
    return said.select("seq", F.coalesce(resp.reply_error(F.col("op"), F.col("kind"), F.col("bytes_val")), F.lit("OK")).alias("outcome"))


def wire_replay(spark: SparkSession, d: str) -> DataFrame:
    """Messages in, messages out: commands are decoded, checked, run, and their replies encoded."""
    commands = _commands(spark, d)
    messages = commands.select("seq", resp.encode_command(_parts(commands)).alias("bytes"))
    replies = replay.replay(resp.parse_commands(messages).where("error IS NULL").drop("error"))
    frame = resp.encode_reply(F.col("kind"), F.col("int_val"), F.col("bytes_val"))
    return replies.select("seq", F.hex(frame).alias("frame_hex"))


def cli_render(spark: SparkSession, d: str) -> DataFrame:
    shown = resp.render(F.col("kind"), F.col("int_val"), F.col("bytes_val"))
    return replay.replay(_commands(spark, d)).select("seq", shown.alias("shown"))


def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return scalars.backoff_schedule(spark, Net().min_backoff_ms, Net().max_backoff_ms)


def jitter_bounds(spark: SparkSession, d: str) -> DataFrame:
    low, high = scalars.jitter_bounds(F.col("interval"), F.lit(Merge().check_jitter))
    rows = spark.range(1).select(F.lit(Merge().check_interval_ms).alias("interval"))
    return rows.select(low.cast("double").alias("low"), high.cast("double").alias("high"))


QUERIES = {
    f.__name__: f
    for f in (
        log_scan, log_file_bytes, log_positions, record_size, file_ids, next_fileid, file_rotation, snapshot_latest, replaced_records, get_batch, store_get, store_changes, served_replies, served_connections, read_at, hint_files, folder_recovery,
        merge_gate, set_upsert,
        del_apply, del_existed, del_count, segment_stats, fragmentation, merge_trigger, merge_window, merge_candidates,
        merge_rewrite_rows, merged_places, compacted_log, compacted_snapshot, compacted_stats, hint_index, recovery_union, recovered_index,
        command_replay, del_multi_replay, command_validate, key_utf8_check, resp_encode_commands, resp_encode_replies,
        resp_decode, resp_decode_commands, resp_check, resp_faults, connection_frames, reply_checks, wire_replay, cli_render, backoff_schedule, jitter_bounds,
    )
}

_LOG = """
WITH one AS (SELECT DISTINCT fileid, pos, len, tstamp, key, value FROM log_entries),
newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fileid DESC, pos DESC) AS n FROM one) WHERE n = 1
), snap AS (SELECT * FROM newest WHERE value IS NOT NULL)"""
_STATS = (
    _LOG
    + """, later AS (
  SELECT *, value IS NOT NULL AND lead(fileid) OVER (PARTITION BY key ORDER BY fileid, pos) IS NULL AS live FROM one
), stats AS (
  SELECT fileid, count(*) FILTER (WHERE live) AS live_keys, count(*) FILTER (WHERE NOT live) AS dead_keys,
    CAST(coalesce(sum(len) FILTER (WHERE NOT live), 0) AS BIGINT) AS dead_bytes, CAST(sum(len) AS BIGINT) AS file_bytes
  FROM later GROUP BY fileid
), parts AS (
  SELECT *, CASE WHEN dead_keys = 0 THEN 0.0 ELSE CAST(dead_keys AS DOUBLE) / (dead_keys + live_keys) END AS fragmentation FROM stats
), chosen AS (SELECT fileid FROM parts WHERE dead_bytes > 40000 OR fragmentation > 0.9 OR file_bytes < 4096)"""
)
_MERGE = (
    _STATS
    + """, kept AS (
  SELECT n.*, n.value IS NULL AS tombstone FROM newest n
  WHERE n.fileid IN (SELECT fileid FROM chosen) AND (n.value IS NOT NULL OR n.key IN (
    SELECT o.key FROM one o WHERE o.value IS NOT NULL AND o.fileid NOT IN (SELECT fileid FROM chosen)))
), after AS (
  SELECT false AS merged, fileid, pos, len, tstamp, key, value FROM one WHERE fileid NOT IN (SELECT fileid FROM chosen)
  UNION ALL SELECT true, fileid, pos, len, tstamp, key, value FROM kept
)"""
)
_AFTER = """
WITH seen AS (
  SELECT key, value, tstamp, 0 AS part, fileid AS a, pos AS b FROM log_entries
  UNION ALL SELECT key, value, tstamp, 1, feed_seq, 0 FROM change_feed WHERE key IS NOT NULL AND value IS {}NULL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY part DESC, a DESC, b DESC) AS n FROM seen)
SELECT hex(key) AS key_hex, hex(value) AS value_hex, tstamp FROM ranked WHERE n = 1 AND value IS NOT NULL
"""
_DELETED = (
    _LOG
    + """, asked AS (SELECT DISTINCT key FROM change_feed WHERE key IS NOT NULL AND value IS NULL),
existed AS (SELECT a.key, s.key IS NOT NULL AS existed FROM asked a LEFT JOIN snap s ON s.key = a.key)"""
)
_OPS = """
WITH commands AS (
  SELECT event_id AS seq, 'user:' || user_id AS user, event_type AS kind, CAST(event_id AS VARCHAR) AS value,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'SET' WHEN event_type = 'error' THEN 'DEL' ELSE 'GET' END AS op
  FROM events
)"""
_REPLIES = (
    _OPS
    + """, touched AS (
  SELECT seq, 0 AS idx, op, user AS key, value FROM commands
), prev AS (
  SELECT *, last_value(CASE WHEN op = 'SET' THEN value WHEN op = 'DEL' THEN '' END IGNORE NULLS) OVER (
    PARTITION BY key ORDER BY seq, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM touched
), replies AS (
  SELECT seq, CASE WHEN op = 'SET' THEN 'simple' WHEN before <> '' THEN 'bulk' ELSE 'null' END AS kind,
    CAST(NULL AS BIGINT) AS int_val, CASE WHEN op = 'SET' THEN 'OK' WHEN before <> '' THEN before END AS text
  FROM prev WHERE op <> 'DEL'
  UNION ALL
  SELECT seq, 'integer', count(*) FILTER (WHERE before <> ''), NULL FROM prev WHERE op = 'DEL' GROUP BY seq
)"""
)
_MULTI = _REPLIES.replace(
    "SELECT seq, 0 AS idx, op, user AS key, value FROM commands",
    """SELECT seq, 0 AS idx, op, user || CASE WHEN kind = 'signup' THEN ':signup' ELSE ':purchase' END AS key, value
  FROM commands WHERE op <> 'DEL'
  UNION ALL SELECT seq, i, op, user || k, value FROM commands,
    (VALUES (0, ':purchase'), (1, ':signup'), (2, ':purchase')) AS v(i, k) WHERE op = 'DEL'""",
)
_ARGS = (
    _OPS
    + """, args AS (
  SELECT seq, 0 AS place, op AS text FROM commands
  UNION ALL SELECT seq, 1, user || CASE WHEN kind = 'signup' THEN ':signup' ELSE ':purchase' END FROM commands
  UNION ALL SELECT seq, 2, user || ':signup' FROM commands WHERE op = 'DEL'
  UNION ALL SELECT seq, 3, user || ':purchase' FROM commands WHERE op = 'DEL'
  UNION ALL SELECT seq, 2, value FROM commands WHERE op = 'SET'
)"""
)
_FRAMES = (
    _ARGS
    + """, texts AS (
  SELECT a.seq, any_value(c.user) AS user, '*' || count(*) || chr(13) || chr(10) || string_agg('$' || octet_length(encode(a.text)) || chr(13) || chr(10)
    || a.text || chr(13) || chr(10), '' ORDER BY a.place) AS text
  FROM args a JOIN commands c ON c.seq = a.seq GROUP BY a.seq
), frames AS (SELECT *, octet_length(encode(text)) AS size FROM texts)"""
)
_RECOVERY = """
WITH data AS (SELECT DISTINCT fileid, pos, len, tstamp, key, value IS NULL AS tombstone FROM log_entries),
own AS (SELECT DISTINCT fileid, pos, len, tstamp, key, false AS tombstone FROM hint_entries WHERE fileid IN (SELECT fileid FROM data)),
both_ AS (SELECT * FROM own UNION ALL SELECT * FROM data WHERE fileid NOT IN (SELECT fileid FROM own))"""

ORACLE = {
    "log_scan": _LOG + " SELECT fileid, pos, len, tstamp, hex(key) AS key_hex, hex(value) AS value_hex FROM one",
    "log_file_bytes": _LOG + " SELECT fileid, pos, len, tstamp, hex(key) AS key_hex, hex(value) AS value_hex FROM one",
    "log_positions": _LOG
    + """ SELECT fileid, pos, CAST(coalesce(sum(len) OVER (PARTITION BY fileid ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_pos FROM one""",
    "record_size": """SELECT fileid, pos, CAST(coalesce(25 + octet_length(key) + octet_length(value), 17 + octet_length(key)) AS BIGINT) AS size,
  CAST(32 + octet_length(key) AS BIGINT) AS hint_size FROM log_entries""",
    "file_ids": "SELECT fileid FROM segment_stats WHERE fileid IS NOT NULL",
    "next_fileid": "SELECT CAST(coalesce(max(fileid) + 1, 0) AS BIGINT) AS fileid FROM log_entries",
    "file_rotation": """
WITH RECURSIVE one AS (
  SELECT *, row_number() OVER (PARTITION BY fileid ORDER BY pos) AS n FROM (SELECT DISTINCT fileid, pos, len FROM log_entries)
), fold AS (
  SELECT fileid, pos, len, n, CAST(0 AS BIGINT) AS segment, CAST(0 AS BIGINT) AS segment_pos FROM one WHERE n = 1
  UNION ALL
  SELECT o.fileid, o.pos, o.len, o.n, f.segment + CASE WHEN f.segment_pos + f.len > 4096 THEN 1 ELSE 0 END,
    CASE WHEN f.segment_pos + f.len > 4096 THEN 0 ELSE f.segment_pos + f.len END
  FROM fold f JOIN one o ON o.fileid = f.fileid AND o.n = f.n + 1
)
SELECT fileid, pos, segment, segment_pos FROM fold""",
    "snapshot_latest": _LOG + " SELECT hex(key) AS key_hex, hex(value) AS value_hex, fileid, pos, len, tstamp FROM snap",
    "replaced_records": _LOG
    + """, old AS (
  SELECT *, lag(value IS NOT NULL) OVER w AS live, lag(fileid) OVER w AS f, lag(pos) OVER w AS p
  FROM one WINDOW w AS (PARTITION BY key ORDER BY fileid, pos)
) SELECT fileid, pos, CASE WHEN live THEN f END AS old_fileid, CASE WHEN live THEN p END AS old_pos FROM old""",
    "get_batch": _LOG
    + """ SELECT f.feed_seq, s.key IS NOT NULL AS found, hex(s.value) AS value_hex
  FROM change_feed f LEFT JOIN snap s ON s.key = f.key""",
    "set_upsert": _AFTER.format("NOT "),
    "del_apply": _AFTER.format(""),
    "del_existed": _DELETED + " SELECT hex(key) AS key_hex, existed FROM existed",
    "del_count": _DELETED + " SELECT count(*) FILTER (WHERE existed) AS deleted FROM existed",
    "segment_stats": _STATS + " SELECT fileid, live_keys, dead_keys, dead_bytes, file_bytes FROM stats",
    "fragmentation": _STATS + " SELECT fileid, round(fragmentation, 9) AS fragmentation FROM parts",
    "merge_trigger": _STATS + " SELECT bool_or(dead_bytes > 48000 OR fragmentation > 0.6) AS merge FROM parts",
    "merge_window": """SELECT coalesce(hour(received_at) BETWEEN 2 AND 9, false) AS open, count(*) AS n FROM change_feed GROUP BY 1""",
    "merge_candidates": _STATS + " SELECT fileid FROM chosen",
    "merge_rewrite_rows": _MERGE
    + " SELECT fileid, pos, len, tstamp, hex(key) AS key_hex, hex(value) AS value_hex, tombstone FROM kept",
    "merged_places": _MERGE.replace("WITH one", "WITH RECURSIVE one")
    + """, placed AS (
  SELECT *, row_number() OVER (PARTITION BY tombstone ORDER BY key, fileid, pos) AS nth FROM kept
), fold AS (
  SELECT tombstone, nth, len, key, fileid, pos, CAST(0 AS BIGINT) AS file_no, CAST(0 AS BIGINT) AS place FROM placed WHERE nth = 1
  UNION ALL
  SELECT p.tombstone, p.nth, p.len, p.key, p.fileid, p.pos, f.file_no + CASE WHEN f.place + f.len > 65536 THEN 1 ELSE 0 END,
    CASE WHEN f.place + f.len > 65536 THEN 0 ELSE f.place + f.len END
  FROM fold f JOIN placed p ON p.tombstone = f.tombstone AND p.nth = f.nth + 1
)
SELECT tombstone, file_no, place AS pos, hex(key) AS key_hex, fileid AS old_fileid, pos AS old_pos FROM fold""",
    "compacted_log": _MERGE + " SELECT merged, len, tstamp, hex(key) AS key_hex, hex(value) AS value_hex FROM after",
    "compacted_snapshot": _LOG + " SELECT hex(key) AS key_hex, hex(value) AS value_hex, len, tstamp FROM snap",
    "compacted_stats": _MERGE
    + """, live AS (SELECT count(*) AS k, sum(len) AS b FROM snap)
SELECT (SELECT k FROM live) AS live_keys, count(*) - (SELECT k FROM live) AS dead_keys,
  CAST(sum(len) - (SELECT b FROM live) AS BIGINT) AS dead_bytes, CAST(sum(len) AS BIGINT) AS file_bytes FROM after""",
    "hint_index": _LOG + " SELECT fileid, pos, len, tstamp, hex(key) AS key_hex FROM snap",
    "recovery_union": _RECOVERY + " SELECT fileid, pos, len, tstamp, hex(key) AS key_hex, tombstone FROM both_",
    "recovered_index": _RECOVERY
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fileid DESC, pos DESC, len DESC, tstamp DESC) AS n FROM both_)
SELECT hex(key) AS key_hex, fileid, pos, len, tstamp FROM ranked WHERE n = 1 AND NOT tombstone""",
    "command_replay": _REPLIES + " SELECT seq, kind, int_val, text FROM replies",
    "del_multi_replay": _MULTI + " SELECT seq, kind, int_val, text FROM replies",
    "key_utf8_check": "SELECT hex(key) AS key_hex, try(decode(key)) IS NOT NULL AS valid FROM log_entries GROUP BY key",
    "command_validate": """
WITH named AS (
  SELECT feed_seq, CASE WHEN op IN ('insert', 'i', 'INSERT') THEN 'SET' WHEN op IN ('update', 'UPDATE') THEN 'GET'
    WHEN op IN ('delete', 'd') THEN 'DEL' ELSE coalesce(op, '') END AS name,
    (key IS NOT NULL)::INT + (value IS NOT NULL)::INT AS n,
    coalesce(key, value) AS first, CASE WHEN key IS NOT NULL THEN value END AS second
  FROM change_feed
), checked AS (
  SELECT *, first IS NOT NULL AND try(decode(first)) IS NULL AS bad1, second IS NOT NULL AND try(decode(second)) IS NULL AS bad2 FROM named
)
SELECT feed_seq, CASE name
  WHEN 'DEL' THEN CASE WHEN n = 0 THEN 'BadArguments: Keys are empty' WHEN bad1 OR bad2 THEN 'NotUtf8' ELSE 'OK' END
  WHEN 'GET' THEN CASE WHEN n = 0 THEN 'BadArguments: Key is not given' WHEN bad1 THEN 'NotUtf8'
    WHEN n > 1 THEN 'BadArguments: Frame contains extra data' ELSE 'OK' END
  WHEN 'SET' THEN CASE WHEN n = 0 THEN 'BadArguments: Key is not given' WHEN bad1 THEN 'NotUtf8'
    WHEN n = 1 THEN 'BadArguments: Value is not given' ELSE 'OK' END
  ELSE 'BadCommand: ' || name END AS outcome
FROM checked""",
    "resp_encode_commands": _ARGS
    + """ SELECT seq, hex(encode('*' || count(*) || chr(13) || chr(10) || string_agg('$' || octet_length(encode(text)) || chr(13) || chr(10)
  || text || chr(13) || chr(10), '' ORDER BY place))) AS frame_hex FROM args GROUP BY seq""",
    "resp_encode_replies": _REPLIES
    + """ SELECT seq, hex(encode(CASE kind WHEN 'simple' THEN '+' || text WHEN 'integer' THEN ':' || int_val WHEN 'null' THEN '$-1'
  ELSE '$' || octet_length(encode(text)) || chr(13) || chr(10) || text END || chr(13) || chr(10))) AS frame_hex FROM replies""",
    "resp_decode": _REPLIES + " SELECT seq, kind, int_val, text FROM replies",
    "resp_decode_commands": _ARGS + " SELECT seq, place, text FROM args",
    "resp_check": _FRAMES + " SELECT seq, CASE WHEN seq * 7 % (size + 1) = size THEN 'OK' ELSE 'Incomplete' END AS status FROM frames",
    "resp_faults": """SELECT event_id AS seq,
  CASE event_id % 6 WHEN 0 THEN 'NotInteger' WHEN 2 THEN 'NotInteger' WHEN 4 THEN 'NotUtf8' ELSE 'BadEncoding' END AS kind,
  CASE event_id % 6 WHEN 0 THEN event_id || 'x' WHEN 2 THEN event_id || repeat('0', 19) END AS text
FROM events WHERE event_id > 0""",
    "connection_frames": _FRAMES
    + """, placed AS (
  SELECT *, row_number() OVER w - 1 AS no, seq * 7 % (size + 1) AS cut, lead(seq) OVER w IS NULL AS last
  FROM frames WINDOW w AS (PARTITION BY user ORDER BY seq)
), whole AS (SELECT * FROM placed WHERE NOT last OR cut = size), ends AS (SELECT * FROM placed WHERE last)
SELECT user AS connection, no AS frame_no, 'frame' AS status, hex(encode(text)) AS frame_hex FROM whole
UNION ALL SELECT user, no + CASE WHEN cut = size THEN 1 ELSE 0 END, CASE WHEN cut IN (0, size) THEN 'end' ELSE 'ConnectionReset' END,
  CASE WHEN cut = size THEN '' ELSE hex(encode(left(text, CAST(cut AS INT)))) END FROM ends""",
    "reply_checks": _REPLIES
    + """ SELECT r.seq, CASE r.seq % 4 WHEN 1 THEN 'Storage: no ' || c.op WHEN 2 THEN 'ConnectionReset'
  WHEN 3 THEN CASE WHEN c.op = 'SET' THEN 'OK' ELSE 'BadFrame' END ELSE 'OK' END AS outcome
  FROM replies r JOIN commands c ON c.seq = r.seq""",
    "cli_render": _REPLIES
    + """ SELECT seq, CASE kind WHEN 'null' THEN '(nil)' WHEN 'integer' THEN '(integer) ' || int_val ELSE '"' || text || '"' END AS shown
  FROM replies""",
    "backoff_schedule": """SELECT CAST(i + 1 AS BIGINT) AS attempt, CAST(500 * pow(2, i) AS BIGINT) AS wait_ms
  FROM range(0, 8) AS r(i) WHERE 500 * pow(2, i) <= 64000""",
    "jitter_bounds": "SELECT CAST(18000 - 18000 * 0.3 AS DOUBLE) AS low, CAST(18000 + 18000 * 0.3 AS DOUBLE) AS high",
}
ORACLE["store_changes"] = _DELETED + """, sets AS (
  SELECT key, arg_max(value, feed_seq) AS value FROM change_feed WHERE key IS NOT NULL AND value IS NOT NULL GROUP BY key
), held AS (SELECT key, value FROM sets UNION ALL SELECT key, value FROM snap WHERE key NOT IN (SELECT key FROM sets))
SELECT hex(key) AS key_hex, hex(value) AS value_hex FROM held WHERE key NOT IN (SELECT key FROM asked)"""
ORACLE["served_replies"] = ORACLE["del_multi_replay"]
ORACLE["served_connections"] = (
    _MULTI
    + """, args AS (
  SELECT seq, 0 AS place, op AS text FROM commands
  UNION ALL SELECT seq, 1, user || CASE WHEN kind = 'signup' THEN ':signup' ELSE ':purchase' END FROM commands
  UNION ALL SELECT seq, 2, user || ':signup' FROM commands WHERE op = 'DEL'
  UNION ALL SELECT seq, 3, user || ':purchase' FROM commands WHERE op = 'DEL'
  UNION ALL SELECT seq, 2, value FROM commands WHERE op = 'SET'
), sizes AS (
  SELECT seq, 3 + length(CAST(count(*) AS VARCHAR)) + sum(5 + length(text) + length(CAST(length(text) AS VARCHAR))) AS size FROM args GROUP BY seq
), placed AS (
  SELECT c.user, c.seq, row_number() OVER w - 1 AS frame_no, lead(c.seq) OVER w IS NULL AND c.seq * 7 % (z.size + 1) <> z.size AS lost
  FROM commands c JOIN sizes z ON z.seq = c.seq WINDOW w AS (PARTITION BY c.user ORDER BY c.seq)
)
SELECT p.user AS connection, p.frame_no, hex(encode(CASE r.kind WHEN 'simple' THEN '+' || r.text WHEN 'integer' THEN ':' || r.int_val WHEN 'null' THEN '$-1'
  ELSE '$' || octet_length(encode(r.text)) || chr(13) || chr(10) || r.text END || chr(13) || chr(10))) AS frame_hex
FROM placed p JOIN replies r ON r.seq = p.seq WHERE NOT p.lost"""
)
ORACLE["read_at"] = _LOG + """ SELECT o.fileid, o.pos, o.len, o.tstamp, hex(o.key) AS key_hex, hex(o.value) AS value_hex
FROM one o WHERE EXISTS (SELECT 1 FROM keydir k WHERE k.fileid = o.fileid AND k.pos = o.pos)"""
ORACLE["hint_files"] = "SELECT DISTINCT fileid, pos, len, tstamp, hex(key) AS key_hex FROM hint_entries"
ORACLE["folder_recovery"] = ORACLE["recovered_index"]
ORACLE["merge_gate"] = _STATS + """ SELECT CAST(h AS INT) AS hour, h BETWEEN 2 AND 9
  AND (SELECT bool_or(dead_bytes > 48000 OR fragmentation > 0.6) FROM parts) AS merges FROM range(24) AS r(h)"""
ORACLE["store_get"] = ORACLE["get_batch"]
ORACLE["wire_replay"] = ORACLE["resp_encode_replies"]
