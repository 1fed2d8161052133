"""A keyed log on shared storage: set, get, delete, merge, in batches or one by one."""

from __future__ import annotations

import datetime
import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.config import Storage
from logloom.functions.scalars import now_nanos
from logloom.manifests import ConflictError, Manifests
from logloom.operators import compaction, consolidate, log, replay, stats
from logloom.schema import HINT, LOG
from logloom.session import ship_package

__all__ = ["ClosedError", "ConflictError", "KeyedLog", "NULL_VALUE"]

events = logging.getLogger(__name__)
NULL_VALUE = "a value must not be NULL"
#: Files whose ids agree but for so many bits lie in one folder of a segment: as many ids as a writer may use.
WRITER_BITS = 20
SEGMENT = T.StructType([*LOG.fields, T.StructField("segment", T.StringType()), T.StructField("writer", T.LongType())])
INDEX = T.StructType([*HINT.fields, T.StructField("tombstone", T.BooleanType())])


class ClosedError(RuntimeError):
    """The store has been closed."""


class KeyedLog:
    """A store below ``root``: folders of Parquet segments, and manifests that name those that count.

    A change writes new segments and then the next manifest, whose number must not be taken. So
    a change counts as a whole or not at all, a failed one leaves only files that no manifest
    names, and of two writers the later one fails. A reader keeps the manifest that it began
    with, also while files are merged. Old segments are deleted by ``vacuum`` only.

    Opening recovers an index, where the newest record of each live key lies: from the hints of merged files, from the
    records of others, without values. It is stored sorted by key and named by the manifest with the segments that it covers, so
    the next opening reads only what came since. Lookups find the places of keys in the index and in newer segments, and then read
    only the folders of the segments that hold them.
    """

    def __init__(self, spark: SparkSession, root: str, conf: Storage | None = None):
        ship_package(spark)
        self.spark, self.root, self.conf = spark, root.rstrip("/"), conf or Storage(path=root)
        self._manifests = Manifests(spark, f"{self.root}/manifests", sync=self.conf.sync == "always")
        self._path, self._fs = self._manifests._path, self._manifests.fs
        self._closed = False
        if not self._manifests.times():
            self._manifests.commit({"segments": [], "hints": [], "next": 0, "batch": -1, "index": None}, 0)
        self.recover()

    @classmethod
    def open(cls, spark: SparkSession, root: str, conf: Storage | None = None) -> KeyedLog:
        return cls(spark, root, conf)

    def close(self) -> None:
        """Every later operation raises ``ClosedError``; closing twice does nothing."""
        self._closed = True

    def __enter__(self) -> KeyedLog:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _check(self) -> None:
        if self._closed:
            raise ClosedError("the store has been closed")

    def manifest(self) -> dict:
        self._check()
        version, body = self._manifests.newest()
        return body | {"version": version}

    def _commit(self, manifest: dict, version: int) -> None:
        """Makes a manifest the one after ``version``. What it names must be there, whatever a ``vacuum`` did meanwhile."""
        index = [manifest["index"]["name"]] if manifest.get("index") else []
        for kind, names in (("segments", manifest["segments"]), ("hints", manifest["hints"]), ("index", index)):
            for name in names:
                if not self._fs.exists(self._at(kind, name)):
                    raise FileNotFoundError(f"{kind}/{name} of {self.root} is gone; the change doesn't count")
        self._manifests.commit({k: v for k, v in manifest.items() if k != "version"}, version)
        events.info("committed", extra={"root": self.root, "manifest": version + 1, "segments": len(manifest["segments"])})

    def _at(self, kind: str, name: str):
        return self._path(f"{self.root}/{kind}/{'segment=' if kind == 'segments' else ''}{name}")

    def _segments(self, names: list[str]) -> DataFrame:
        """The records of some segments, with the folders that they lie in, ``segment`` and ``writer``."""
        if not names:
            return self.spark.createDataFrame([], SEGMENT)
        reader = self.spark.read.schema(SEGMENT).option("basePath", f"{self.root}/segments")
        return reader.parquet(*[f"{self.root}/segments/segment={n}" for n in names])

    def _write_segment(self, records: DataFrame, name: str) -> None:
        writer = F.shiftright("fileid", WRITER_BITS)
        records.select(*LOG.names).withColumn("writer", writer).write.partitionBy("writer").parquet(f"{self.root}/segments/segment={name}")

    def log(self, manifest: dict | None = None) -> DataFrame:
        """The whole log, ``fileid, pos, len, tstamp, key, value``."""
        return self._segments((manifest or self.manifest())["segments"]).select(*LOG.names)

    def hints(self, manifest: dict | None = None) -> DataFrame:
        """The hints of the merged files."""
        m = manifest or self.manifest()
        if not m["hints"]:
            return self.spark.createDataFrame([], HINT)
        return self.spark.read.schema(HINT).parquet(*[f"{self.root}/hints/{s}" for s in m["hints"]])

    def snapshot(self) -> DataFrame:
        """``key, value, fileid, pos, len, tstamp`` of each live key."""
        return log.snapshot(self.log())

    def _index(self, m: dict) -> DataFrame:
        """Where the newest records lie, in the stored index and in the segments since: some rows for each key, of which the newest counts."""
        index = m.get("index") or {"name": None, "segments": []}
        since = log.narrow(self._segments([s for s in m["segments"] if s not in index["segments"]])).select(*INDEX.names)
        if index["name"] is None:
            return since
        return self.spark.read.schema(INDEX).parquet(f"{self.root}/index/{index['name']}").unionByName(since)

    def recover(self) -> None:
        """Brings the stored index up to the newest manifest. Does nothing if it is."""
        m = self.manifest()
        index = m.get("index")
        if set((index or {"segments": []})["segments"]) == set(m["segments"]):
            return
        if index:
            found = compaction.newest_of_index(self._index(m)).where("NOT tombstone")
        else:
            found = compaction.recover(self.log(m), self.hints(m)).withColumn("tombstone", F.lit(False))
        name = uuid.uuid4().hex
        # Sorted by key over all files, so that a lookup's filter skips most of them by their statistics.
        found.select(*INDEX.names).repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.root}/index/{name}")
        try:
            self._commit(m | {"index": {"name": name, "segments": m["segments"]}}, m["version"])
        except ConflictError:
            events.info("another writer was faster; the index stays as it was", extra={"root": self.root})

    def _append(self, batch: DataFrame, number: int | None = None, order: str = "seq") -> None:
        m = self.manifest()
        name = uuid.uuid4().hex
        self._write_segment(log.as_records(batch, m["next"], self.conf.max_file_size, order), name)
        last = self._segments([name]).agg(F.max("fileid")).first()[0]
        if last is None:
            self._fs.delete(self._at("segments", name), True)
            if number is None:
                return
            new = m
        else:
            new = m | {"segments": [*m["segments"], name], "next": last + 1}
        self._commit(new | ({"batch": number} if number is not None else {}), m["version"])

    def load(self, records: DataFrame) -> None:
        """Appends the records of another log, by its order, under new file ids."""
        self._check()
        at = F.struct("fileid", "pos").alias("at")
        self._append(log.scan(records).select(at, "tstamp", "key", "value"), order="at")

    def set_batch(self, rows: DataFrame, order: str | None = None) -> None:
        """Sets ``key`` to ``value`` for each row. Of rows with one key the last by ``order`` wins,
        without it the one with the largest value. A NULL value is an error, and nothing is set."""
        self._check()
        seq = F.col(order) if order else F.lit(0)
        value = F.when(F.col("value").isNull(), F.raise_error(F.lit(NULL_VALUE)).cast("binary")).otherwise(F.col("value"))
        last = F.max(F.struct(seq.alias("seq"), value.alias("value"))).alias("last")
        once = rows.where("key IS NOT NULL").groupBy("key").agg(last)
        try:
            self._append(once.select("last.seq", now_nanos().alias("tstamp"), "key", "last.value"))
        except Exception as e:
            if NULL_VALUE in str(e):
                raise ValueError(NULL_VALUE) from e
            raise

    def get_batch(self, requests: DataFrame) -> DataFrame:
        """The rows of ``requests``, with ``found`` and ``value`` of their ``key``."""
        m = self.manifest()
        return log.get_by_index(requests, self._index(m), self._segments(m["segments"]), WRITER_BITS)

    def _stored(self, df: DataFrame) -> tuple[DataFrame, str]:
        folder = f"{self.root}/work/{uuid.uuid4().hex}"
        return consolidate.stored(df, folder), folder

    def _forget(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def delete_batch(self, keys: DataFrame) -> int:
        """Appends a tombstone for each distinct ``key``, live or not; returns how many were live."""
        m = self.manifest()
        asked, folder = self._stored(keys.where("key IS NOT NULL").select("key").distinct())
        live = compaction.newest_of_index(self._index(m).join(asked, "key", "left_semi")).where("NOT tombstone")
        n = log.del_count(asked, live).first()["deleted"]
        gone = F.lit(None).cast("binary").alias("value")
        self._append(asked.select(F.lit(0).alias("seq"), now_nanos().alias("tstamp"), "key", gone))
        self._forget(folder)
        return n

    def _one(self, **row) -> DataFrame:
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} binary" for c in row))

    def set(self, key: bytes, value: bytes) -> None:
        self.set_batch(self._one(key=key, value=value))

    def get(self, key: bytes) -> bytes | None:
        """The value of one key: its place by the index, whose scan takes the filter on the key, then the record at that place,
        from the one folder that holds it."""
        m = self.manifest()
        at = compaction.newest_of_index(self._index(m).where(F.col("key") == F.lit(bytearray(key)))).first()
        if at is None or at["tombstone"]:
            return None
        here = (F.col("writer") == at["fileid"] >> WRITER_BITS) & (F.col("fileid") == at["fileid"]) & (F.col("pos") == at["pos"])
        return bytes(self._segments(m["segments"]).where(here).select("value").first()["value"])

    def delete(self, *keys: bytes) -> int:
        if not keys:
            raise ValueError("Keys are empty")
        self._check()
        return self.delete_batch(self.spark.createDataFrame([(k,) for k in keys], "key binary"))

    def apply(self, commands: DataFrame, replies_to: str, number: int | None = None) -> None:
        """Runs a batch of commands by ``seq``, writes the replies to a folder and appends the changes.

        A batch with a ``number`` that was applied already isn't applied again: its replies were
        written before its changes counted.
        """
        self._check()
        if number is not None and number <= self.manifest()["batch"]:
            return
        held = self.get_batch(commands.select(F.explode("keys").alias("key")).distinct()).where("found").select("key", "value")
        replay.replay(commands, held).write.mode("overwrite").parquet(replies_to)
        changes = replay.final_changes(commands)
        self._append(changes.select("seq", now_nanos().alias("tstamp"), "key", "value"), number)

    def stats(self) -> DataFrame:
        return stats.segment_stats(self.log())

    def maybe_merge(self, hour: int | None = None) -> bool:
        """Merges if the policy allows it at this hour and a file is above a trigger."""
        now = datetime.datetime.now().hour if hour is None else hour
        return stats.may_merge(self.stats(), self.conf.merge, now) and self.merge()

    def merge(self) -> bool:
        """Merges the files that the thresholds name; false if there are none.

        Segments with a chosen file are written anew, without it; what the merge keeps goes into
        new files, with hints. Nothing is deleted before the new manifest counts.
        """
        m = self.manifest()
        rows = self._segments(m["segments"])
        work = f"{self.root}/work/{uuid.uuid4().hex}"
        index = consolidate.stored(log.index_of(rows), f"{work}/index")
        chosen = consolidate.stored(compaction.chosen_by(index, self.conf.merge.thresholds), f"{work}/chosen")
        # One job finds the segments with a chosen file; the driver, which has the names of all in the manifest, gets theirs.
        ids = chosen.where("chosen").select("fileid")
        hit = {r["segment"] for r in rows.select("fileid", "segment").join(ids, "fileid", "left_semi").select("segment").distinct().collect()}
        if not hit:
            self._forget(work)
            return False
        touched, kept = [s for s in m["segments"] if s in hit], [s for s in m["segments"] if s not in hit]
        made = consolidate.consolidate(rows, chosen, f"{work}/new", m["next"], self.conf.max_file_size, index)
        names = [uuid.uuid4().hex for _ in range(3)]
        self._write_segment(compaction.unmerged(self._segments(touched), chosen), names[0])
        self._write_segment(made.files, names[1])
        own = made.files.where("value IS NOT NULL").select(*HINT.names)
        still = self.hints(m).join(ids, "fileid", "left_anti").select(*HINT.names)
        still.unionByName(own).write.parquet(f"{self.root}/hints/{names[2]}")
        last = made.ranges.agg(F.max("fileid")).first()[0]
        following = m["next"] if last is None else last + 1
        self._commit(m | {"segments": [*kept, *names[:2]], "hints": [names[2]], "next": following, "index": None}, m["version"])
        self._forget(work)
        self.recover()
        return True

    def vacuum(self, older_than: float = 24 * 3600.0) -> list[str]:
        """Deletes what has been out of use for so many seconds; returns its names.

        Kept is what the newest manifest names, what a manifest names that was the newest within that time, since readers
        may still use it, and what was written within that time, since its writer may not have committed it yet. A writer that
        needs longer finds its segment gone and fails before it commits.
        """
        self._check()
        since = (time.time() - older_than) * 1000
        times = self._manifests.times()
        ordered = sorted(times)
        used = {kind: set() for kind in ("segments", "hints", "index")}
        for number, following in zip(ordered, [*ordered[1:], None], strict=True):
            if following is None or times[following] > since:
                body = self._manifests.read(number)
                used["segments"] |= set(body["segments"])
                used["hints"] |= set(body["hints"])
                used["index"] |= {body["index"]["name"]} if body.get("index") else set()
        gone = []
        for kind, names in used.items():
            folder = self._path(f"{self.root}/{kind}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                name = s.getPath().getName().removeprefix("segment=")
                if name not in names and self._written(s.getPath()) <= since:
                    self._fs.delete(s.getPath(), True)
                    gone.append(name)
        events.info("vacuumed", extra={"root": self.root, "deleted": len(gone)})
        return gone

    def _written(self, path) -> int:
        """When something below a folder was last written, in milliseconds."""
        newest = self._fs.getFileStatus(path).getModificationTime()
        for s in self._fs.listStatus(path):
            newest = max(newest, self._written(s.getPath()) if s.isDirectory() else s.getModificationTime())
        return newest
