"""Recomputing only what changed since the last successful run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.manifests import Manifests

#: At most so many ranges of file ids have fingerprints of their own, or twice as many after some time.
PARTS = 16_384
#: So many neighbouring ranges are stored in one partition.
SHELF = 128
#: So many stored sets of read records are rewritten as one.
MOST_SETS = 16
#: A run with fewer rows than this part of the records read so far looks its own up there first, instead of shuffling both.
SMALL_SHARE = 8

PRINTS = "part bigint, n bigint, high bigint, mid bigint, low bigint"
SUMS = ("n", "high", "mid", "low")


def row_hash(columns: list[str]) -> Column:
    """A 64-bit hash of a row. NULL is a value like any other."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def hash_sums(h: Column) -> list[Column]:
    """``n, high, mid, low``: the count of rows and the sums of three pieces of their hashes.

    The sums don't depend on the order of rows, and those of two sets of rows add up. A piece has at most 22 bits, so
    they hold for 2^41 rows.
    """
    pieces = (F.shiftrightunsigned(h, 43), F.shiftrightunsigned(h, 21).bitwiseAND((1 << 22) - 1), h.bitwiseAND((1 << 21) - 1))
    return [F.count("*").alias("n"), *(F.sum(p).alias(name) for p, name in zip(pieces, SUMS[1:], strict=True))]


def fingerprints(rows: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """``part, n, high, mid, low`` of each partition: its row count and sums over its row hashes."""
    return rows.select(F.col(part).alias("part"), row_hash(columns).alias("h")).groupBy("part").agg(*hash_sums(F.col("h")))


def added_up(prints: DataFrame) -> DataFrame:
    """Fingerprints of the same partition, added up."""
    return prints.groupBy("part").agg(*(F.sum(c).alias(c) for c in SUMS))


def changed_parts(now: DataFrame, before: DataFrame) -> DataFrame:
    """``part`` of each partition that is new, gone or has other fingerprints than before."""
    a, b = now.alias("a"), before.alias("b")
    same = " AND ".join(f"a.{c} <=> b.{c}" for c in SUMS)
    return a.join(b, F.expr("a.part <=> b.part"), "full").where(f"NOT ({same})").select(
        F.coalesce("a.part", "b.part").alias("part")
    )


class IncrementalTable:
    """A stored result with one Parquet partition for each partition of its source.

    ``refresh`` takes fingerprints of the source, compares them with those of the last refresh
    that ended well, computes the partitions that differ and replaces each of them as a whole by
    dynamic partition overwrite. The new fingerprints count only after the rows are committed. A
    run that fails in between so changes nothing that counts as done: the next run finds the
    same partitions changed, and writes their rows again. Rows that come while a run reads are
    in none of its fingerprints, so the next run finds their partitions changed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._manifests = Manifests(spark, f"{self.root}/manifests")

    def before(self) -> DataFrame:
        """The fingerprints of the last refresh that ended well; no rows before the first."""
        body = self._manifests.newest()[1]
        if body is None:
            return self.spark.createDataFrame([], PRINTS)
        return self.spark.read.schema(PRINTS).parquet(f"{self.root}/fingerprints/{body['fingerprints']}")

    def take(self, source: DataFrame, part: str, columns: list[str]) -> str:
        """Stores fingerprints of the source and returns their name; they don't count yet."""
        name = uuid.uuid4().hex[:12]
        fingerprints(source, part, columns).write.parquet(f"{self.root}/fingerprints/{name}")
        return name

    def changed(self, name: str) -> DataFrame:
        """``part`` of each partition whose stored fingerprints of this name aren't those of the last refresh."""
        return changed_parts(self.spark.read.schema(PRINTS).parquet(f"{self.root}/fingerprints/{name}"), self.before())

    def replace(self, result: DataFrame, changed: DataFrame, part: str) -> None:
        """Replaces the changed partitions by the rows of ``result``, which has no others."""
        marked = result.withColumn("_row", F.lit(True))
        # A changed partition that has no rows left gets a row that isn't read, so that it is replaced.
        empty = [
            F.col("part").alias(part)
            if f.name == part
            else F.lit(False if f.name == "_row" else None).cast(f.dataType).alias(f.name)
            for f in marked.schema.fields
        ]
        (
            marked.unionByName(changed.select(*empty))
            .hint("rebalance", part)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(part)
            .parquet(f"{self.root}/rows")
        )

    def commit(self, name: str, **more) -> None:
        """Makes the fingerprints of this name those of the last refresh."""
        number, body = self._manifests.newest()
        self._manifests.commit((body or {}) | {"fingerprints": name} | more, number)

    def refresh(self, source: DataFrame, part: str, columns: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Brings the stored result up to date and returns it.

        ``part``: a column of type bigint of ``source``; NULL is a partition too.
        ``columns``: what the fingerprints cover.
        ``compute``: makes the result, with the column ``part``, from the rows of the changed
        partitions; each partition's result must follow from its own rows.
        """
        name = self.take(source, part, columns)
        changed = self.changed(name)
        these = changed.withColumnRenamed("part", "_changed_part")
        result = compute(source.join(these, F.expr(f"`{part}` <=> _changed_part"), "left_semi"))
        self.replace(result, changed, part)
        self.commit(name)
        return self.read(result.withColumn("_row", F.lit(True)).schema)

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        """The stored rows. Without ``schema``, with ``_row`` as a boolean, some row must have been stored."""
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.root}/rows").where("_row").drop("_row")


def successful_attempts(ledger: DataFrame) -> DataFrame:
    """``run_id, attempt`` whose last line, by ``line_no``, reads ``succeeded``.

    Letter case and blanks at the ends make no difference. A last line without status doesn't
    read so; lines without ``line_no`` have no place in the order and don't count.
    """
    last = F.max_by(F.coalesce("status", F.lit("")), "line_no")
    return (
        ledger.where("line_no IS NOT NULL")
        .groupBy("run_id", "attempt")
        .agg(last.alias("status"))
        .where(F.lower("status").rlike(r"^\s*succeeded\s*$"))
        .select("run_id", "attempt")
    )


def read_so_far(marks: DataFrame, ledger: DataFrame) -> DataFrame:
    """``fileid, upto``: how far attempts that count have read each file; files not read lack."""
    return (
        marks.where("fileid IS NOT NULL AND upto_pos IS NOT NULL")
        .join(successful_attempts(ledger), ["run_id", "attempt"], "left_semi")
        .groupBy("fileid")
        .agg(F.max("upto_pos").alias("upto"))
    )


def _ranges(parts: list[int], width: int, most: int = 64) -> list[tuple[int, int]]:
    """Ranges of file ids that cover some partitions: at most ``most``, so with the narrowest gaps filled."""
    ordered = sorted(parts)
    gaps = sorted(range(1, len(ordered)), key=lambda i: ordered[i - 1] - ordered[i])[: most - 1]
    cuts = [0, *sorted(i for i in gaps if ordered[i] > ordered[i - 1] + 1), len(ordered)]
    return [(ordered[i] * width, (ordered[j - 1] + 1) * width - 1) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]


class UnreadRecords:
    """Brings out, run by run, the records of a growing log that no earlier run has brought out.

    A record is a pair of ``key`` and ``tstamp``, NULL being a value like others; merges copy records into other files. Rows
    without ``fileid`` or ``pos`` have no position and are left out. What is stored below ``root`` between runs:

    * the fingerprints of each part of the log, as the last run that counts saw it. Parts are ranges of file
      ids, at most ``parts`` of them: when there are more than twice as many, each two become one, and their fingerprints add up;
    * the records read so far, as the sets that each run brought out.

    A run takes fingerprints of the log as it is (one aggregate, a row for each part and task is shuffled), and only parts
    that differ from the stored ones are read: their numbers, of which there are no more than parts, are
    filters of the scan. The rows of changed parts are stored, ``SHELF`` neighbouring parts in a partition, and each partition is
    replaced as a whole by dynamic partition overwrite. What is in them is made one row for each record and held against the
    records read so far.

    The new records, the new fingerprints and what was read count together, by one manifest, or not at all. A run that fails before
    changes nothing that counts, and the next one brings the same records out again. Of two runs at once the later fails.
    """

    COLUMNS = ["fileid", "pos", "key", "tstamp"]

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS, shelf: int = SHELF):
        self.spark, self.root, self.parts, self.shelf = spark, root.rstrip("/"), parts, shelf
        self._manifests = Manifests(spark, f"{self.root}/manifests")

    def _rows(self, log: DataFrame, width: int) -> DataFrame:
        part = F.floor(F.col("fileid") / F.lit(width)).cast("bigint")
        return log.where("fileid IS NOT NULL AND pos IS NOT NULL").select(*self.COLUMNS).withColumn("part", part)

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{kind}/{n}" for n in names])

    def _types(self, log: DataFrame) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}
        return ", ".join(f"{c} {kinds[c]}" for c in ("key", "tstamp", "fileid", "pos"))

    def _new(self) -> str:
        return uuid.uuid4().hex[:12]

    def adopt(self, log: DataFrame, marks: DataFrame, ledger: DataFrame) -> None:
        """Begins with what other jobs have read: by ``marks`` how far, by ``ledger`` which of them succeeded.

        The rows that they read are read once, and stored as a set of records with their row hashes, from which the fingerprints
        follow. Nothing but these is shuffled.
        """
        number, body = self._manifests.newest()
        if body is not None:
            raise ValueError(f"{self.root} has its own runs already")
        upto = read_so_far(marks, ledger)
        low, high = upto.agg(F.min("fileid"), F.max("fileid")).first()
        width = 1 if low is None else max(1, -(-(high - low + 1) // self.parts))
        name, prints = self._new(), self._new()
        seen = self._rows(log, width).join(upto, "fileid").where("pos <= upto")
        seen.select("part", "key", "tstamp", row_hash(self.COLUMNS).alias("h")).write.parquet(f"{self.root}/read/{name}")
        hashes = self._read("read", [name], "part bigint, h bigint")
        hashes.groupBy("part").agg(*hash_sums(F.col("h"))).write.parquet(f"{self.root}/fingerprints/{prints}")
        rows = self._read("fingerprints", [prints], PRINTS).agg(F.sum("n")).first()[0] or 0
        self._manifests.commit({"width": width, "fingerprints": prints, "read": [name], "run": 0, "rows": rows}, number)

    def _coarser(self, prints: DataFrame, times: int) -> DataFrame:
        """Fingerprints of parts that are so many times as wide."""
        if times == 1:
            return prints
        return added_up(prints.withColumn("part", F.floor(F.col("part") / F.lit(times)).cast("bigint")))

    def prepare(self, log: DataFrame) -> tuple[DataFrame, dict, int]:
        """A run that doesn't count yet: its new records, the manifest that would make it count, and its number."""
        number, body = self._manifests.newest()
        old = body["width"] if body else 1
        own, out = self._new(), self._new()
        fingerprints(self._rows(log, old), "part", self.COLUMNS).write.parquet(f"{self.root}/fingerprints/{own}")
        now, before = (self._read("fingerprints", names, PRINTS) for names in ([own], [body["fingerprints"]] if body else []))
        low, high = now.agg(F.min("part"), F.max("part")).first()
        times = 1
        while low is not None and high // times - low // times + 1 > 2 * self.parts:
            times *= 2
        width = old * times
        if times > 1:
            wide = self._new()
            self._coarser(now, times).write.parquet(f"{self.root}/fingerprints/{wide}")
            own, now = wide, self._read("fingerprints", [wide], PRINTS)
        # No more than the parts of both, whose number is bounded by the width.
        parts = [r["part"] for r in changed_parts(now, self._coarser(before, times)).collect()]
        known = body["read"] if body else []
        fresh = self._changed_rows(self._rows(log, width), parts, width)
        rows, mine = (body or {}).get("rows", 0), now.where(F.col("part").isin(parts)).agg(F.sum("n")).first()[0] or 0
        small = mine * SMALL_SHARE < rows
        self._unknown(fresh, self._read("read", known, self._types(log)), small).write.parquet(f"{self.root}/read/{out}")
        made = {"width": width, "fingerprints": own, "read": [*known, out], "run": (body or {"run": 0})["run"] + 1, "changed": len(parts), "rows": rows + mine}
        return self._read("read", [out], self._types(log)), made, number

    def _changed_rows(self, rows: DataFrame, parts: list[int], width: int) -> DataFrame:
        """The rows of the changed parts, stored and read again. Ranges of file ids let the scan skip what lies between."""
        near = F.lit(False)
        for low, high in _ranges(parts, width):
            near = near | F.col("fileid").between(low, high)
        table = IncrementalTable(self.spark, f"{self.root}/parts-{width}-{self.shelf}")
        changed = rows.where(near & F.col("part").isin(parts)).withColumn("shelf", F.floor(F.col("part") / F.lit(self.shelf)).cast("bigint"))
        shelves = sorted({p // self.shelf for p in parts})
        table.replace(changed, self.spark.createDataFrame([(s,) for s in shelves], "part bigint"), "shelf")
        stored = table.read(changed.withColumn("_row", F.lit(True)).schema)
        return stored.where(F.col("shelf").isin(shelves)) if shelves else stored.where("false")

    def _unknown(self, fresh: DataFrame, known: DataFrame, small: bool) -> DataFrame:
        """``key, tstamp, fileid, pos`` of each record of ``fresh`` that isn't known, at its lowest position.

        If ``fresh`` is ``small`` beside what is known, what is known of it is found first; Spark does that without a shuffle of
        what is known, as long as the records of ``fresh`` stay below its threshold for broadcasts. The result is the same.
        """
        records = fresh.groupBy("key", "tstamp").agg(F.min(F.struct("fileid", "pos")).alias("at")).select("key", "tstamp", "at.*")
        same = F.expr("a.key <=> b.key AND a.tstamp <=> b.tstamp")
        known = known.select("key", "tstamp")
        if small:
            asked = fresh.select("key", "tstamp").distinct()
            known = known.alias("a").join(asked.alias("b"), same, "left_semi")
        return records.alias("a").join(known.alias("b"), same, "left_anti")

    def commit(self, made: dict, number: int) -> None:
        """Makes a prepared run count."""
        if len(made["read"]) > MOST_SETS:
            name = self._new()
            one = self.spark.read.parquet(f"{self.root}/read/{made['read'][-1]}").select("key", "tstamp").schema
            self.spark.read.schema(one).parquet(*[f"{self.root}/read/{n}" for n in made["read"]]).write.parquet(f"{self.root}/read/{name}")
            made = made | {"read": [name]}
        self._manifests.commit(made, number)

    def run(self, log: DataFrame) -> DataFrame:
        """The new records of this run, ``key, tstamp, fileid, pos``: each once, with its lowest position."""
        records, made, number = self.prepare(log)
        self.commit(made, number)
        return records

    def vacuum(self) -> int:
        """Deletes what runs have left that failed or are past; returns how many folders. No run may be under way, and tables that
        runs returned can't be read any more, but for that of the last."""
        body, gone = self.last_run(), 0
        kept = {"read": body.get("read", []), "fingerprints": [body.get("fingerprints")]}
        fs, path = self._manifests.fs, self._manifests._path
        for kind, names in kept.items():
            folder = path(f"{self.root}/{kind}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                if s.getPath().getName() not in names:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone

    def last_run(self) -> dict:
        """``run``, ``width`` and how many parts were ``changed`` in the last run that counts; ``rows`` is how many rows were read, at most."""
        return self._manifests.newest()[1] or {}


def unread_records(log: DataFrame, marks: DataFrame, ledger: DataFrame, root: str, parts: int = PARTS) -> DataFrame:
    """``key, tstamp, fileid, pos`` of each record that no successful run has read.

    A record has been read if any of its positions was; else it is returned once, with its lowest position. Takes over what
    the runs in ``ledger`` have read, below ``root``, and makes the next run.
    """
    reader = UnreadRecords(log.sparkSession, root, parts)
    reader.adopt(log, marks, ledger)
    return reader.run(log)
