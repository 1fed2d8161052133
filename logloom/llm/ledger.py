"""Which keys occurred before, exactly, with all earlier keys on disk."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.manifests import Manifests

#: So many runs of one size are merged into one of the next size.
FAN_IN = 8


class LedgerError(ValueError):
    """The ledger was made with other buckets or other keys."""


class KeyLedger:
    """The set of all keys so far, hash-partitioned into buckets on disk, each bucket a few sorted files.

    How many buckets and which type of key a ledger has is written beside its files when it is made, and holds
    whenever it is opened, whatever the session's settings; asking for others is an error. So keys are
    always looked for where they are.

    A batch is first folded to its distinct keys, each with its first arrival, by an aggregate
    that combines in each task before the shuffle. The history is a list of runs, each with one sorted file for each
    bucket. The batch is shuffled and sorted once and then goes through a sort-merge left join with each run, whose
    files are streamed as they lie: neither shuffled nor sorted again. Keys without a match are new and
    become a run of their own. ``FAN_IN`` runs of one size are merged into one, so there are some ``8 * log8(batches)``
    runs, and each key is written again only as often as that logarithm. The size of a run is the logarithm of its keys.

    Keys are compared by all their bytes, so there are no wrong answers. A batch that is
    appended twice, as after a failure, changes nothing: the ledger is a set.
    """

    def __init__(self, spark: SparkSession, root: str, key_type: str | None = None, buckets: int | None = None):
        """Opens the ledger below ``root``, or starts one.

        ``key_type`` and ``buckets`` count for a new ledger, by default binary and the session's shuffle
        partitions; for one that is there they may only say what it has.
        """
        self.spark, self.root = spark, root.rstrip("/")
        self._manifests = Manifests(spark, f"{self.root}/manifests")
        self._tables: dict[str, str] = {}
        number, body = self._manifests.newest()
        if body is None:
            made = {
                "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "key_type": key_type or "binary", "runs": [],
            }
            self._manifests.commit(made, number)
            body = made
        for name, asked in (("buckets", buckets), ("key_type", key_type)):
            if asked not in (None, body[name]):
                raise LedgerError(f"the ledger in {root} has {name} {body[name]}, not {asked}")
        self.buckets, self.key_type = body["buckets"], body["key_type"]

    def runs(self) -> list[dict]:
        """``name``, ``keys`` and ``level`` of each run that counts, the largest first."""
        return sorted(self._manifests.newest()[1]["runs"], key=lambda r: -r["keys"])

    def _table(self, name: str) -> str:
        """The catalog's name of a run; only the catalog's tables can have buckets."""
        if name not in self._tables:
            table = f"key_run_{uuid.uuid4().hex[:12]}"
            self.spark.sql(
                f"CREATE TABLE {table} (key {self.key_type}) USING parquet "
                f"CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.root}/runs/{name}'"
            )
            self._tables[name] = table
        return self._tables[name]

    @contextmanager
    def _planned(self) -> Iterator[None]:
        """Settings under which jobs on the ledger are planned: shuffles into as many partitions as there are buckets, and
        trust in the order within bucket files, which Spark has only where a bucket is one file."""
        own = {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
        before = {name: self.spark.conf.get(name, None) for name in own}
        for name, value in own.items():
            self.spark.conf.set(name, value)
        try:
            yield
        finally:
            for name, value in before.items():
                self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)

    def _write(self, keys: DataFrame, shuffled: bool) -> dict:
        name = uuid.uuid4().hex[:12]
        ready = keys.select("key") if shuffled else keys.select("key").repartition(self.buckets, "key")
        with self._planned():
            (
                ready.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key")
                .mode("append").saveAsTable(self._table(name))
            )
        n, level = self.spark.table(self._table(name)).count(), 0
        while FAN_IN ** (level + 1) <= n:
            level += 1
        return {"name": name, "keys": n, "level": level}

    def append(self, keys: DataFrame) -> None:
        """Adds the keys of the column ``key``, which must be distinct and not NULL, then merges runs of one size."""
        run = self._write(keys, False)
        number, body = self._manifests.newest()
        self._manifests.commit(body | {"runs": [*body["runs"], run]}, number)
        self.merge()

    def merge(self) -> None:
        """Merges runs while ``FAN_IN`` of them have one size. The bucketing carries over: no shuffle."""
        while True:
            number, body = self._manifests.newest()
            by_level: dict[int, list[dict]] = {}
            for r in body["runs"]:
                by_level.setdefault(r["level"], []).append(r)
            full = [level for level, rs in sorted(by_level.items()) if len(rs) >= FAN_IN]
            if not full:
                return
            old = by_level[full[0]]
            # A batch that came twice may have its keys in two runs. Full joins keep the buckets and the order.
            both = self.spark.table(self._table(old[0]["name"]))
            for r in old[1:]:
                both = both.join(self.spark.table(self._table(r["name"])).hint("merge"), "key", "full")
            run = self._write(both, True)
            kept = [r for r in body["runs"] if r not in old]
            self._manifests.commit(body | {"runs": [*kept, run]}, number)

    def start(self, *histories: DataFrame) -> None:
        """Adds the keys of tables with a column ``key``; NULL is no key."""
        keys = [h.where("key IS NOT NULL").select("key").distinct() for h in histories]
        union = keys[0]
        for k in keys[1:]:
            union = union.unionByName(k)
        self.append(union.distinct())

    def keys(self) -> DataFrame:
        """All keys, each once for each run that has it."""
        all_keys = self.spark.createDataFrame([], f"key {self.key_type}")
        for r in self.runs():
            all_keys = all_keys.unionByName(self.spark.table(self._table(r["name"])))
        return all_keys

    def first_arrivals(self, batch: DataFrame, order: str) -> DataFrame:
        """``key, first`` of each key of the batch that the ledger lacks: the arrival of rank one.

        ``batch`` has ``key`` and ``order``, which is unique. Rows without one of them are left out.
        """
        ranked = (
            batch.where(F.col("key").isNotNull() & F.col(order).isNotNull())
            .groupBy("key").agg(F.min(order).alias("first"))
        )
        for r in self.runs():
            known = self.spark.table(self._table(r["name"])).select("key", F.lit(True).alias("known")).hint("merge")
            ranked = ranked.join(known, "key", "left").where("known IS NULL").select("key", "first")
        return ranked

    def store_first_arrivals(self, batch: DataFrame, order: str, folder: str) -> DataFrame:
        """The same written to a folder, with the order of the ledger's files in use; returns what was written."""
        with self._planned():
            self.first_arrivals(batch, order).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(f"key {self.key_type}, first {batch.schema[order].dataType.simpleString()}").parquet(folder)

    def seen(self, batch: DataFrame, order: str, new: DataFrame) -> DataFrame:
        """The rows of the batch, as ``key`` and ``order``, whose key occurred before.

        These are all rows with a key but the first arrivals of new keys. They are told apart by
        key and arrival, so that the rows of a hot key spread over all tasks.
        """
        rows = batch.where(F.col("key").isNotNull() & F.col(order).isNotNull()).select("key", order)
        firsts = new.withColumnRenamed("first", order)
        return rows.join(firsts, [order, "key"], "left_anti")

    def vacuum(self) -> None:
        """Deletes the files of runs that were merged or never counted. Nobody else may use the ledger meanwhile."""
        fs, path = self._manifests.fs, self._manifests._path
        counts = {r["name"] for r in self.runs()}
        folder = path(f"{self.root}/runs")
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            if s.getPath().getName() not in counts:
                fs.delete(s.getPath(), True)

    def close(self) -> None:
        """Forgets the catalog's names; the ledger's files stay."""
        for table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables = {}


def seen_before(
    feed: DataFrame, histories: list[DataFrame], root: str, order: str = "feed_seq", buckets: int | None = None
) -> DataFrame:
    """``key, feed_seq`` of the rows of a feed whose key is in a history or came earlier in the feed.

    Makes the ledger of the histories below ``root``, looks the feed up as one batch, and appends
    its new keys, so that the next batch finds them. Empty tables give no rows. The empty key is
    a key; rows whose key or arrival is NULL are left out. A row that is there twice arrives once, so
    neither of the two is seen for the other's sake. Other columns aren't read.
    """
    ledger = KeyLedger(feed.sparkSession, f"{root}/keys", feed.schema["key"].dataType.simpleString(), buckets)
    ledger.start(*histories)
    new = ledger.store_first_arrivals(feed, order, f"{root}/new")
    ledger.append(new)
    ledger.close()
    return ledger.seen(feed, order, new)


def seen_in_batches(
    batches: list[DataFrame], histories: list[DataFrame], root: str, order: str = "feed_seq", sessions: list[int] | None = None
) -> DataFrame:
    """As ``seen_before``, for a feed that comes as several batches, each after all before it.

    The ledger is opened anew for each batch, as by jobs on different days. ``sessions``: the shuffle partitions that the
    session has at each of them; they make no difference.
    """
    spark, found = batches[0].sparkSession, None
    kind = batches[0].schema["key"].dataType.simpleString()
    first = KeyLedger(spark, f"{root}/keys", kind)
    first.start(*histories)
    first.close()
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    for n, batch in enumerate(batches):
        spark.conf.set("spark.sql.shuffle.partitions", str(sessions[n]) if sessions else setting)
        try:
            ledger = KeyLedger(spark, f"{root}/keys")
            new = ledger.store_first_arrivals(batch, order, f"{root}/new/{n}")
            ledger.append(new)
            ledger.close()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", setting)
        seen = ledger.seen(batch, order, new)
        found = seen if found is None else found.unionByName(seen)
    return found


def wrong_answers(feed: DataFrame, histories: list[DataFrame], found: DataFrame, order: str = "feed_seq") -> DataFrame:
    """One row: ``n_rows`` with a key, ``n_found``, ``n_wrong`` of them and ``wrong_rate``.

    The truth is worked out anew without the ledger: for each key its first arrival, before all
    others if a history has it, joined to each row of the feed. AQE splits the skewed keys.
    """
    old = None
    for h in histories:
        k = h.where("key IS NOT NULL").select("key", F.lit(True).alias("old"), F.lit(None).cast("bigint").alias("at")).distinct()
        old = k if old is None else old.unionByName(k)
    rows = feed.where(F.col("key").isNotNull() & F.col(order).isNotNull()).select("key", F.col(order).alias("at")).distinct()
    firsts = (
        old.unionByName(rows.select("key", F.lit(False).alias("old"), "at"))
        .groupBy("key")
        .agg(F.max("old").alias("old"), F.min("at").alias("first"))
    )
    truth = rows.join(firsts, "key").select("key", "at", (F.col("old") | (F.col("at") > F.col("first"))).alias("truth"))
    said = found.select("key", F.col(order).alias("at"), F.lit(True).alias("said")).distinct()
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    both = truth.join(said, ["key", "at"], "full")
    said_so, true = F.coalesce("said", F.lit(False)), F.coalesce("truth", F.lit(False))
    return both.agg(
        F.count("*").alias("n_rows"), n(said_so).alias("n_found"), n(said_so != true).alias("n_wrong")
    ).withColumn("wrong_rate", F.when(F.col("n_rows") > 0, F.col("n_wrong") / F.col("n_rows")).otherwise(F.lit(0.0)))


def watch(stream: DataFrame, ledger: KeyLedger, found: str, checkpoint: str, order: str = "feed_seq", **trigger):
    """Runs a stream of ``key`` and ``order`` through a ledger, batch by batch; returns the streaming query.

    The seen rows of batch ``n`` go to ``found/batch=n``. The new keys of a batch are stored before they are
    appended, and a batch that is run again after a failure uses those of its first run; so
    keys that it appended itself don't count as seen.
    """
    spark = ledger.spark

    def run(batch: DataFrame, number: int) -> None:
        new_at = f"{found}/_new/{number}"
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{new_at}/_SUCCESS")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            ledger.store_first_arrivals(batch, order, new_at)
        new = spark.read.schema(f"key {ledger.key_type}, first bigint").parquet(new_at)
        ledger.seen(batch, order, new).write.mode("overwrite").parquet(f"{found}/batch={number}")
        ledger.append(new)

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return query.trigger(**trigger).start() if trigger else query.start()
