"""The registered queries of this subpackage, and SQL to check them against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import ledger, packing, reading, tokens
from logloom.session import new_folder
from logloom.sources.tables import table


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame], str]:
    feed = table(spark, d, "change_feed").select("feed_seq", "key")
    return feed, [table(spark, d, name).select("key") for name in ("log_entries", "hint_entries")], new_folder(spark, "ledger")


def _seen(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    feed, histories, root = _tables(spark, d)
    return feed, histories, ledger.seen_before(feed, histories, root)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d)[2].select("feed_seq")


def p1_error(spark: SparkSession, d: str) -> DataFrame:
    return ledger.wrong_answers(*_seen(spark, d))


def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """The feed in four batches, by arrival; the ledger is opened anew for each, under other numbers of shuffle partitions."""
    feed, histories, _ = _tables(spark, d)
    low, high = feed.agg(F.min("feed_seq"), F.max("feed_seq")).first()
    step = max(1, -(-((high or 0) - (low or 0) + 1) // 4))
    part = F.floor((F.col("feed_seq") - F.lit(low or 0)) / F.lit(step))
    return ledger.seen_in_batches([feed.where(part == n) for n in range(4)], histories, new_folder(spark, "ledger"), sessions=[5, 16, 3, 8]).select("feed_seq")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """How many documents have a text, and of how many it is again what its ids decode to."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = tokens.decode(tokens.encode(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").agg(
        F.count("text").alias("n_texts"), F.count_if(F.col("text") == F.col("back")).alias("n_same")
    )


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """The token counts of all documents, stored, since packing reads them more than once."""
    folder = new_folder(spark, "sizes")
    tokens.count(table(spark, d, "documents")).write.parquet(folder)
    return spark.read.parquet(folder)


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d))


def p7_use(spark: SparkSession, d: str) -> DataFrame:
    """How many containers are used, how full they are, and the fewest that could do."""
    fill = packing.pack(_sizes(spark, d)).groupBy("container").agg(F.sum("length").alias("n"), F.count("*").alias("items"))
    return fill.agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.sum("n").alias("tokens"),
        F.max("n").alias("fullest"),
        F.ceil(F.sum("n") / packing.CAPACITY).alias("fewest"),
        (F.sum("n") / (F.count("*") * packing.CAPACITY)).alias("used"),
    )


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: each document is there as a whole, no container holds too much, none is split that fits,
    and the containers are no more than one in a hundred above the fewest that could do, and one."""
    sizes = _sizes(spark, d)
    packed = packing.pack(sizes)
    per_doc = packed.groupBy("doc_id").agg(F.sum("length").alias("length"), F.count("*").alias("parts"))
    docs = sizes.join(per_doc, "doc_id", "left").agg(
        F.count("*").alias("documents"),
        F.count_if(F.coalesce(F.col("length") != F.col("n_tokens"), F.lit(True))).alias("not_whole"),
        F.count_if(F.col("parts") != F.greatest(F.ceil(F.col("n_tokens") / packing.CAPACITY), F.lit(1))).alias("split_in_vain"),
    )
    fill = packed.groupBy("container").agg(F.sum("length").alias("n"))
    use = fill.agg(
        F.count_if(F.col("n") > packing.CAPACITY).alias("overfull"),
        (F.count("*") <= F.ceil(F.sum("n") / packing.CAPACITY * 1.01) + 1).alias("near_fewest"),
    )
    # Two tables of one row each.
    return docs.withColumn("one", F.lit(1)).join(use.withColumn("one", F.lit(1)), "one").drop("one")


def _profiles(spark: SparkSession, d: str, asked: Column | None = None) -> DataFrame:
    """The features of all rows that are asked for or labelled, stored, so that the texts are read once."""
    folder = new_folder(spark, "profiles")
    measured = reading.profiles(table(spark, d, "documents"), table(spark, d, "level_labels"), asked)
    measured.write.parquet(folder)
    return spark.read.schema(measured.schema).parquet(folder)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """English documents of at least 600 code points whose level rounds to 4 or 5."""
    measured = _profiles(spark, d, F.expr("lang = 'en' AND n_chars >= 600"))
    return reading.levels(measured, reading.train(measured)).where("level >= 3.5").select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    measured = _profiles(spark, d)
    return reading.levels(measured, reading.train(measured))


def p8_cv(spark: SparkSession, d: str) -> DataFrame:
    """How well levels are predicted for sources that neither the trees nor the calibration have seen, by fold."""
    return reading.scores(spark, reading.train(_profiles(spark, d, F.lit(False))))


def p8_rows(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any levels: one for each row, none where there is no text, and all on the scale."""
    level = F.col("level")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.trim("text") == "", F.lit(True)).alias("blank"))
    return docs.join(p8_levels(spark, d), "doc_id").agg(
        F.count("*").alias("documents"), F.count_if("blank").alias("blank"), F.count_if(F.col("blank") & level.isNotNull()).alias("blank_with_level"),
        F.count_if(~level.between(*reading.SCALE)).alias("off_scale"),
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_batches, p1_error, p6_ids, p6_roundtrip, p7_pack, p7_use, p7_check, p8_found, p8_levels, p8_cv, p8_rows)}

_P1 = """
WITH old AS (SELECT key FROM log_entries UNION SELECT key FROM hint_entries),
ranked AS (
  SELECT f.feed_seq, f.key, o.key IS NOT NULL AS old,
    row_number() OVER (PARTITION BY f.key ORDER BY f.feed_seq) AS n
  FROM change_feed f LEFT JOIN old o ON o.key = f.key WHERE f.key IS NOT NULL
)
"""

ORACLE = {
    "p1_found": _P1 + "SELECT feed_seq FROM ranked WHERE old OR n > 1",
    "p1_batches": _P1 + "SELECT feed_seq FROM ranked WHERE old OR n > 1",
    "p1_error": _P1
    + """SELECT count(*) AS n_rows, count(*) FILTER (WHERE old OR n > 1) AS n_found,
  CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS DOUBLE) AS wrong_rate FROM ranked""",
    "p6_roundtrip": "SELECT count(text) AS n_texts, count(text) AS n_same FROM documents",
    "p7_check": """SELECT count(*) AS documents, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS split_in_vain,
  CAST(0 AS BIGINT) AS overfull, true AS near_fewest FROM documents""",
    "p8_rows": """SELECT count(*) AS documents, count(*) FILTER (WHERE coalesce(trim(text, ' ') = '', true)) AS blank,
  CAST(0 AS BIGINT) AS blank_with_level, CAST(0 AS BIGINT) AS off_scale FROM documents""",
}
