"""Connections whose bytes come in pieces: a stream of chunks to a stream of frames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from logloom.api import KeyedLog
from logloom.config import Net
from logloom.functions.resp import READ, FrameReader, encode_reply, frames_of_chunks, parse_commands
from logloom.operators.consolidate import stored

CHUNKS = "connection string, n bigint, bytes binary, ended boolean"


def chunk_files(spark: SparkSession, folder: str, net: Net | None = None) -> DataFrame:
    """A stream of the chunks in Parquet files of a folder, where each connection writes its own files.

    At most ``max_connections`` files are read in a batch, so that no more connections than these are served at once. The
    files of a connection must be written in the order of its chunks.
    """
    limit = (net or Net()).max_connections
    return spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", limit).parquet(folder)


class _Connection(StatefulProcessor):
    """Keeps what a connection has sent of a frame that isn't whole yet, how many frames it has sent, and whether it is over."""

    def __init__(self, commands: bool):
        self.commands = commands

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "rest binary, number bigint, over boolean")

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        import pandas as pd

        held = self.state.get()
        rest, number, over = (b"", 0, False) if held is None else (bytes(held[0]), held[1], held[2])
        chunks = pd.concat(list(rows)).sort_values("n")
        out = []
        if not over:
            reader = FrameReader(rest)
            ended = bool(chunks["ended"].fillna(False).astype(bool).any())
            for row in frames_of_chunks(reader, number, (bytes(c) if c is not None else b"" for c in chunks["bytes"]), ended, self.commands):
                out.append((key[0], *row))
                number, over = row[0] + 1, row[1] != "frame"
            self.state.update((reader.rest if not over else b"", number, over))
        yield pd.DataFrame(out, columns=["connection", "frame_no", "status", "frame"])

    def close(self) -> None:
        pass


def stream_frames(chunks: DataFrame, commands: bool = False) -> DataFrame:
    """``connection, frame_no, status, frame`` of a stream of chunks, as ``resp.read_frames`` has them of a table.

    A row with ``ended`` is the last of its connection; with ``commands``, a frame that is no right command ends it too. What comes of a frame is state of the stream, so frames may be cut between
    batches, and streams be started again. Needs ``spark.sql.streaming.stateStore.providerClass`` to be RocksDB's.
    """
    return chunks.groupBy("connection").transformWithStateInPandas(_Connection(commands), READ, "Append", "none")


def serve_connections(chunks: DataFrame, store: KeyedLog, replies: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Bytes in, bytes out: runs the commands that connections send on a store, and writes the frames of the replies.

    ``chunks``: a stream of ``connection, n, bytes, ended``. Replies of batch ``n`` go to ``replies/batch=n``, as ``connection, frame_no, bytes``. The
    commands of a connection run in their order; those of different connections that come in one batch run by the connection's name.
    A frame that is wrong or no right command gets no reply and ends its connection. A batch that is run again
    after a failure changes nothing and replies the same, as in ``commands.serve``.
    """
    spark = store.spark

    def run(batch: DataFrame, number: int) -> None:
        work = f"{replies}/_work/{number}"
        fs = store._fs
        if number > store.manifest()["batch"]:
            fs.delete(store._path(work), True)
            ordered = (
                batch.where("status = 'frame'").repartitionByRange("connection", "frame_no").sortWithinPartitions("connection", "frame_no")
                .withColumn("seq", F.monotonically_increasing_id())
            )
            frames = stored(ordered, f"{work}/frames")
            store.apply(parse_commands(frames, "seq", "frame").drop("error"), f"{work}/replies", number)
        elif not fs.exists(store._path(work)):
            return  # this batch counts already, and its replies are written
        frames = spark.read.schema(f"{READ}, seq bigint").parquet(f"{work}/frames")
        said = spark.read.schema("seq bigint, kind string, int_val bigint, bytes_val binary").parquet(f"{work}/replies")
        frame = encode_reply(F.col("kind"), F.col("int_val"), F.col("bytes_val")).alias("bytes")
        out = frames.select("connection", "frame_no", "seq").join(said, "seq").select("connection", "frame_no", frame)
        out.write.mode("overwrite").parquet(f"{replies}/batch={number}")
        fs.delete(store._path(work), True)

    # Spark keeps such state in RocksDB only; the setting is that of the stream from its start on.
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _started(stream_frames(chunks, commands=True), run, checkpoint, trigger)
    finally:
        spark.conf.set(name, before)


def _started(frames: DataFrame, run, checkpoint: str, trigger: dict) -> StreamingQuery:
    query = frames.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return query.trigger(**trigger).start() if trigger else query.start()
