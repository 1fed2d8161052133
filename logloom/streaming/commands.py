"""Command streams: each command is answered by what came before it."""

from __future__ import annotations

import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from logloom.api import KeyedLog
from logloom.schema import REPLIES


def serve(stream: DataFrame, store: KeyedLog, replies: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Applies a stream of ``seq, op, keys, value`` to a store, batch by batch.

    Replies of batch ``n`` go to ``replies/batch=n``. The store remembers the last batch applied with its
    changes, so a batch that is run again after a failure changes nothing and replies the same.
    DEL may name several keys. Within a batch commands run by ``seq``; ``trigger`` is as for ``writeStream.trigger``. Without it
    the store's ``sync`` says when changes must be on disk: at so many milliseconds, or else as soon as each batch ends.
    """
    if not trigger and isinstance(store.conf.sync, int):
        trigger = {"processingTime": f"{store.conf.sync} milliseconds"}

    def run(batch: DataFrame, number: int) -> None:
        store.apply(batch, f"{replies}/batch={number}", number)

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return query.trigger(**trigger).start() if trigger else query.start()


def stop_gracefully(query: StreamingQuery, seconds: float | None = None) -> bool:
    """Ends a stream after what has come so far is answered; false if that took longer than ``seconds``, and it was stopped then."""
    done = threading.Thread(target=query.processAllAvailable, daemon=True)
    done.start()
    done.join(seconds)
    query.stop()
    query.awaitTermination()
    return not done.is_alive()


class _Holder(StatefulProcessor):
    """Keeps the value of one key and answers its commands by ``seq``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value binary")

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        import pandas as pd

        held = self.value.get()
        held = None if held is None else bytes(held[0])
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            if row.op == "SET":
                held = bytes(row.value) if row.value is not None else b""
                out.append((row.seq, "simple", None, b"OK"))
            elif row.op == "DEL":
                out.append((row.seq, "integer", int(held is not None), None))
                held = None
            elif row.op == "GET":
                out.append((row.seq, "null" if held is None else "bulk", None, held))
        if held is None:
            self.value.clear()
        else:
            self.value.update((held,))
        frame = pd.DataFrame(out, columns=REPLIES.names)
        frame["int_val"] = frame["int_val"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def stateful_replies(stream: DataFrame) -> DataFrame:
    """``seq, kind, int_val, bytes_val`` of a stream of ``seq, op, key, value``, one key to each command.

    What each key holds is state of the stream, hash-partitioned by key and kept in RocksDB, so it may outgrow
    memory and survives restarts. Needs ``spark.sql.streaming.stateStore.providerClass`` to be RocksDB's.
    """
    return stream.groupBy("key").transformWithStateInPandas(_Holder(), REPLIES, "Append", "none")
