"""A corpus as token ids of a public tokenizer, and back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from logloom.llm import transducer as t
from logloom.session import ship_package

#: The vocabulary file that is used if none is named.
VOCABULARY = "byte_bpe_50k.json"

_LOADED: dict[bytes, t.Transducer] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(raw: bytes) -> t.Transducer:
    """The transducer of a vocabulary; a worker process makes it once and keeps its states."""
    name = hashlib.sha256(raw).digest()
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = t.Transducer(t.Vocabulary(raw))
    return _LOADED[name]


def share(spark: SparkSession, path: str | None):
    """The vocabulary file for all executors, which so needn't have it. Its size is fixed, 1.6 MB."""
    ship_package(spark)
    with open(path or vocabulary_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, and where each text starts and ends; NULL has none."""
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in parts whose texts have some MB together, each with their bytes and offsets."""
    if not batch.num_rows:
        return
    data, offsets = text_bytes(batch.column(column))
    for i, j in t.chunks(offsets):
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids``: the token ids of each row's whole text, without special tokens.

    A text that spells a special token, as ``<|endoftext|>``, is ordinary text. An empty text and NULL have no tokens:
    their ``ids`` is the empty list, never NULL. Each row gives one row, repeated keys and NULL
    keys too; other columns aren't read. ``path`` names another byte-level BPE file, of merges or of ranks,
    that splits texts by the same pattern.

    A map over Arrow batches without a shuffle; a very long text is one lane set of its own and
    is never cut anywhere but between pieces that don't affect each other.
    """
    shared = share(docs.sparkSession, path)
    rows = docs.select(docs[key], docs[text])
    schema = rows.select(rows[key]).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        machine = load(shared.value)
        for batch in batches:
            for part, data, offsets in parts_of(batch, 1):
                ids, counts = machine.encode(data, offsets[1:])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return rows.mapInArrow(run, schema)


def count(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_tokens``: how many tokens each row's whole text has; empty and NULL texts have 0."""
    shared = share(docs.sparkSession, path)
    rows = docs.select(docs[key], docs[text])
    schema = rows.select(rows[key]).schema.add("n_tokens", T.LongType())

    def run(batches):
        machine = load(shared.value)
        for batch in batches:
            for part, data, offsets in parts_of(batch, 1):
                counts = machine.count(data, offsets[1:])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, step: int = 4096) -> DataFrame:
    """``key, text``: the text of each row's ids; the empty list gives the empty text, NULL gives NULL.

    Ids are decoded ``step`` at a time as if they were still coming in. Bytes that can't be
    UTF-8 give U+FFFD; an id that the vocabulary lacks is an error.
    """
    shared = share(encoded.sparkSession, path)
    rows = encoded.select(encoded[key], encoded[ids])
    schema = rows.select(rows[key]).schema.add("text", T.StringType())

    def run(batches):
        machine = load(shared.value)
        for batch in batches:
            lists = batch.column(1)
            ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64) if len(lists) else np.zeros(1, np.int64)
            texts: list[str | None] = []
            for i, valid in enumerate(lists.is_valid().to_pylist()):
                if not valid:
                    texts.append(None)
                    continue
                decoder, out = t.StreamDecoder(machine.v.bytes), []
                for at in range(int(ends[i]), int(ends[i + 1]), step):
                    piece = lists.values.slice(at, min(step, int(ends[i + 1]) - at))
                    out.append(decoder.push_bytes(machine.v.joined(piece.to_numpy(zero_copy_only=False))))
                texts.append("".join(out) + decoder.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, schema)
