"""Schemas of the tables of a keyed log. Keys and values are bytes; a NULL value is a tombstone."""

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


LONG, BYTES = T.LongType(), T.BinaryType()
LOG = _schema(fileid=LONG, pos=LONG, len=LONG, tstamp=LONG, key=BYTES, value=BYTES)
HINT = _schema(fileid=LONG, pos=LONG, len=LONG, tstamp=LONG, key=BYTES)
SNAPSHOT = _schema(key=BYTES, value=BYTES, fileid=LONG, pos=LONG, len=LONG, tstamp=LONG)
COMMANDS = _schema(seq=LONG, op=T.StringType(), keys=T.ArrayType(BYTES), value=BYTES)
REPLIES = _schema(seq=LONG, kind=T.StringType(), int_val=LONG, bytes_val=BYTES)
FRAMES = _schema(
    frame_id=LONG, path=T.ArrayType(T.IntegerType()), kind=T.StringType(), int_val=LONG, bytes_val=BYTES, n_items=T.IntegerType()
)
