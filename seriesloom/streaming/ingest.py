"""Streaming ingest: micro-batches of (stream_id, ts, value columns) appended to a store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.warehouse import Warehouse


def batch_name(checkpoint: str, number: int) -> str:
    """Name of a micro-batch in the store."""
    return f"{uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex}-{number}"


def ingest(store: Warehouse, source: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Each micro-batch becomes readable as a whole. source: a streaming DataFrame with stream_id, ts and any of
    v_i64, v_u64, v_f64; late and repeated samples are kept, as with inserts. A micro-batch that is run again after a
    failure replaces itself, as its batch is named by the checkpoint and its number."""
    writer = source.writeStream.foreachBatch(lambda df, i: store.append(df, batch_name(checkpoint, i))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
