"""Streams of versions into a versioned table: an extension, as the data model has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators import versioned as V
from sparkloom.sources.store import Store


def upsert(stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """stream: key, value, is_tombstone. Each micro-batch becomes one flush; of a batch's versions of a key a tombstone
    wins, then the larger value. A batch that is run again writes the same rows with a newer sequence number."""

    def write(batch: DataFrame, _: int) -> None:
        rows = V.newest(batch.selectExpr("key", "value", "0L as seq", "is_tombstone"))
        rows = rows.persist()
        store.put(rows.where("not is_tombstone"))
        store.delete(rows.where("is_tombstone"))
        store.flush()
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
