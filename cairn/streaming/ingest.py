"""Incremental ingest: each micro-batch of a stream of files becomes a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cairn.store import SnapshotStore


def ingest_stream(stream: DataFrame, store: SnapshotStore, checkpoint: str, prefix: str = "batch") -> StreamingQuery:
    """Store the files (path, mode, content) of each micro-batch as snapshot ``<prefix>-<number>``.

    A batch that is run again after a failure, wherever that came, replaces its own snapshot. Chunks
    that were indexed are not stored again; objects that were not are unknown to the index, and gc
    drops them. So readers see what they would see had it run once.
    """

    def put(batch: DataFrame, number: int) -> None:
        store.ingest(batch, f"{prefix}-{number:06d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
