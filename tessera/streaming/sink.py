"""Streaming ingestion: every micro-batch is one put.

Rows are addressed by content, so a batch that is replayed after a failure inserts nothing, and the sink is exactly-once
in effect without any record of batch ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.stores import AtomStore, ObservationStore


def start(stream: DataFrame, store: AtomStore | ObservationStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Put every micro-batch of the stream into the store; by default what is there now, and then end."""
    put = store.put_atoms if isinstance(store, AtomStore) else store.put_observations

    def batch(rows: DataFrame, _: int) -> None:
        # The batch runs in a session of its own, and the put writes where the store's manifest says.
        put(rows)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
