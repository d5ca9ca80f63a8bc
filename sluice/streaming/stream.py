"""Structured Streaming as the feed: each micro-batch of a changelog is one transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .engine import Engine


def follow(engine: Engine, table: str, changes: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Feed a streaming changelog (_id, _op, optional _seq, fields) into the engine.

    Batch ids are saved with the state for every feed, which its checkpoint names,
    so a batch that is replayed after a restart is not applied twice, and any number
    of feeds can fill any tables.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        engine.apply_changes(table, batch, batch_id, source=checkpoint)

    writer = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
