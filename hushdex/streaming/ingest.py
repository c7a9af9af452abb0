"""Structured Streaming ingest of PUT and DELETE events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from hushdex.operators.engine import Engine

#: Columns of an event; op is put or delete, seq orders the events of an id.
EVENT = "entry_id string, op string, text string, seq bigint"


def applier(engine: Engine, index: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: one write for each batch.

    The event of the largest seq decides about an id, in whichever batch it comes; a
    late event, or a batch that is delivered again, changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        engine.apply_frame(index, batch)

    return apply


def ingest(engine: Engine, index: str, events: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start applying a stream of events to an index."""
    writer = events.writeStream.foreachBatch(applier(engine, index)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
