"""Structured Streaming into tables: each micro-batch is one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..table import Table


def upsert_batch(table: Table, order_by: list[str] = ()) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that upserts. A batch that runs again after a failure upserts the same
    rows, which changes nothing; with order_by the last row of a key in a batch counts."""

    def run(batch: DataFrame, _: int) -> None:
        table.upsert_data(batch, on_duplicate="last" if order_by else "raise", order_by=list(order_by))

    return run


def stream_into(stream: DataFrame, table: Table, checkpoint: str, order_by: list[str] = (), available_now: bool = True) -> StreamingQuery:
    """Start a query that upserts a stream into a table; by default it ends once all input is read."""
    writer = stream.writeStream.foreachBatch(upsert_batch(table, order_by)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
