"""An extension over the batch surface: facts that arrive as a stream, deduplicated against what is stored.

The reference has no streaming; this gives its re-import semantics (a record is accepted once for each
source) to micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evidentia.operators.facts import split_duplicates
from evidentia.sources.store import TableStore


def ingest(stream: DataFrame, store: TableStore, checkpoint: str, normalize: Callable[[DataFrame], DataFrame], table: str = "metrics") -> StreamingQuery:
    """Normalizes each micro-batch and appends its accepted rows; a batch replayed after a failure adds nothing: its number
    is kept with the table, and its records are known there. Small parts are merged as they come, so their number grows with
    the logarithm of the batches."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = normalize(batch)
        accepted, _ = split_duplicates(rows, store.read(table) if store.exists(table) else None)
        store.append(table, accepted, tag=f"{checkpoint}#{batch_id}")
        store.compact(table)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
