"""Streams of changes: runs from micro-batches, and a view of the latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import KVStore


def apply_batch(store: KVStore, order: list[str], name: str):
    """What ``ingest`` does with each micro-batch: a function of the batch and its number."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.apply_df(batch, order, (name, batch_id))

    return apply


def ingest(
    stream: DataFrame, store: KVStore, order: list[str], checkpoint: str, trigger: dict | None = None, name: str | None = None
) -> StreamingQuery:
    """Write each micro-batch of (key, op, value, and ``order``) as one run at level 0.

    The batch's number is committed with its run under the stream's ``name`` (else its checkpoint
    folder), so a batch that is delivered again after a failure adds nothing. Admission is the
    source's (maxFilesPerTrigger and such).
    """
    writer = stream.writeStream.foreachBatch(apply_batch(store, order, name or checkpoint)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def latest_state(stream: DataFrame) -> DataFrame:
    """The newest entry of each key of a stream of key, seq, op, value, for update or complete mode.

    Sequence numbers decide, so entries may arrive in any order and a late one changes nothing.
    """
    newest = stream.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("e"))
    return newest.select("key", "e.seq", "e.op", "e.value")
