"""Bulk puts as a stream: every micro-batch is one put and one commit."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from vecfold.operators.access import Allowed
from vecfold.plans.store import VectorStore


def put_stream(store: VectorStore, batches: DataFrame, allowed: Allowed, name: str) -> DataStreamWriter:
    """A writer that puts each micro-batch of ``batches`` into the store.

    A commit records the stream's name and the batch's number, so a batch that is replayed after a
    failure is recognised and changes nothing. New ids derive from both.
    """

    def put(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        store.put(batch, allowed, f"{name}-{number}", stream=(name, number))

    return batches.writeStream.foreachBatch(put)
