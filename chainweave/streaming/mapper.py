"""Streaming classification of query transcripts against a fixed reference."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chainweave.operators.classify import best_codes
from chainweave.operators.context import candidates


def map_batch(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """The best code of each query that overlaps a reference on its strand."""
    return best_codes(candidates(queries, refs))


def map_stream(stream: DataFrame, refs: DataFrame, out: str, checkpoint: str):
    """Starts a query that appends the best code of each new transcript to Parquet files.

    Each micro-batch is a join of its transcripts with the references; a batch that runs again after a failure
    writes to its own folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        map_batch(batch, refs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
