"""Landed session files into the store, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from memloom.plans.api import Engine
from memloom.sources.sessions import stream_sessions


def ingest_stream(spark: SparkSession, engine: Engine, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that merges new files of `path`; its checkpoint is the ledger of what was seen.

    A batch that is retried after a failure merges to the same store: merging is idempotent.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.ingest(batch)

    writer = stream_sessions(spark, path).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
