"""The same operators over streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.state import accumulated, finished
from pulsegrid.plans.definitions import Metric
from pulsegrid.plans.engine import Engine
from pulsegrid.runtime import Scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streaming_state(events: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """The current state of a stream, for output in update or complete mode: one row a series, lifetime totals.

    Its state is one row a series, kept across restarts by the query's checkpoint.
    """
    return finished(accumulated(events, metrics))


def drain(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its result as a table in the shared folder."""
    scratch = Scratch(spark, "stream")
    out = scratch.path("out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def feed(engine: Engine, stream: DataFrame, checkpoint: str, every: str | None = "1 second", after: Callable[[Engine], None] | None = None, now: Callable[[], int] | None = None) -> StreamingQuery:
    """Ingest a telemetry stream batch by batch and save after each; a batch that comes again counts once.

    Snapshots go up to the last event, or to ``now()`` where that is given. Between batches
    a started engine takes them by its own clock.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            engine.ingest(batch, number, now() if now else None)
            engine.save()
        finally:
            batch.unpersist()
        if after:
            after(engine)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
