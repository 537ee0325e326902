"""Incremental runs: new input files are worked on once, output is committed per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_incremental(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: str, work: Callable[[DataFrame], DataFrame], uid: str = "_row_uid", fmt: str = "parquet", late: str | None = None, delay: str = "1 hour"):
    """Feed files of ``source`` through ``work`` and append to ``sink``; returns the query, already drained.

    Each uid is worked on once over all runs (state in the checkpoint; with ``late``, an
    event-time column, state is dropped ``delay`` after the watermark). A batch that is
    replayed after a failure overwrites its own folder, so the sink has it once.
    """
    rows = spark.readStream.schema(schema).format(fmt).load(source)
    if late:
        rows = rows.withWatermark(late, delay).dropDuplicatesWithinWatermark([uid])
    else:
        rows = rows.dropDuplicates([uid])

    def commit(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    query = rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
