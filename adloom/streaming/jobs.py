"""Structured Streaming jobs: append-only logs with id de-duplication and late re-statement.

All jobs take their checkpoint folder as an argument (a shared folder on a cluster) and run
with any trigger; `availableNow` drains what has landed and stops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from adloom.sinks import tables as T


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", **options: str) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def unique_events(stream: DataFrame, key: str, horizon: str = "1 day") -> DataFrame:
    """Drop repeats of an id that arrive within the retry horizon; state is bounded by it.

    The watermark runs on the arrival time, so an event with an old timestamp is never late and
    never lost.
    """
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", horizon)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("_arrived")


def _append_once(log_path: str, schema: StructType, key: str, writer: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch finds its commit record and reads nothing; repeats beyond the horizon are caught
        # against the buckets of the log that the batch touches
        T.append_event(batch.sparkSession, log_path, batch.select(*schema.names), schema, key, batch=f"{writer}-{batch_id}")

    return write


def stream_events(
    stream: DataFrame, log_path: str, schema: StructType, checkpoint: str, key: str = "event_id",
    horizon: str = "1 day", trigger: dict | None = None,
) -> StreamingQuery:
    """Continuous append of edits to the log."""
    return (
        unique_events(stream, key, horizon)
        .writeStream.foreachBatch(_append_once(log_path, schema, key, hashlib.sha1(checkpoint.encode()).hexdigest()[:16]))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_tombstones(stream: DataFrame, log_path: str, schema: StructType, checkpoint: str, **kw) -> StreamingQuery:
    """Soft deletes; deleting an event again adds nothing."""
    return stream_events(stream, log_path, schema, checkpoint, **kw)


def stream_audit(stream: DataFrame, log_path: str, schema: StructType, checkpoint: str, **kw) -> StreamingQuery:
    """Access changes as an append-only audit log."""
    return stream_events(stream, log_path, schema, checkpoint, **kw)


def stream_restate(
    stream: DataFrame, path: str, schema: StructType, keys: Sequence[str], partition: str, checkpoint: str,
    now: Column, newest: Sequence[Column] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Late corrections of a trailing window, upserted by natural key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        T.merge_upsert(batch.sparkSession, path, batch, schema, keys, partition, now, newest=newest)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_range_replace(
    stream: DataFrame, path: str, schema: StructType, date_col: str, checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Every batch is one complete re-pull; the days it spans are replaced as a whole."""

    def write(batch: DataFrame, batch_id: int) -> None:
        span = batch.agg(F.min(date_col), F.max(date_col)).first()
        if span[0] is not None:
            T.replace_range(batch.sparkSession, path, batch, schema, date_col, span[0], span[1])

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_calls_upsert(
    stream: DataFrame, path: str, schema: StructType, checkpoint: str, now: Column, key: str = "id",
    partition: str = "call_date", newest: Sequence[Column] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Staged call batches merged by call id; a corrected call may move to another day."""

    def write(batch: DataFrame, batch_id: int) -> None:
        T.upsert_by_id(batch.sparkSession, path, batch, schema, [key], partition, now, newest)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

