"""Small helpers the text operators share: Arrow batches in and out, and settings that bound a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that travel to a Python worker at once; long texts make this a memory bound.
BATCH_ROWS = 512


def bounded(spark: SparkSession) -> SparkSession:
    """Limit the rows of an Arrow batch, so that a batch of long texts fits in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null becomes empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    return [t or b"" for t in col.to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def per_batch(
    df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch]], schema: str,
) -> DataFrame:
    """Run fn()'s result over every Arrow batch; fn itself runs once per task, to set up its state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)
