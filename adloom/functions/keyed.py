"""Per-key ordering that stays parallel when a single key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """Newest row per key.

    The rank filter lets Spark keep one candidate per key in every map task before the
    shuffle (WindowGroupLimit), so a hot key never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def sequence_in_time(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    number: str,
    previous: str,
    bucket: str = "hour",
) -> DataFrame:
    """Exact ROW_NUMBER and LAG(ts) per key, ordered by (ts, tie), without whole-key tasks.

    Rows are ranked inside (key, time bucket). How many rows precede a bucket, and when the
    last of them happened, comes from a per-bucket count that is combined map-side, so the
    running totals see one narrow row per bucket. NULL keys form one group, as in a window.
    """
    marks = []
    for i, key in enumerate(keys):
        df = df.withColumn(f"_k{i}", F.coalesce(F.col(key).cast("string"), F.lit("")))
        df = df.withColumn(f"_n{i}", F.col(key).isNull())
        marks += [f"_k{i}", f"_n{i}"]
    df = df.withColumn("_bucket", F.coalesce(F.unix_timestamp(F.date_trunc(bucket, F.col(ts))), F.lit(-(2**62))))

    before = Window.partitionBy(*marks).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = (
        df.groupBy(*marks, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"), F.max(ts).alias("_last"))
        .select(
            *marks,
            "_bucket",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.max("_last").over(before).alias("_last_before"),
        )
    )
    inside = Window.partitionBy(*marks, "_bucket").orderBy(F.col(ts).asc_nulls_first(), F.col(tie))
    return (
        df.join(per_bucket, [*marks, "_bucket"])
        .withColumn("_rank", F.row_number().over(inside))
        .withColumn("_lag", F.lag(ts).over(inside))
        .withColumn(number, (F.col("_rank") + F.col("_rows_before")).cast("bigint"))
        .withColumn(previous, F.when(F.col("_rank") == 1, F.col("_last_before")).otherwise(F.col("_lag")))
        .drop(*marks, "_bucket", "_rows_before", "_last_before", "_rank", "_lag")
    )


def share_of_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """value / max over the whole result, for aggregates of fixed size only (168 hour cells, one
    row per alert type): the global window then sees just those rows and nothing is read twice."""
    top = F.max(value).over(Window.partitionBy())
    return df.withColumn(out, F.when(top > 0, F.col(value) / top).otherwise(F.lit(0.0)))
