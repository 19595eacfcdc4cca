"""Checks that run beside the products: fan-out, duplicates, suppressed rows, parity, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adloom.functions import labels as L


def fanout_check(pre: DataFrame, post: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Row counts around a mapping join and the number of keys with several values."""
    many = mapping.groupBy(key).agg(F.count_distinct(value).alias("n")).filter("n > 1")
    one = F.count(F.lit(1))
    return pre.agg(one.alias("rows_before")).select(
        "rows_before",
        post.agg(one).scalar().alias("rows_after"),
        many.agg(one).scalar().alias("keys_with_many"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def suppressed_rows(df: DataFrame, dropped: Column, by: Sequence[str]) -> DataFrame:
    """How many source rows a defensive filter removes, per group."""
    return df.groupBy(*by).agg(F.count_if(dropped).alias("suppressed"), F.count(F.lit(1)).alias("total"))


def parity(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Difference per key between two aggregated feeds."""
    a = left.select(*keys, F.col(value).alias("_l"))
    b = right.select(*keys, F.col(value).alias("_r"))
    lv, rv = F.coalesce("_l", F.lit(0.0)), F.coalesce("_r", F.lit(0.0))
    return a.join(b, list(keys), "full").select(
        *keys,
        lv.alias("left_value"),
        rv.alias("right_value"),
        (lv - rv).alias("delta"),
        (F.abs(lv - rv) <= tolerance).alias("within_tolerance"),
    )


def ids_missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of one feed that the other does not know."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def channel_coverage(spend: DataFrame, expected: Sequence[str] = tuple(L.CHANNEL_LABELS)) -> DataFrame:
    """Is every expected channel present in a spend product?"""
    wanted = spend.sparkSession.createDataFrame([(c,) for c in expected], "channel string")
    present = spend.select("channel").distinct().withColumn("_present", F.lit(True))
    return wanted.join(present, "channel", "left").select("channel", F.coalesce("_present", F.lit(False)).alias("present"))


def required_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL counts of columns that must be filled, all from one scan."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "violations")


def data_gap(df: DataFrame, keys: Sequence[str], date_col: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Months without any row per key, from `first` to `last` (default: the first and last month of all data).

    Gaps and islands: the distinct months of each key are ordered, and each month emits the run of missing
    months before it (from the month after its predecessor, or from `first`); the last month of a key emits
    the run up to `last`. Rows made follow the gaps found, never keys x calendar; a key is never empty.
    """
    month = F.trunc(date_col, "MM")
    have = df.select(*keys, month.alias("month")).where(F.col("month").isNotNull()).distinct()
    if first is None or last is None:
        span = have.agg(F.min("month"), F.max("month")).first()
        if span[0] is None:
            return have.limit(0)
        first, last = first or str(span[0]), last or str(span[1])
    lo, hi = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    w = Window.partitionBy(*keys).orderBy("month")
    have = have.where(F.col("month").between(lo, hi))
    before_from = F.coalesce(F.add_months(F.lag("month").over(w), 1), lo)
    step = F.expr("interval 1 month")

    def run(start: Column, stop: Column) -> Column:
        return F.when(start <= stop, F.sequence(start, stop, step)).otherwise(F.array().cast("array<date>"))

    runs = have.select(
        *keys, run(before_from, F.add_months("month", -1)).alias("_before"),
        F.when(F.lead("month").over(w).isNull(), run(F.add_months("month", 1), hi)).otherwise(F.array().cast("array<date>")).alias("_after"))
    return runs.select(*keys, F.explode(F.concat("_before", "_after")).alias("month"))
