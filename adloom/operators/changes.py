"""Change ledger: baselines, overlapping windows, weekly checks and early breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from adloom.functions import scalars as S


def daily_touches(changes: DataFrame) -> DataFrame:
    return changes.groupBy("account_id", "changed_by", "change_date").agg(F.count(F.lit(1)).alias("touches"))


def trailing_baseline(series: DataFrame, days: int = 30) -> DataFrame:
    """Average of the `days` days before each date, per account and metric.

    series holds one row per account, metric and day, so a window spans a calendar, not raw rows.
    """
    w = (
        Window.partitionBy("account_id", "metric")
        .orderBy(F.unix_date("snapshot_date"))
        .rangeBetween(-days, -1)
    )
    exact = F.col("value").cast("decimal(20,6)")
    mean = F.sum(exact).over(w).cast("double") / F.nullif(F.count("value").over(w), F.lit(0))
    return series.withColumn("baseline", mean)


#: Stands for the missing close date of a window that is still open.
FOREVER = "9999-12-31"


def mark_overlaps(windows: DataFrame) -> DataFrame:
    """attribution_ambiguous = another window on the same account and metric shares a day.

    No pairs are formed. Openings and closings are counted per day, which combines map-side, and
    a running total over those days (a calendar, however many changes an account has) tells how
    many windows are active. A window is ambiguous when it is not alone on its first day, or when
    another one opens after that and before it closes. A window without a close date stays open for
    good; one without an opening date or a metric overlaps nothing that can be named.
    """
    group = ["account_id", "target_metric"]
    given = windows
    windows = windows.withColumn("window_closes", F.coalesce("window_closes", F.lit(FOREVER).cast("date")))
    one, none = F.lit(1), F.lit(0)
    opens = windows.select(*group, F.col("window_opens").alias("day"), one.alias("opened"), none.alias("closed"))
    closes = windows.select(*group, F.col("window_closes").alias("day"), none.alias("opened"), one.alias("closed"))
    per_day = opens.unionByName(closes).groupBy(*group, "day").agg(
        F.sum("opened").alias("opened"), F.sum("closed").alias("closed")
    )
    until = Window.partitionBy(*group).orderBy("day")
    before = until.rowsBetween(Window.unboundedPreceding, -1)
    curve = per_day.select(
        *group,
        "day",
        F.sum("opened").over(until.rowsBetween(Window.unboundedPreceding, 0)).alias("_opened"),
        F.coalesce(F.sum("closed").over(before), F.lit(0)).alias("_closed_before"),
    )
    first = curve.select(*group, F.col("day").alias("window_opens"), F.col("_opened").alias("_at_open"),
                         (F.col("_opened") - F.col("_closed_before")).alias("_active"))
    last = curve.select(*group, F.col("day").alias("window_closes"), F.col("_opened").alias("_at_close"))
    joined = windows.join(first, [*group, "window_opens"], "left").join(last, [*group, "window_closes"], "left")
    closes = F.nullif(F.col("window_closes"), F.lit(FOREVER).cast("date")).alias("window_closes")
    ambiguous = (F.col("_active") > 1) | (F.col("_at_close") > F.col("_at_open"))
    return joined.select(
        *[closes if c == "window_closes" else F.col(c) for c in given.columns],
        F.coalesce(ambiguous, F.lit(False)).alias("attribution_ambiguous"),
    )


def _signed(value: Column, baseline: Column) -> Column:
    return S.ratio(value - baseline, F.abs(baseline))


def change_window_check(checks: DataFrame, tolerance: float = 0.05, collateral: float = 0.10) -> DataFrame:
    """Target and guardrail against their baselines.

    checks: metric_value, baseline_value, expected_direction (up/down), guardrail_value,
    guardrail_baseline, guardrail_direction (direction that would be harmful).
    """
    moved = _signed(F.col("metric_value"), F.col("baseline_value"))
    good = F.when(F.col("expected_direction") == "down", -moved).otherwise(moved)
    side = _signed(F.col("guardrail_value"), F.col("guardrail_baseline"))
    harm = F.when(F.col("guardrail_direction") == "down", -side).otherwise(side)
    return checks.select(
        "*",
        moved.alias("vs_baseline"),
        side.alias("guardrail_vs_baseline"),
        F.when(moved.isNull(), F.lit(None).cast("string"))
        .when(good > tolerance, F.lit("on_track"))
        .when(good < -tolerance, F.lit("worse"))
        .otherwise(F.lit("drifting"))
        .alias("check_result"),
        F.when(F.coalesce(harm > collateral, F.lit(False)), F.lit("collateral_worse")).otherwise(F.lit("ok"))
        .alias("guardrail_result"),
    )


def as_of(points: DataFrame, series: DataFrame, key: str, at: str, on: str, carried: Sequence[str]) -> DataFrame:
    """points with the carried columns of the latest series row of their key at or before `at` (an as-of join).

    Points and series rows are put in one stream per key, ordered by date with series rows first on a tie, and
    the last series row is carried forward; no pair of point and series row is ever formed. Points without an
    earlier series row get nulls.
    """
    row = F.struct(*[F.col(c) for c in carried])
    pts = points.select("*", F.col(at).alias("_at"), F.lit(1).alias("_is_point"), F.lit(None).cast(
        StructType([StructField(c, series.schema[c].dataType) for c in carried])).alias("_row"))
    ser = series.select(F.col(key), F.col(on).alias("_at"), F.lit(0).alias("_is_point"), row.alias("_row"))
    both = pts.unionByName(ser, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_is_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried_row = F.last("_row", ignorenulls=True).over(w)
    out = both.withColumn("_last", carried_row).where(F.col("_is_point") == 1)
    return out.select(*points.columns, *[F.col("_last")[c].alias(c) for c in carried])


def weekly_checks(changes: DataFrame, series: DataFrame, every_days: int = 7) -> DataFrame:
    """Each change's own checks, every `every_days` from its window's opening to its close, against the
    account's latest value and baseline at each check (as-of lookup): change_id, account_id, check_date,
    target_metric, value, baseline."""
    days = F.sequence(F.col("window_opens"), F.col("window_closes"), F.expr(f"interval {every_days} days"))
    points = changes.where(F.col("window_opens") <= F.col("window_closes")).select(
        "change_id", "account_id", "target_metric", F.explode(days).alias("check_date"))
    return as_of(points, series, "account_id", "check_date", "snapshot_date", ["value", "baseline"])


def consecutive_breach(results: DataFrame, n: int = 2) -> DataFrame:
    """Windows in which either result was bad n checks in a row break open early."""
    w = Window.partitionBy("change_id").orderBy("check_date").rowsBetween(1 - n, 0)
    full = F.count(F.lit(1)).over(w) == n
    worse = full & (F.count_if(F.col("check_result") == "worse").over(w) == n)
    bled = full & (F.count_if(F.col("guardrail_result") == "collateral_worse").over(w) == n)
    return results.withColumn("_broke", worse | bled).groupBy("change_id").agg(
        F.bool_or("_broke").alias("broke_open_early"), F.min(F.when(F.col("_broke"), F.col("check_date"))).alias("broke_on")
    )
