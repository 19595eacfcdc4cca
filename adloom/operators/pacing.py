"""Committed against actual: month and year pacing, rollover, targets and capture status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from adloom.functions import labels as L, scalars as S

CELL = ["client", "channel", "year", "month"]


def coerce_pacing_rows(df: DataFrame) -> DataFrame:
    """Text rows to typed columns; unreadable amounts count as zero."""
    return df.select(
        F.col("client").cast("string").alias("client"),
        F.col("channel").cast("string").alias("channel"),
        F.col("year").try_cast("int").alias("year"),
        F.col("month").try_cast("int").alias("month"),
        S.number_or_zero(F.col("committed")).alias("committed"),
        S.number_or_zero(F.col("actual")).alias("actual"),
    )


def committed_by_month(committed: DataFrame) -> DataFrame:
    return committed.groupBy(*CELL).agg(F.sum("amount").alias("committed"))


def pacing_api(committed: DataFrame, actual: DataFrame, year: int | None) -> DataFrame:
    """Full outer on the cell, zeros filled; both sides are filtered to the year before joining."""
    if year is not None:
        committed = committed.filter(F.col("year") == year)
        actual = actual.filter(F.col("year") == year)
    return (
        committed_by_month(committed)
        .join(actual, CELL, "full")
        .select(
            *CELL,
            F.coalesce("committed", F.lit(0)).cast("double").alias("committed"),
            F.coalesce("actual", F.lit(0)).cast("double").alias("actual"),
        )
    )


def _exact(col: str) -> Column:
    """Sums must not depend on row order."""
    return F.col(col).cast("decimal(18,4)")


def _sum(col: str, condition: Column | None = None) -> Column:
    value = _exact(col) if condition is None else F.when(condition, _exact(col))
    return F.coalesce(F.sum(value).cast("double"), F.lit(0.0))


def month_pacing(pacing: DataFrame, month: int) -> DataFrame:
    """Every client, also those with nothing this month. pct is 0 without a commitment, so
    unbudgeted spend reads as underspending; `unbudgeted` makes that visible."""
    now = F.col("month") == month
    out = pacing.groupBy("client").agg(_sum("committed", now).alias("committed"), _sum("actual", now).alias("actual"))
    return out.select(
        "*",
        (F.col("actual") - F.col("committed")).alias("variance"),
        S.ratio_or_zero(F.col("actual"), F.col("committed")).alias("pct"),
        ((F.col("committed") == 0) & (F.col("actual") > 0)).alias("unbudgeted"),
    )


def year_pacing(pacing: DataFrame, as_of_month: int) -> DataFrame:
    so_far = F.col("month") <= as_of_month
    out = pacing.groupBy("client").agg(
        _sum("committed").alias("full_year_committed"),
        _sum("committed", so_far).alias("committed_ytd"),
        _sum("actual", so_far).alias("spent_ytd"),
    )
    return out.select(
        "*",
        (F.col("spent_ytd") - F.col("committed_ytd")).alias("ytd_variance"),
        S.ratio_or_zero(F.col("spent_ytd"), F.col("committed_ytd")).alias("ytd_pct"),
        (F.col("full_year_committed") - F.col("spent_ytd")).alias("remaining"),
    )


def exclude_client_paid(pacing: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Channels the client pays directly stay out of the verdict."""
    return pacing.join(exceptions.select("client", "channel"), ["client", "channel"], "left_anti")


def managed_months(pacing: DataFrame, starts: DataFrame) -> DataFrame:
    """Keep months from the client's first managed month on (no entry: the whole year)."""
    first = starts.select("client", F.col("start_month").alias("_start"))
    return pacing.join(first, "client", "left").filter(F.col("month") >= F.coalesce("_start", F.lit(1))).drop("_start")


def year_pacing_managed(pacing: DataFrame, starts: DataFrame, exceptions: DataFrame, as_of_month: int) -> DataFrame:
    return year_pacing(managed_months(exclude_client_paid(pacing, exceptions), starts), as_of_month)


def status_actual(pacing: DataFrame, exceptions: DataFrame, month: int | None = None) -> DataFrame:
    rows = pacing if month is None else pacing.filter(F.col("month") == month)
    return exclude_client_paid(rows, exceptions).groupBy("client").agg(_sum("actual").alias("actual"))


def channel_breakdown(pacing: DataFrame, month: int, client: str | None = None) -> DataFrame:
    rows = pacing.filter(F.col("month") == month)
    if client is not None:
        rows = rows.filter(F.col("client") == client)
    out = rows.groupBy("client", "channel").agg(_sum("committed").alias("committed"), _sum("actual").alias("actual"))
    return out.withColumn("variance", F.col("actual") - F.col("committed")).withColumn(
        "channel_label", S.label_of(F.col("channel"), L.CHANNEL_LABELS)
    )


def pacing_status(pct: Column, low: float = 0.92, high: float = 1.08) -> Column:
    return (
        F.when(pct > high, F.lit("Overspending")).when(pct < low, F.lit("Underspending")).otherwise(F.lit("On track"))
    )


def year_status(pct: Column, low: float = 0.95, high: float = 1.05) -> Column:
    return F.when(pct > high, F.lit("over")).when(pct < low, F.lit("under")).otherwise(F.lit("on"))


def pacing_overview(pacing: DataFrame, month: int) -> DataFrame:
    per_client = month_pacing(pacing, month)
    out = per_client.agg(
        _sum("committed").alias("committed"),
        _sum("actual").alias("actual"),
        F.count_if(F.col("pct").between(0.92, 1.08)).alias("on_track"),
        F.count(F.lit(1)).alias("clients"),
    )
    return out.withColumn("variance", F.col("actual") - F.col("committed"))


def pacing_context(pacing: DataFrame, month: int) -> DataFrame:
    """Rounded nested document per client: the month, its channels and the year."""
    whole = lambda c: F.round(F.col(c)).cast("bigint")
    channels = (
        channel_breakdown(pacing, month)
        .groupBy("client")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("channel", *[whole(c).alias(c) for c in ("committed", "actual", "variance")])
                )
            ).alias("channels")
        )
    )
    year = year_pacing(pacing, month).select(
        "client",
        F.struct(
            whole("committed_ytd").alias("committed_to_date"),
            whole("spent_ytd").alias("spent_to_date"),
            whole("ytd_variance").alias("ytd_variance"),
            whole("full_year_committed").alias("full_year_committed"),
            whole("remaining").alias("remaining_pool"),
        ).alias("year"),
    )
    no_channels = F.array().cast(channels.schema["channels"].dataType)
    return (
        month_pacing(pacing, month)
        .join(channels, "client", "left")
        .join(year, "client")
        .select(
            "client",
            whole("committed").alias("committed_month"),
            whole("actual").alias("actual_month"),
            whole("variance").alias("variance_month"),
            F.round("pct", 3).alias("pacing_pct_month"),
            F.coalesce("channels", no_channels).alias("channels"),
            "year",
        )
    )


# ---- rollover and targets ---------------------------------------------------------------
def rollover(base: DataFrame, actual: DataFrame) -> DataFrame:
    """available = base + running (base - actual) of the earlier months of the same year.

    Both sides are aggregated to one row per cell first, so a window holds at most twelve rows
    and a month without a row simply adds nothing.
    """
    money = "decimal(28,4)"
    planned = base.groupBy(*CELL).agg(F.sum("base_amount").cast(money).alias("base"))
    spent = actual.groupBy(*CELL).agg(F.sum("actual").cast(money).alias("actual"))
    zero = F.lit(0).cast(money)
    cells = planned.join(spent, CELL, "full").select(
        *CELL, F.coalesce("base", zero).alias("base"), F.coalesce("actual", zero).alias("actual")
    )
    earlier = (
        Window.partitionBy("client", "channel", "year")
        .orderBy("month")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    left = F.coalesce(F.sum(F.col("base") - F.col("actual")).over(earlier), zero)
    return cells.withColumn("rollover_in", left).withColumn("available", F.col("base") + F.col("rollover_in"))


def month_dims(as_of: Column) -> dict[str, Column]:
    """Days of the month, elapsed (today included) and remaining (today excluded)."""
    length = F.dayofmonth(F.last_day(as_of))
    elapsed = F.dayofmonth(as_of)
    return {"days_in_month": length, "days_elapsed": elapsed, "days_remaining": length - elapsed}


def pacing_live(
    base: DataFrame,
    actual: DataFrame,
    mtd: DataFrame,
    crosswalk: DataFrame,
    now: Column,
    year: int,
    zone: str = "America/Chicago",
) -> DataFrame:
    """Pacing rows with manager and group, month-to-date spend and the local month's dimensions."""
    committed = base.select(*CELL, F.col("base_amount").alias("amount"))
    owners = (
        crosswalk.filter("active")
        .groupBy(F.col("canonical_client").alias("client"))
        .agg(F.min("account_manager").alias("account_manager"), F.min("source_group").alias("source_group"))
    )
    today = S.local_date(now, zone)
    out = pacing_api(committed, actual, year).join(owners, "client", "left").join(mtd, ["client", "channel"], "left")
    current = (F.col("month") == F.month(today)) & (F.col("year") == F.year(today))
    return out.select(
        *CELL,
        "committed",
        "actual",
        "account_manager",
        "source_group",
        F.when(current, F.coalesce("spent_mtd", F.lit(0)).cast("double")).alias("spent_mtd"),
        *[dim.alias(name) for name, dim in month_dims(today).items()],
    )


def target_with_catchup(pacing: DataFrame, catchup: str = "catchup") -> DataFrame:
    """target = committed + the channel's share of the client's catch-up, by committed weight.

    The catch-up amount is an input per client and month; status compares with the target.
    """
    client_month = Window.partitionBy("client", "year", "month")
    out = pacing.withColumns({
        "_committed": F.sum(_exact("committed")).over(client_month).cast("double"),
        "_actual": F.sum(_exact("actual")).over(client_month).cast("double"),
    })
    share = S.ratio_or_zero(F.col("committed"), F.col("_committed"))
    return out.select(
        *pacing.columns,
        (F.col(catchup) * share).alias("channel_catchup"),
        (F.col("committed") + F.col(catchup) * share).alias("target"),
        (F.col("_committed") + F.col(catchup)).alias("client_target"),
        pacing_status(S.ratio_or_zero(F.col("_actual"), F.col("_committed") + F.col(catchup))).alias("status"),
    )


def daily_recommendation(target: Column, spent: Column, days_remaining: Column) -> Column:
    """Today can still be spent, hence the extra day."""
    return (target - spent) / (days_remaining + 1)


def capture_status(df: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Data presence, pacing and capture accuracy as separate axes.

    Input: reported (by the manager), captured (in the warehouse), data_available.
    """
    reported, captured = F.col("reported"), F.col("captured")
    gap = F.abs(captured - reported) / F.nullif(reported, F.lit(0.0))
    status = (
        F.when((reported == 0) & (captured == 0), F.lit(L.CAPTURE_PAUSED))
        .when(~F.col("data_available"), F.lit(L.CAPTURE_GAP))
        .when((captured == 0) & (reported > 0), F.lit(L.CAPTURE_OVER_REPORTED))
        .when((reported == 0) & (captured > 0), F.lit(L.CAPTURE_UNDER_REPORTED))
        .when(gap > tolerance, F.lit(L.CAPTURE_MISMATCH))
        .otherwise(F.lit(L.CAPTURE_MATCH))
    )
    severity = S.label_of(F.col("capture_status"), L.CAPTURE_SEVERITY)
    return (
        df.withColumn("capture_status", status)
        .withColumn("severity", severity)
        .withColumn("capture_accuracy_ratio", S.ratio(captured, reported))
    )
