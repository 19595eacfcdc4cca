"""Cost per lead: monthly spend against three lead definitions, and its trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from adloom.functions import scalars as S

LEAD_METRICS = ("total_calls", "unique_callers", "first_time")


def months_clamped(months: object, default: int = 6, ceiling: int = 24) -> int:
    try:
        n = int(months)
    except (TypeError, ValueError):
        return default
    return default if n < 1 else min(n, ceiling)


def window_start(as_of: Column, months: int) -> Column:
    """First day of the month `months - 1` back."""
    return F.trunc(F.add_months(as_of, 1 - months), "MM")


def managed_only(df: DataFrame, date_col: str = "date", start_col: str = "client_start_date") -> DataFrame:
    """Drop spend before the client was managed."""
    start = F.to_date(start_col)
    return df.filter(start.isNull() | (F.col(date_col) >= start))


def monthly_spend(spend: DataFrame, mapping: DataFrame, as_of: Column, months: int = 6) -> DataFrame:
    """Google Ads spend per month, customer id and client name.

    Aggregated to client and day before the mapping join, so the join and its shuffle see
    one row per client-day however the raw spend is skewed.
    """
    daily = (
        spend.filter((F.col("channel") == "google_ads") & (F.col("date") >= window_start(as_of, months)))
        .groupBy("client", "date")
        .agg(F.sum("actual").alias("actual"))
    )
    clients = mapping.filter(F.coalesce("google_ads_customer_id", F.lit("")) != "").select(
        F.col("client_name").alias("client"),
        F.col("google_ads_customer_id").alias("customer_id"),
        "client_start_date",
    )
    return (
        managed_only(daily.join(clients, "client"))
        .groupBy(S.month_key(F.col("date")).alias("month"), "customer_id", F.col("client").alias("client_name"))
        .agg(F.sum("actual").alias("spend"))
    )


def monthly_leads(attributed: DataFrame, as_of: Column, months: int = 6) -> DataFrame:
    """Three lead counts for paid Google calls per month and customer id.

    One row per caller first: the distinct count becomes a plain count and a hot account is
    spread over its callers before the final, small aggregation.
    """
    paid = attributed.filter(
        (F.col("channel") == "google_paid")
        & (F.col("call_date_local") >= window_start(as_of, months))
        & F.col("google_ads_customer_id").isNotNull()
    )
    per_caller = paid.groupBy(
        S.month_key(F.col("call_date_local")).alias("month"),
        F.col("google_ads_customer_id").cast("string").alias("customer_id"),
        "caller_hash",
    ).agg(
        F.min("client_name").alias("client_name"),
        F.count(F.lit(1)).alias("calls"),
        F.count_if("is_first_call").alias("first"),
    )
    return per_caller.groupBy("month", "customer_id").agg(
        F.min("client_name").alias("client_name"),
        F.sum("calls").alias("total_calls"),
        F.count(F.lit(1)).alias("unique_callers"),
        F.sum("first").alias("first_time"),
    )


def merge_spend_and_leads(spend: DataFrame, leads: DataFrame) -> DataFrame:
    """Full outer on (month, customer id), zeros for the missing side.

    Spend of several names under one id is summed; keeping only the last one seen would
    lose money and depend on row order.
    """
    spent = spend.groupBy("month", "customer_id").agg(
        F.min("client_name").alias("spend_client"), F.sum("spend").cast("double").alias("spend")
    )
    return spent.join(leads, ["month", "customer_id"], "full").select(
        "month",
        "customer_id",
        F.coalesce("spend_client", "client_name").alias("client_name"),
        F.coalesce("spend", F.lit(0.0)).alias("spend"),
        *[F.coalesce(m, F.lit(0)).cast("bigint").alias(m) for m in LEAD_METRICS],
    )


def cost_per_lead(
    spend: DataFrame, attributed: DataFrame, mapping: DataFrame, as_of: Column, months: int = 6
) -> DataFrame:
    return merge_spend_and_leads(
        monthly_spend(spend, mapping, as_of, months), monthly_leads(attributed, as_of, months)
    )


def cpl(metric: str = "first_time") -> Column:
    """NULL without leads; 0 when leads came for free."""
    return F.when(F.col(metric) > 0, F.col("spend") / F.col(metric).cast("double"))


def trend(current: Column, previous: Column, tolerance: float = 0.03) -> Column:
    """up / down / flat, NULL when a side is missing.

    A zero previous value follows float division: something over zero rises without bound,
    zero over zero is not a number and falls through to 'down'.
    """
    change = (current - previous) / F.nullif(previous, F.lit(0.0))
    return (
        F.when(current.isNull() | previous.isNull(), F.lit(None).cast("string"))
        .when(previous == 0, F.when(current > 0, F.lit("up")).otherwise(F.lit("down")))
        .when(F.abs(change) < tolerance, F.lit("flat"))
        .when(change > 0, F.lit("up"))
        .otherwise(F.lit("down"))
    )


def mom_trend(rows: DataFrame, metric: str = "first_time", tolerance: float = 0.03) -> DataFrame:
    """Each month against the client's previous available month."""
    w = Window.partitionBy("client_name").orderBy("month", "customer_id")
    return (
        rows.withColumn("cpl", cpl(metric))
        .withColumn("prev_cpl", F.lag("cpl").over(w))
        .withColumn("trend", trend(F.col("cpl"), F.col("prev_cpl"), tolerance))
    )


def latest_vs_previous(rows: DataFrame, metric: str = "first_time", tolerance: float = 0.03) -> DataFrame:
    """Latest month of the whole data set against the month before it, per active client.

    rows is read twice (once for the months); pass it materialized when it is expensive.
    """
    # the set of months is bounded by the calendar, so one small subquery serves both
    recent = rows.agg(F.slice(F.sort_array(F.collect_set("month"), asc=False), 1, 2)).scalar()
    marked = (
        rows.filter(F.array_contains(recent, F.col("month")) & (F.coalesce("client_name", F.lit("")) != ""))
        .withColumn("is_last", F.col("month") == F.element_at(recent, 1))
    )

    def value(column: str, last: bool) -> Column:
        # a client with several ids has the sum of them
        return F.sum(F.when(F.col("is_last") == last, F.col(column)))

    def price(spend: str, leads: str) -> Column:
        return F.when(F.col(leads) > 0, F.col(spend) / F.col(leads))

    money = F.col("spend").cast("decimal(38,9)")  # the same sum in any order
    sums = marked.withColumn("_money", money).groupBy("client_name").agg(
        value("_money", True).cast("double").alias("_spend"), value(metric, True).alias("_leads"),
        value("_money", False).cast("double").alias("_prev_spend"), value(metric, False).alias("_prev_leads"),
    )
    out = sums.select(
        "client_name",
        F.coalesce("_spend", F.lit(0.0)).alias("spend"),
        F.coalesce("_leads", F.lit(0)).alias("leads"),
        price("_spend", "_leads").alias("cpl"),
        price("_prev_spend", "_prev_leads").alias("prev_cpl"),
    )
    return out.filter((F.col("spend") > 0) | (F.col("leads") > 0)).withColumn(
        "trend", trend(F.col("cpl"), F.col("prev_cpl"), tolerance)
    )


def most_expensive_first(rows: DataFrame) -> DataFrame:
    """Highest cost per lead first, clients without leads last."""
    return rows.orderBy(F.desc_nulls_last("cpl"), "client_name")


def cpl_summary(rows: DataFrame) -> DataFrame:
    """Unweighted mean of client CPLs beside the totals."""
    return rows.agg(
        (F.sum(F.col("cpl").cast("decimal(38,9)")).cast("double") / F.nullif(F.count("cpl"), F.lit(0))).alias("avg_cpl"),
        F.coalesce(F.sum("leads"), F.lit(0)).alias("total_leads"),
        F.coalesce(F.sum(F.col("spend").cast("decimal(38,9)")).cast("double"), F.lit(0.0)).alias("total_spend"),
        F.count("cpl").alias("clients_with_cpl"),
    )


def months_present(rows: DataFrame) -> DataFrame:
    return rows.select("month").distinct().orderBy("month")
