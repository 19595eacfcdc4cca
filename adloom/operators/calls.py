"""Call dashboard: daily and hour-of-week aggregates, cards, matrices and the ads table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adloom.functions import labels as L, scalars as S
from adloom.functions.keyed import share_of_max

FEED_DAYS = 100


def dashboard_channel(col: Column, channel_of: Mapping[str, str] = L.CALL_CHANNEL_OF) -> Column:
    return S.label_of(col, channel_of, default=F.lit("Other"))


def calls_daily(attributed: DataFrame, channel_of: Mapping[str, str] = L.CALL_CHANNEL_OF) -> DataFrame:
    """Calls per client, dashboard channel and UTC day; everything not answered is missed."""
    return (
        attributed.groupBy(
            F.to_date("called_at_utc").alias("call_date"),
            "client_name",
            dashboard_channel(F.col("channel"), channel_of).alias("channel"),
        )
        .agg(
            F.count(F.lit(1)).alias("total_calls"),
            F.count_if(~F.col("is_answered")).alias("missed_calls"),
            F.count_if("is_answered").alias("answered_calls"),
        )
    )


def calls_heatmap(attributed: DataFrame) -> DataFrame:
    return attributed.groupBy(
        "client_name",
        F.dayofweek("called_at_utc").alias("day_of_week_sun1"),
        F.hour("called_at_utc").alias("hour_of_day"),
    ).agg(F.count(F.lit(1)).alias("total_calls"), F.count_if(~F.col("is_answered")).alias("missed_calls"))


def window_feed(df: DataFrame, date_col: str, as_of: Column, days: int = FEED_DAYS, client: str | None = None) -> DataFrame:
    """Trailing cut used by the feed (100 days) and the 30/60/90-day buttons."""
    out = df.filter(S.since(F.col(date_col), as_of, days))
    return out if client is None else out.filter(F.col("client_name") == client)


def ads_daily(spend: DataFrame) -> DataFrame:
    return spend.filter(F.col("channel") == "google_ads").select(
        "date",
        F.col("client").alias("client_name"),
        F.lit("Google Ads").alias("channel"),
        F.col("actual").alias("spend_usd"),
    )


def client_universe(daily: DataFrame, ads: DataFrame) -> DataFrame:
    names = daily.select("client_name").distinct().union(ads.select("client_name").distinct()).distinct()
    return names.filter(F.coalesce("client_name", F.lit("")) != "").orderBy("client_name")


def call_cards(daily: DataFrame, ads: DataFrame) -> DataFrame:
    calls = daily.agg(
        F.coalesce(F.sum("total_calls"), F.lit(0)).alias("total_calls"),
        F.coalesce(F.sum("missed_calls"), F.lit(0)).alias("missed_calls"),
        F.coalesce(F.sum("answered_calls"), F.lit(0)).alias("answered_calls"),
        F.coalesce(F.sum(F.when(F.col("channel") == "Google Ads", F.col("total_calls"))), F.lit(0)).alias("google_calls"),
    )
    spend = ads.agg(F.coalesce(F.sum("spend_usd").cast("double"), F.lit(0.0)).alias("spend_usd")).scalar()
    return calls.withColumn("spend_usd", spend).select(
        "*",
        (S.ratio(F.col("missed_calls"), F.col("total_calls")) * 100).alias("miss_rate"),
        (S.ratio(F.col("answered_calls"), F.col("total_calls")) * 100).alias("answer_rate"),
        S.ratio(F.col("spend_usd"), F.col("google_calls")).alias("cost_per_google_call"),
    )


def _per_channel(daily: DataFrame) -> DataFrame:
    return daily.groupBy("channel").agg(
        F.sum("total_calls").alias("total_calls"),
        F.sum("missed_calls").alias("missed_calls"),
        F.sum("answered_calls").alias("answered_calls"),
    )


def calls_by_channel(daily: DataFrame, order: Sequence[str] = L.CALL_CHANNELS) -> DataFrame:
    """Listed channels only, in the fixed order (unlisted ones count in the cards only)."""
    rank = S.rank_in(F.col("channel"), order)
    return _per_channel(daily).withColumn("position", rank).filter(F.col("position") < 999).orderBy("position")


def missed_by_channel(daily: DataFrame, order: Sequence[str] = L.CALL_CHANNELS) -> DataFrame:
    return calls_by_channel(daily, order).orderBy(F.desc("missed_calls"), "position")


def calls_by_day_channel(daily: DataFrame, order: Sequence[str] = L.CALL_CHANNELS) -> DataFrame:
    return (
        daily.groupBy("call_date").pivot("channel", list(order)).agg(F.sum("total_calls")).fillna(0, subset=list(order))
    )


def ads_per_day(daily: DataFrame, ads: DataFrame) -> DataFrame:
    """Google Ads calls and spend per day, full outer, zeros for the missing side."""
    calls = (
        daily.filter(F.col("channel") == "Google Ads")
        .groupBy(F.col("call_date").alias("date"))
        .agg(F.sum("total_calls").alias("calls"))
    )
    spend = ads.groupBy("date").agg(F.sum("spend_usd").cast("decimal(30,4)").alias("spend"))
    return calls.join(spend, "date", "full").select(
        "date",
        F.coalesce("calls", F.lit(0)).alias("calls"),
        F.coalesce("spend", F.lit(0).cast("decimal(30,4)")).alias("spend"),
    )


def ads_daily_table(daily: DataFrame, ads: DataFrame) -> DataFrame:
    """Newest day first and one Total row (date NULL) at the end."""
    return (
        ads_per_day(daily, ads)
        .rollup("date")
        .agg(F.sum("calls").alias("calls"), F.sum("spend").cast("double").alias("spend"))
        .select("date", "calls", "spend", S.ratio(F.col("spend"), F.col("calls")).alias("cost_per_call"))
        .orderBy(F.desc_nulls_last("date"))
    )


def hour_label(col: Column) -> Column:
    twelve = F.when(col % 12 == 0, F.lit(12)).otherwise(col % 12).cast("string")
    return F.concat(twelve, F.when(col < 12, F.lit("a")).otherwise(F.lit("p")))


def day_label(col: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in L.DAY_LABELS]), col.cast("int"))


def dow_hour_grid(heat: DataFrame) -> DataFrame:
    """All 7x24 cells, zero-filled, with intensity = count / busiest cell."""
    spark = heat.sparkSession
    cells = spark.range(7 * 24).select(
        (F.floor(F.col("id") / 24) + 1).cast("int").alias("day_of_week_sun1"),
        (F.col("id") % 24).cast("int").alias("hour_of_day"),
    )
    counts = heat.groupBy("day_of_week_sun1", "hour_of_day").agg(F.sum("total_calls").alias("total_calls"))
    grid = cells.join(counts, ["day_of_week_sun1", "hour_of_day"], "left").fillna(0, subset=["total_calls"])
    return share_of_max(grid, "total_calls", "intensity").select(
        "day_of_week_sun1",
        "hour_of_day",
        day_label(F.col("day_of_week_sun1")).alias("day_label"),
        hour_label(F.col("hour_of_day")).alias("hour_label"),
        "total_calls",
        "intensity",
    )


def call_dashboard(
    daily: DataFrame, heat: DataFrame, spend: DataFrame, as_of: Column, days: int = FEED_DAYS
) -> dict[str, DataFrame]:
    """The four blocks of the call page; the hour-of-week block is never date-filtered."""
    calls = window_feed(daily, "call_date", as_of, days)
    ads = window_feed(ads_daily(spend), "date", as_of, days)
    return {"clients": client_universe(calls, ads), "calls_daily": calls, "calls_heatmap": heat, "ads_daily": ads}
