"""Campaign-health detectors on one shared contract, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from adloom.functions import labels as L, scalars as S


def text(parts: tuple[str, ...], *values: Column) -> Column:
    """Interleave fixed fragments and values; a NULL value makes the whole text NULL."""
    out = []
    for i, part in enumerate(parts):
        out.append(F.lit(part))
        if i < len(values):
            out.append(values[i].cast("string"))
    return F.concat(*out)


def latest_partition(df: DataFrame, data_date: str = "_DATA_DATE", latest_date: str = "_LATEST_DATE") -> DataFrame:
    return df.filter(F.col(data_date) == F.col(latest_date))


def latest_snapshot(df: DataFrame, date_col: str = "snapshot_date", calendar: DataFrame | None = None) -> DataFrame:
    """Rows of the newest snapshot.

    A day on which a loader wrote nothing leaves the previous day's rows current. Pass the
    calendar of load days to have such a day count as an empty snapshot instead.
    """
    newest = (df if calendar is None else calendar).agg(F.max(date_col)).scalar()
    return df.filter(F.col(date_col) == newest)


def enabled_not_local(campaigns: DataFrame) -> DataFrame:
    """A missing channel type drops out too."""
    return campaigns.filter(
        (F.col("campaign_status") == "ENABLED") & (F.col("campaign_advertising_channel_type") != "LOCAL_SERVICES")
    )


def not_ok(col: Column) -> Column:
    return F.coalesce(col.isNotNull() & ~col.isin(L.OK_BILLING_STATUSES), F.lit(False))


def with_mapping(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Left join on the id as text. No join hint: the optimizer broadcasts the mapping while
    its measured size is below the threshold and falls back to a skew-aware sort-merge join."""
    client = mapping.select(
        F.col("google_ads_customer_id").alias("customer_id"),
        "client_name", "account_manager", "tier", "sub_mcc", "av_status",
    )
    return df.withColumn("customer_id", F.col("customer_id").cast("string")).join(client, "customer_id", "left")


def _contract(df: DataFrame, alert_type: str, severity: str, source: str, entity_id: Column, entity_name: Column,
              detail: Column, now: Column) -> DataFrame:
    return df.select(
        F.lit(alert_type).alias("alert_type"),
        F.lit(severity).alias("severity"),
        F.lit(source).alias("source"),
        "customer_id", "client_name", "account_manager", "tier", "sub_mcc", "av_status",
        entity_id.cast("string").alias("entity_id"),
        entity_name.alias("entity_name"),
        detail.alias("detail"),
        now.alias("detected_at"),
    )


def campaign_suspended(campaigns: DataFrame, mapping: DataFrame, now: Column) -> DataFrame:
    rows = enabled_not_local(latest_partition(campaigns)).filter(F.col("campaign_serving_status") == "SUSPENDED")
    name = F.col("campaign_name")
    return _contract(
        with_mapping(rows, mapping), "campaign_suspended", "P0", "data_transfer",
        F.col("campaign_id"), name, text(L.SUSPENDED_TEXT, name), now,
    )


def disapproved_per_campaign(ads: DataFrame) -> DataFrame:
    rows = latest_partition(ads).filter(F.col("ad_group_ad_policy_summary_approval_status") == "DISAPPROVED")
    return rows.groupBy("customer_id", "campaign_id").agg(F.count(F.lit(1)).alias("disapproved_count"))


def ads_disapproved(campaigns: DataFrame, ads: DataFrame, mapping: DataFrame, now: Column) -> DataFrame:
    enabled = enabled_not_local(latest_partition(campaigns)).select("customer_id", "campaign_id", "campaign_name")
    rows = disapproved_per_campaign(ads).join(enabled, ["customer_id", "campaign_id"])
    name = F.col("campaign_name")
    count = F.col("disapproved_count").cast("string")
    detail = F.concat(count, text(L.DISAPPROVED_TEXT, name))
    return _contract(
        with_mapping(rows, mapping), "ads_disapproved", "P0", "data_transfer", F.col("campaign_id"), name, detail, now
    )


def overspend(pacing: DataFrame, mapping: DataFrame, now: Column) -> DataFrame:
    rows = pacing.filter(F.col("status") == "Overpacing")
    detail = text(
        L.OVERSPEND_TEXT,
        F.col("account_name"),
        F.col("platform"),
        S.whole_text(F.col("pacing_ratio") * 100),
        S.whole_text(F.col("forecast_eom")),
        S.whole_text(F.col("budget")),
    )
    return _contract(
        with_mapping(rows, mapping), "overspend", "P1", "pacing", F.col("customer_id"), F.col("account_name"), detail, now
    )


def overspend_forecast(pacing: DataFrame, as_of: Column, factor: float = 1.10) -> DataFrame:
    """Linear projection of month-to-date spend above the commitment times the factor."""
    projected = F.col("spent_mtd") / F.dayofmonth(as_of) * F.dayofmonth(F.last_day(as_of))
    return pacing.withColumn("projected_eom", projected).filter(F.col("projected_eom") > F.col("committed") * factor)


def spend_status(spend: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Last day with spend and total per account and platform over the window."""
    return (
        spend.filter(S.since(F.col("spend_date"), as_of, days))
        .groupBy("customer_id", "platform")
        .agg(
            F.max(F.when(F.col("spend") > 0, F.col("spend_date"))).alias("last_spend_date"),
            F.sum("spend").alias("spend_30d"),
        )
    )


def no_spend(
    spend: DataFrame, mapping: DataFrame, as_of: Column, now: Column, silent: int = 3, fade: int = 6
) -> DataFrame:
    """Spent inside the window, silent since; without AV approval the alert fades."""
    scored = (
        spend_status(spend, as_of)
        .filter(F.col("last_spend_date").isNotNull())
        .withColumn("days_since_spend", F.datediff(as_of, "last_spend_date"))
        .filter(F.col("days_since_spend") >= silent)
    )
    rows = with_mapping(scored, mapping).filter(
        (F.col("av_status") == L.AV_APPROVED) | (F.col("days_since_spend") <= fade)
    )
    detail = text(
        L.NO_SPEND_TEXT,
        F.coalesce("client_name", "customer_id"),
        F.col("platform"),
        F.col("last_spend_date"),
        F.col("days_since_spend"),
    )
    return _contract(
        rows, "no_spend", "P1", "spend_combined", F.col("customer_id"), F.col("client_name"), detail, now
    )


def url_problems(policy: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Ads with destination problems per campaign and the sorted distinct reasons.

    An ad with both topics counts as 'not working' only. At most two reasons exist, so the
    collected set has a fixed bound.
    """
    topics = F.col("policy_topics")
    reason = F.when(topics.rlike("DESTINATION_NOT_WORKING"), F.lit("URL not working")).when(
        topics.rlike("DESTINATION_NOT_ACCESSIBLE"), F.lit("URL not accessible")
    )
    rows = latest_snapshot(policy, calendar=calendar).filter(
        (F.col("approval_status") == "DISAPPROVED") & topics.rlike(L.URL_TOPICS)
    )
    return rows.groupBy("customer_id", "campaign_id").agg(
        F.min("campaign_name").alias("campaign_name"),
        F.count(F.lit(1)).alias("ad_count"),
        F.array_join(F.sort_array(F.collect_set(reason)), ", ").alias("url_reason"),
    )


def url_disapproved(policy: DataFrame, mapping: DataFrame, now: Column, calendar: DataFrame | None = None) -> DataFrame:
    name = F.col("campaign_name")
    detail = F.concat(F.col("ad_count").cast("string"), text(L.URL_TEXT, F.col("url_reason"), name))
    return _contract(
        with_mapping(url_problems(policy, calendar), mapping), "url_disapproved", "P0", "google_ads_api",
        F.col("campaign_id"), name, detail, now,
    )


def phone_disapproved(assets: DataFrame, mapping: DataFrame, now: Column, calendar: DataFrame | None = None) -> DataFrame:
    rows = latest_snapshot(assets, calendar=calendar).filter(F.col("approval_status") == "DISAPPROVED")
    phone = F.coalesce("phone_number", F.concat(F.lit("(call asset "), F.col("asset_id"), F.lit(")")))
    return _contract(
        with_mapping(rows, mapping), "phone_disapproved", "P0", "google_ads_api",
        F.col("asset_id"), F.coalesce("client_name", "customer_id"), text(L.PHONE_TEXT, phone), now,
    )


def billing_problem(billing: DataFrame, mapping: DataFrame, now: Column, calendar: DataFrame | None = None) -> DataFrame:
    setup, budget = F.col("billing_setup_status"), F.col("account_budget_status")
    rows = latest_snapshot(billing, calendar=calendar).filter(not_ok(setup) | not_ok(budget))
    detail = text(L.BILLING_TEXT, F.coalesce(setup, F.lit("unknown")), F.coalesce(budget, F.lit("unknown")))
    return _contract(
        with_mapping(rows, mapping), "billing_problem", "P0", "google_ads_api",
        F.col("customer_id"), F.coalesce("client_name", "customer_id"), detail, now,
    )


def alerts_active(*detectors: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.select(*L.ALERT_COLUMNS) for d in detectors])
