"""Landed platform responses (JSON files) to typed rows of the maintained tables.

Pulling from the platforms is not part of this library; jobs read what was landed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from adloom.functions import scalars as S

# ---- fixed values: platform vocabularies ------------------------------------------------
ACTIVE_ACCOUNT = 1
NO_ACCESS = "NO_ACCESS"
REPORTED_APPROVALS = ["DISAPPROVED", "APPROVED_LIMITED"]
SOCIAL_CHANNEL = "meta"
DEFAULT_ZONE = "America/New_York"

INSIGHT_SCHEMA = "account_id string, campaign_name string, date_start string, spend string"
STATS_SCHEMA = (
    "billable_spend string, impressions bigint, clicks bigint, ctr double, cpc string, cpm string, "
    "total_conversions bigint, lead_conversions bigint"
)


def read_landed_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema; unreadable lines stay visible in _corrupt_record."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()[7:-1]
    return (
        spark.read.schema(f"{ddl}, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


# ---- social campaigns -----------------------------------------------------------------------
def filter_active_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.filter(F.col("account_status") == ACTIVE_ACCOUNT)


def read_campaign_spend_landed(insights: DataFrame, accounts: DataFrame, channel: str = SOCIAL_CHANNEL) -> DataFrame:
    """Campaign-day records of active accounts; a missing cost counts as zero."""
    active = filter_active_accounts(accounts).select("account_id", F.col("name").alias("account_name"))
    return insights.join(active, "account_id").select(
        "account_name",
        F.col("account_id").alias("customer_id"),
        F.col("campaign_name").alias("campaign"),
        F.to_date("date_start").alias("date"),
        F.coalesce(F.col("spend").cast(S.MONEY), F.lit(0).cast(S.MONEY)).alias("cost"),
        F.lit(channel).alias("channel"),
    )


def land_campaign_spend(
    spark: SparkSession, path: str, accounts: DataFrame, channel: str = SOCIAL_CHANNEL, name: str = "landed_spend",
) -> tuple[DataFrame, Observation]:
    """Landed JSON lines to typed campaign-day rows in one pass, with the pass's own counts.

    The observation reports `unreadable` (lines that are not a record of the schema), `unmatched` (readable
    records of no active account) and `kept` lines, and the `kept_cost`; none of them is read again to count.
    The counts are there once the returned rows have been written or otherwise computed whole; a task retried
    after a lost executor is counted once.
    """
    raw = read_landed_json(spark, path, INSIGHT_SCHEMA)
    active = filter_active_accounts(accounts).select("account_id", F.col("name").alias("account_name"))
    bad = F.col("_corrupt_record").isNotNull()
    joined = raw.join(active, "account_id", "left")
    cost = F.coalesce(F.col("spend").cast(S.MONEY), F.lit(0).cast(S.MONEY))
    seen = Observation(name)
    observed = joined.observe(
        seen,
        F.count(F.when(bad, 1)).alias("unreadable"),
        F.count(F.when(~bad & F.col("account_name").isNull(), 1)).alias("unmatched"),
        F.count(F.when(~bad & F.col("account_name").isNotNull(), 1)).alias("kept"),
        F.sum(F.when(~bad & F.col("account_name").isNotNull(), cost)).alias("kept_cost"),
    )
    rows = observed.where(~bad & F.col("account_name").isNotNull()).select(
        "account_name", F.col("account_id").alias("customer_id"), F.col("campaign_name").alias("campaign"),
        F.to_date("date_start").alias("date"), cost.alias("cost"), F.lit(channel).alias("channel"))
    return rows, seen


# ---- local advertisers ------------------------------------------------------------------------
def filter_advertiser_access(advertisers: DataFrame, override_ids: Sequence[str] | None = None) -> DataFrame:
    """An explicit id list wins over the role filter."""
    if override_ids:
        return advertisers.filter(F.col("advertiser_id").isin(list(override_ids)))
    return advertisers.filter(F.coalesce(F.col("role"), F.lit("")) != NO_ACCESS)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint")


def read_advertiser_stats_landed(stats: DataFrame, advertisers: DataFrame) -> DataFrame:
    """Typed rows: counts default to zero, rates and prices stay NULL."""
    profile = advertisers.select(
        "advertiser_id", F.col("name").alias("advertiser_name"), F.col("currency").alias("currency_code")
    )
    return stats.join(profile, "advertiser_id", "left").select(
        F.to_date("report_date").alias("report_date"),
        "advertiser_id",
        "advertiser_name",
        "currency_code",
        S.parse_money(F.col("billable_spend")).alias("billable_spend"),
        _zero("impressions").alias("impressions"),
        _zero("clicks").alias("clicks"),
        F.col("ctr").cast("double").alias("ctr"),
        S.parse_money(F.col("cpc")).alias("cpc"),
        S.parse_money(F.col("cpm")).alias("cpm"),
        _zero("total_conversions").alias("total_conversions"),
        _zero("lead_conversions").alias("lead_conversions"),
    )


def active_days(rows: DataFrame) -> DataFrame:
    """Account-days with spend, impressions or clicks."""
    spend = F.coalesce("billable_spend", F.lit(0).cast(S.MONEY))
    return rows.filter((spend > 0) | (_zero("impressions") > 0) | (_zero("clicks") > 0))


def target_dates(
    accounts: DataFrame, now: Column, zones: DataFrame, lookback: int, start: Column | None = None,
    end: Column | None = None, default_zone: str = DEFAULT_ZONE,
) -> DataFrame:
    """Days to pull per account: an explicit range, or `lookback` days ending yesterday local time.

    zones lists the valid zone names; a missing or unknown zone falls back to the default.
    """
    known = zones.select(F.col("zone").alias("timezone"), F.col("zone").alias("_zone"))
    rows = accounts.join(known, "timezone", "left").withColumn("_zone", F.coalesce("_zone", F.lit(default_zone)))
    if start is not None and end is not None:
        first, last = start, end
    else:
        last = F.date_sub(S.local_date(now, F.col("_zone")), 1)
        first = F.date_sub(last, lookback - 1)
    days = F.when(first <= last, F.sequence(first, last))
    return rows.select("advertiser_id", F.col("_zone").alias("timezone"), F.explode(days).alias("report_date"))


# ---- search ads health ----------------------------------------------------------------------
def list_child_accounts(accounts: DataFrame) -> DataFrame:
    """Enabled accounts that are not managers."""
    return accounts.filter(~F.col("manager") & (F.col("status") == "ENABLED")).select(
        F.col("id").cast("string").alias("customer_id"), F.coalesce("descriptive_name", F.lit("")).alias("descriptive_name")
    )


def read_ad_policy_landed(records: DataFrame, snapshot: Column) -> DataFrame:
    """Limited or disapproved ads of enabled campaigns; topics become a comma list, none is NULL."""
    topics = F.transform("topics", lambda t: F.coalesce(t, F.lit("")))
    return records.filter(
        F.col("approval_status").isin(REPORTED_APPROVALS) & (F.col("campaign_status") == "ENABLED")
    ).select(
        snapshot.alias("snapshot_date"),
        *[F.col(c).cast("string").alias(c) for c in ("customer_id", "campaign_id")],
        "campaign_name",
        *[F.col(c).cast("string").alias(c) for c in ("ad_group_id", "ad_id")],
        "approval_status",
        "review_status",
        F.when(F.size(F.coalesce("topics", F.array().cast("array<string>"))) > 0, F.array_join(topics, ","))
        .alias("policy_topics"),
    )


def read_call_assets_landed(records: DataFrame, snapshot: Column) -> DataFrame:
    return records.filter(F.col("asset_type") == "CALL").select(
        snapshot.alias("snapshot_date"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("asset_id").cast("string").alias("asset_id"),
        F.nullif(F.col("phone_number"), F.lit("")).alias("phone_number"),
        "approval_status",
    )


def read_billing_landed(accounts: DataFrame, setups: DataFrame, budgets: DataFrame, snapshot: Column) -> DataFrame:
    """One row per account with its first billing-setup and account-budget status by id."""
    def first(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy("customer_id").agg(F.min_by("status", "id").alias(out))

    return (
        accounts.select("customer_id")
        .join(first(setups, "billing_setup_status"), "customer_id", "left")
        .join(first(budgets, "account_budget_status"), "customer_id", "left")
        .select(snapshot.alias("snapshot_date"), "customer_id", "billing_setup_status", "account_budget_status")
    )
