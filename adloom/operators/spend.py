"""Spend products: five channel feeds, crosswalk names, trailing sums and month totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from adloom.functions import scalars as S

FEED_COLUMNS = ["customer_id", "account_name", "channel", "date", "spend"]
# channels with a feed of their own; the sheet of other channels must not repeat them
SERVED_ELSEWHERE = ("google_ads", "lsa", "meta", "nextdoor")


def spend_trailing(spend: DataFrame, as_of: Column, days: int = 90, platform: str = "google") -> DataFrame:
    """Spend per account for one platform over the trailing window."""
    return (
        spend.filter((F.lower("platform") == platform) & S.since(F.col("spend_date"), as_of, days))
        .groupBy(F.col("customer_id").try_cast("bigint").alias("cid"))
        .agg(F.sum("spend").alias(f"spend_{days}d"))
    )


def conversions_trailing(stats: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Conversions per account; the source has several rows per account and day."""
    return (
        stats.filter(S.since(F.col("segments_date"), as_of, days))
        .groupBy(F.col("customer_id").alias("cid"))
        .agg(F.sum("metrics_conversions").alias(f"conversions_{days}d"))
    )


def spend_union(feeds: Mapping[str, DataFrame], served_elsewhere: Sequence[str] = SERVED_ELSEWHERE) -> DataFrame:
    """UNION ALL of the channel feeds.

    The feed named 'other' carries its own channel column and drops channels that have a
    feed of their own (count what it drops with quality.suppressed_rows).
    """
    parts = []
    for name, feed in feeds.items():
        if name == "other":
            part = feed.filter(~F.lower("channel").isin(list(served_elsewhere)))
            part = part.withColumn("channel", F.lower("channel"))
        else:
            part = feed.withColumn("channel", F.lit(name))
        parts.append(part.select(*FEED_COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def resolve_client(df: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Canonical client by account id; anything unknown stays visible as UNMAPPED.

    An id may stand under several channels: then each channel's spend takes that channel's client, and
    a channel the crosswalk does not list takes the smallest, so that no row is doubled.
    """
    any_channel = crosswalk.groupBy("customer_id").agg(F.min("canonical_client").alias("_any"))
    if "channel" in crosswalk.columns and "channel" in df.columns:
        names = crosswalk.groupBy("customer_id", "channel").agg(F.min("canonical_client").alias("_own"))
        named = df.join(names, ["customer_id", "channel"], "left").join(any_channel, "customer_id", "left")
    else:
        named = df.join(any_channel, "customer_id", "left").withColumn("_own", F.col("_any"))
    named = named.withColumn("canonical_client", F.coalesce("_own", "_any")).drop("_own", "_any")
    unmapped = F.concat(F.lit("UNMAPPED: "), F.coalesce("account_name", "customer_id", F.lit("?")))
    return named.withColumn("client", F.coalesce("canonical_client", unmapped)).drop(
        "canonical_client"
    )


def join_by_normalized_name(left: DataFrame, left_name: str, right: DataFrame, right_name: str) -> DataFrame:
    """Left join on names that differ in case and outer blanks only."""
    keyed = right.withColumn("_name", F.lower(F.trim(right_name))).drop(right_name)
    return left.withColumn("_name", F.lower(F.trim(left_name))).join(keyed, "_name", "left").drop("_name")


def _account_daily(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """Pre-aggregate to account, channel and day before any name lookup; accounts without an id are told
    apart by their name."""
    nameless = F.when(F.col("customer_id").isNull(), F.col("account_name"))
    return (
        spend_union(feeds)
        .groupBy("customer_id", nameless.alias("_name"), "channel", "date")
        .agg(F.min("account_name").alias("account_name"), F.sum("spend").alias("spend"))
        .drop("_name")
    )


def spend_daily_unified(feeds: Mapping[str, DataFrame], crosswalk: DataFrame) -> DataFrame:
    return (
        resolve_client(_account_daily(feeds), crosswalk)
        .groupBy("date", "client", "channel")
        .agg(F.sum("spend").alias("actual"))
    )


def spend_combined(feeds: Mapping[str, DataFrame], platform_of: Mapping[str, str] | None = None) -> DataFrame:
    """Account-level twin with platform names."""
    platform = S.label_of(F.col("channel"), platform_of or {"google_ads": "google"})
    return _account_daily(feeds).select(
        "customer_id", platform.alias("platform"), F.col("date").alias("spend_date"), "spend"
    )


def actual_spend_all(daily: DataFrame) -> DataFrame:
    """Month totals per client and channel."""
    return daily.groupBy("client", "channel", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("actual").alias("actual")
    )


def actual_spend_mtd(daily: DataFrame, as_of: Column) -> DataFrame:
    """Month to date, from the same base as the month totals so the two cannot drift apart."""
    return (
        daily.filter((F.col("date") >= F.trunc(as_of, "MM")) & (F.col("date") <= as_of))
        .groupBy("client", "channel")
        .agg(F.sum("actual").alias("spent_mtd"))
    )


def source_group(account_name: Column, prefixes: Mapping[str, str]) -> Column:
    """Group from the account-name prefix (prefix -> group); NULL when none fits."""
    out = F.lit(None).cast("string")
    for prefix, group in reversed(list(prefixes.items())):
        out = F.when(F.startswith(account_name, F.lit(prefix)), F.lit(group)).otherwise(out)
    return out


def rolling_months(df: DataFrame, date_col: str, as_of: Column, back: int = 3, fwd: int = 3) -> DataFrame:
    """Whole months from `back` before to `fwd` after the current one."""
    first = F.trunc(F.add_months(as_of, -back), "MM")
    last = F.last_day(F.add_months(as_of, fwd))
    return df.filter(F.col(date_col).between(first, last))


def crosswalk_from_mapping(mapping: DataFrame, id_columns: Mapping[str, str]) -> DataFrame:
    """One row per (client, channel, id) from the per-channel id columns."""
    wide = mapping.select("client_name", *[F.col(c).cast("string").alias(ch) for ch, c in id_columns.items()])
    long = wide.unpivot("client_name", list(id_columns), "channel", "customer_id")
    return long.filter(F.trim(F.coalesce("customer_id", F.lit(""))) != "")
