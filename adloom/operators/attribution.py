"""One row per call: local time, caller history, channel, method and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adloom.functions import labels as L, scalars as S
from adloom.functions.keyed import sequence_in_time


def voice_calls(calls: DataFrame) -> DataFrame:
    """Drop text-message statuses; a NULL status is dropped too (three-valued NOT IN)."""
    return calls.filter(~F.col("call_status").isin(L.TEXT_MESSAGE_STATUSES))


def with_client(calls: DataFrame, mapping: DataFrame) -> DataFrame:
    """Inner join on the call account. Fans out if an account maps to two clients (see quality)."""
    client = mapping.select(
        F.col("ctm_account").alias("account_id"),
        F.col("monday_item_id").alias("client_key"),
        "client_name",
        F.nullif(F.col("google_ads_customer_id"), F.lit("")).try_cast("bigint").alias("google_ads_customer_id"),
        "vertical",
        "city_size",
    )
    return calls.join(client, "account_id")


def with_local_time(calls: DataFrame) -> DataFrame:
    """Offset from the hour printed by the phone system; an unreadable hour means no offset.

    The offset is taken modulo 24, so zones ahead of UTC move back by up to 23 hours.
    """
    offset = F.pmod(F.hour("called_at_ts") - S.clock_hour(F.col("hour")) + 24, F.lit(24))
    return calls.withColumn("tz_offset_hours", F.coalesce(offset, F.lit(0)).cast("int")).withColumn(
        "called_at_local",
        F.col("called_at_ts") - F.make_dt_interval(F.lit(0), F.col("tz_offset_hours")),
    )


def with_caller_history(calls: DataFrame, bucket: str = "hour") -> DataFrame:
    """Sequence per (client, caller), gap to the prior call and the 30-day duplicate flag.

    Anonymous calls of a client form one group; ties in time are broken by call id.
    """
    out = sequence_in_time(
        calls, ["client_key", "caller_number_bare"], "called_at_ts", "id",
        number="caller_sequence_num", previous="prior_call_ts", bucket=bucket,
    )
    gap = S.whole_days_between(F.col("prior_call_ts"), F.col("called_at_ts"))
    return (
        out.withColumn("caller_hash", F.sha2(F.coalesce("caller_number_bare", F.lit("unknown")), 256))
        .withColumn("is_first_call", F.col("caller_sequence_num") == 1)
        .withColumn("days_since_prior_call", F.datediff(F.to_date("called_at_ts"), F.to_date("prior_call_ts")))
        .withColumn(
            "is_duplicate_lead_30d",
            F.col("prior_call_ts").isNotNull() & F.coalesce(gap <= L.DUPLICATE_LEAD_DAYS, F.lit(False)),
        )
    )


def with_signals(calls: DataFrame) -> DataFrame:
    """Lower-cased inputs of the channel rules, computed once per row."""
    landing = F.lower(F.coalesce("landing_page", F.lit("")))
    last_google = F.lower(F.coalesce("last_url", F.lit(""))).rlike(L.GOOGLE_CLICK_ID)
    return calls.withColumns({
        "_google_click": landing.rlike(L.GOOGLE_CLICK_ID) | last_google,
        "_microsoft_click": landing.rlike(L.MICROSOFT_CLICK_ID),
        "_medium": F.lower("medium"),
        "_web": F.lower("web_source"),
    })


def channel() -> Column:
    """Paid click ids first, then the tracking source, then medium with web source.

    Needs the columns of with_signals.
    """
    source, medium, web = F.col("source"), F.col("_medium"), F.col("_web")
    paid_search = medium.isin(L.PAID_SEARCH_MEDIUMS)
    organic = medium == "organic"
    rules: list[tuple[Column, str]] = [
        (F.col("_google_click"), "google_paid"),
        (F.col("_microsoft_click"), "bing_paid"),
        (source == "Google Call Asset", "google_paid"),
        (source.startswith(L.BUSINESS_PROFILE_PREFIX), "gbp"),
        (source.isin("Google Ads", "Google Adwords"), "google_paid"),
        (source == "Google Organic", "google_organic"),
        (source == "Bing Paid", "bing_paid"),
        (source == "Nextdoor", "nextdoor_paid"),
        (source.isin("Meta Ads", "Facebook Paid"), "meta_paid"),
        (source == "Yelp", "referral"),
        (paid_search & (web == "google"), "google_paid"),
        (paid_search & (web == "bing"), "bing_paid"),
        (organic & (web == "google"), "google_organic"),
        (organic & (web == "bing"), "bing_organic"),
        ((medium == "paid") & (web == "meta"), "meta_paid"),
        (medium == "paid_nextdoor", "nextdoor_paid"),
        (medium.isin(L.OFFLINE_MEDIUMS), "offline"),
        (medium == "referral", "referral"),
        ((medium == "(none)") | (web == "(direct)"), "direct"),
    ]
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, value in rules[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit("unknown"))


def method() -> Column:
    click = F.col("_google_click") | F.col("_microsoft_click")
    dedicated = F.col("source").isin(L.DEDICATED_SOURCES) | F.col("source").startswith(L.BUSINESS_PROFILE_PREFIX)
    return (
        F.when(click, F.lit("url_click_id"))
        .when(dedicated, F.lit("dedicated_number"))
        .when(F.coalesce("medium", F.lit("")) != "", F.lit("medium_field"))
        .otherwise(F.lit("none"))
    )


def gclid() -> Column:
    """Lower-cased before the capture; last_url counts only when there is no landing page."""
    return S.extract(F.lower(F.coalesce("landing_page", "last_url")), L.GCLID_VALUE)


def landing_page_path() -> Column:
    return S.extract(F.coalesce("landing_page", "last_url"), L.URL_PATH)


def flags() -> dict[str, Column]:
    answered = F.col("call_status") == "answered"
    tags = F.coalesce("tag_list", F.lit(""))
    return {
        "is_answered": answered,
        "is_likely_voicemail": answered & (F.coalesce("talk_time", F.lit(0)) < L.VOICEMAIL_BELOW_SECONDS),
        "has_transcript": F.coalesce(F.col("transcription_text") != "", F.lit(False)),
        "ctm_tag_closed": tags.rlike(L.TAG_CLOSED),
        "ctm_tag_new_customer": tags.rlike(L.TAG_NEW_CUSTOMER),
        "ctm_tag_spam": tags.rlike(L.TAG_SPAM),
    }


def calls_attribution(calls: DataFrame, mapping: DataFrame, bucket: str = "hour") -> DataFrame:
    base = with_caller_history(with_local_time(with_client(voice_calls(calls), mapping)), bucket)
    base = with_signals(base)
    flag = flags()
    return base.select(
        F.col("id").alias("call_id"),
        "client_key",
        "client_name",
        "google_ads_customer_id",
        F.col("account_id").alias("ctm_account_id"),
        "vertical",
        "city_size",
        "ga_cid",
        "caller_hash",
        "tracking_number_id",
        F.col("called_at_ts").alias("called_at_utc"),
        "called_at_local",
        F.to_date("called_at_local").alias("call_date_local"),
        F.hour("called_at_local").alias("hour_local"),
        F.dayofweek("called_at_local").alias("dow_local"),
        "tz_offset_hours",
        "direction",
        F.col("duration").alias("duration_sec"),
        F.col("talk_time").alias("talk_time_sec"),
        F.col("ring_time").alias("ring_time_sec"),
        F.col("call_status").alias("call_status_raw"),
        flag["is_answered"].alias("is_answered"),
        flag["is_likely_voicemail"].alias("is_likely_voicemail"),
        "agent_id",
        "agent_name",
        F.col("is_new_caller").alias("is_new_caller_ctm"),
        "is_first_call",
        "caller_sequence_num",
        "days_since_prior_call",
        "is_duplicate_lead_30d",
        channel().alias("channel"),
        method().alias("attribution_method"),
        gclid().alias("gclid"),
        landing_page_path().alias("landing_page_path"),
        "device_type",
        "city",
        "state",
        "postal_code",
        F.col("excluded").alias("is_excluded"),
        flag["has_transcript"].alias("has_transcript"),
        "tag_list",
        flag["ctm_tag_closed"].alias("ctm_tag_closed"),
        flag["ctm_tag_new_customer"].alias("ctm_tag_new_customer"),
        flag["ctm_tag_spam"].alias("ctm_tag_spam"),
        F.col("_pipeline_loaded_at"),
    )
