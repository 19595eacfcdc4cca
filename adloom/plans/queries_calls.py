"""Call attribution, call dashboard and cost per lead."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adloom.functions import scalars as S
from adloom.operators import attribution as A, calls as C, leads as L
from adloom.plans.catalog import query
from adloom.plans.frames import Frames
from adloom.plans.oracle import AS_OF, day, sql, stamp
from adloom.sinks.tables import materialize

_ATTRIBUTED_COLUMNS = """call_id, client_key, client_name, google_ads_customer_id, account_id AS ctm_account_id, vertical,
  city_size, ga_cid, caller_hash, tracking_number_id, %s AS called_at_utc, %s AS called_at_local, %s AS call_date_local,
  hour_local, dow_local, CAST(tz_offset_hours AS INTEGER) AS tz_offset_hours, direction, duration AS duration_sec,
  talk_time AS talk_time_sec, ring_time AS ring_time_sec, call_status AS call_status_raw, is_answered,
  is_likely_voicemail, agent_id, agent_name, is_new_caller AS is_new_caller_ctm, is_first_call, caller_sequence_num,
  days_since_prior_call, is_duplicate_lead_30d, channel, attribution_method, gclid, landing_page_path, device_type,
  city, state, postal_code, excluded AS is_excluded, has_transcript, tag_list, ctm_tag_closed, ctm_tag_new_customer,
  ctm_tag_spam, %s AS _pipeline_loaded_at""" % (
    stamp("called_at_utc"), stamp("called_at_local"), day("call_date_local"), stamp("_pipeline_loaded_at"))


@query("calls_attribution", "OP-01 JN-01 FLT-01 STR-01 STR-02 STR-03 STR-07 STR-08 NUL-01 NUL-02 DT-01 DT-02 DT-03 MTH-01",
       sql("attributed", f"SELECT {_ATTRIBUTED_COLUMNS} FROM attributed"))
def _(f: Frames) -> DataFrame:
    return f.attributed


@query("voice_calls_by_status", "FLT-01", sql("ctm_calls", """
  SELECT call_status, count(*) AS calls FROM ctm_calls
  WHERE call_status NOT IN ('sent','delivered','received','undelivered','delivery_failed','unsent','sending_failed','queued')
  GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    return A.voice_calls(f.ctm_calls).groupBy("call_status").agg(F.count(F.lit(1)).alias("calls"))


@query("attribution_channels", "FLT-02 FLT-03", sql("attributed", """
  SELECT channel, attribution_method, count(*) AS calls FROM attributed GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    base = A.with_signals(A.with_client(A.voice_calls(f.ctm_calls), f.mapping))
    return base.groupBy(A.channel().alias("channel"), A.method().alias("attribution_method")).agg(
        F.count(F.lit(1)).alias("calls"))


@query("landing_captures", "FLT-04 STR-03", sql("attributed", """
  SELECT gclid, landing_page_path, count(*) AS calls FROM attributed GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    base = A.with_client(A.voice_calls(f.ctm_calls), f.mapping)
    return base.groupBy(A.gclid().alias("gclid"), A.landing_page_path().alias("landing_page_path")).agg(
        F.count(F.lit(1)).alias("calls"))


@query("call_flags", "FLT-05", sql("call_base", """
  SELECT call_status = 'answered' AS is_answered,
    call_status = 'answered' AND coalesce(talk_time, 0) < 20 AS is_likely_voicemail,
    coalesce(transcription_text <> '', false) AS has_transcript,
    regexp_matches(coalesce(tag_list,''), '\\bclosed\\b') AS ctm_tag_closed,
    regexp_matches(coalesce(tag_list,''), 'new customer') AS ctm_tag_new_customer,
    regexp_matches(coalesce(tag_list,''), '\\bspam\\b') AS ctm_tag_spam, count(*) AS calls
  FROM call_base GROUP BY 1, 2, 3, 4, 5, 6"""))
def _(f: Frames) -> DataFrame:
    base = A.with_client(A.voice_calls(f.ctm_calls), f.mapping)
    return base.groupBy(*[c.alias(n) for n, c in A.flags().items()]).agg(F.count(F.lit(1)).alias("calls"))


@query("caller_history", "WIN-01 WIN-02 DT-04 DT-05", sql("attributed", f"""
  SELECT call_id, client_key, caller_number_bare, caller_sequence_num, {stamp('prior_call_ts')} AS prior_call_ts,
    days_since_prior_call, is_duplicate_lead_30d FROM attributed"""))
def _(f: Frames) -> DataFrame:
    out = A.with_caller_history(A.with_client(A.voice_calls(f.ctm_calls), f.mapping))
    return out.select(F.col("id").alias("call_id"), "client_key", "caller_number_bare", "caller_sequence_num",
                      "prior_call_ts", "days_since_prior_call", "is_duplicate_lead_30d")


# ---- dashboard --------------------------------------------------------------------------
@query("calls_daily", "AGG-25", sql("calls_daily", f"SELECT * REPLACE ({day('call_date')} AS call_date) FROM calls_daily"))
def _(f: Frames) -> DataFrame:
    return f.calls_daily


@query("calls_heatmap", "AGG-26", sql("calls_heatmap", "SELECT * FROM calls_heatmap"))
def _(f: Frames) -> DataFrame:
    return f.calls_heatmap


@query("call_cards", "AGG-19 FLT-10 NUL-03", sql("calls_daily spend_unified", f"""
  WITH c AS (SELECT CAST(coalesce(sum(total_calls), 0) AS BIGINT) AS total_calls,
      CAST(coalesce(sum(missed_calls), 0) AS BIGINT) AS missed_calls,
      CAST(coalesce(sum(answered_calls), 0) AS BIGINT) AS answered_calls,
      CAST(coalesce(sum(CASE WHEN channel = 'Google Ads' THEN total_calls END), 0) AS BIGINT) AS google_calls
    FROM calls_daily WHERE call_date >= {AS_OF} - 30),
  s AS (SELECT coalesce(CAST(sum(actual) AS DOUBLE), 0.0) AS spend_usd FROM spend_unified
    WHERE channel = 'google_ads' AND date >= {AS_OF} - 30)
  SELECT c.*, spend_usd, CAST(missed_calls AS DOUBLE) / nullif(total_calls, 0) * 100 AS miss_rate,
    CAST(answered_calls AS DOUBLE) / nullif(total_calls, 0) * 100 AS answer_rate,
    spend_usd / nullif(google_calls, 0) AS cost_per_google_call FROM c, s"""))
def _(f: Frames) -> DataFrame:
    ads = C.window_feed(C.ads_daily(f.spend_unified), "date", f.as_of, 30)
    return C.call_cards(C.window_feed(f.calls_daily, "call_date", f.as_of, 30), ads)


_BY_CHANNEL = """SELECT channel, CAST(sum(total_calls) AS BIGINT) AS total_calls, CAST(sum(missed_calls) AS BIGINT) AS missed_calls,
    CAST(sum(answered_calls) AS BIGINT) AS answered_calls,
    CAST(list_position(['Google Ads','Bing Ads','Nextdoor','Meta','Organic / Direct','Other'], channel) - 1 AS INTEGER) AS position
  FROM calls_daily GROUP BY 1"""


@query("calls_by_channel", "AGG-20 SRT-04", sql("calls_daily", _BY_CHANNEL))
def _(f: Frames) -> DataFrame:
    return C.calls_by_channel(f.calls_daily)


@query("missed_by_channel", "AGG-22", sql("calls_daily", _BY_CHANNEL))
def _(f: Frames) -> DataFrame:
    return C.missed_by_channel(f.calls_daily)


@query("calls_by_day_channel", "AGG-21", sql("calls_daily", f"""
  SELECT {day('call_date')} AS call_date, """ + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN channel = '{c}' THEN total_calls END), 0) AS BIGINT) AS \"{c}\""
    for c in ("Google Ads", "Bing Ads", "Nextdoor", "Meta", "Organic / Direct", "Other")) + " FROM calls_daily GROUP BY 1"))
def _(f: Frames) -> DataFrame:
    return C.calls_by_day_channel(f.calls_daily)


_ADS_DAY = f"""SELECT coalesce(c.date, s.date) AS date, coalesce(c.calls, 0) AS calls, coalesce(s.spend, 0) AS spend
  FROM (SELECT call_date AS date, CAST(sum(total_calls) AS BIGINT) AS calls FROM calls_daily
        WHERE channel = 'Google Ads' AND call_date >= {AS_OF} - 90 GROUP BY 1) c
  FULL OUTER JOIN (SELECT date, sum(actual) AS spend FROM spend_unified
        WHERE channel = 'google_ads' AND date >= {AS_OF} - 90 GROUP BY 1) s ON c.date = s.date"""


def _ads_inputs(f: Frames) -> tuple[DataFrame, DataFrame]:
    return (C.window_feed(f.calls_daily, "call_date", f.as_of, 90),
            C.window_feed(C.ads_daily(f.spend_unified), "date", f.as_of, 90))


@query("ads_per_day", "JN-08", sql("calls_daily spend_unified", f"""
  SELECT {day('date')} AS date, calls, CAST(spend AS DOUBLE) AS spend FROM ({_ADS_DAY})"""))
def _(f: Frames) -> DataFrame:
    return C.ads_per_day(*_ads_inputs(f))


@query("ads_daily_table", "AGG-23", sql("calls_daily spend_unified", f"""
  SELECT {day('date')} AS date, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(spend) AS DOUBLE) AS spend,
    CAST(sum(spend) AS DOUBLE) / nullif(CAST(sum(calls) AS DOUBLE), 0) AS cost_per_call
  FROM ({_ADS_DAY}) GROUP BY ROLLUP (date)"""))
def _(f: Frames) -> DataFrame:
    return C.ads_daily_table(*_ads_inputs(f))


@query("dow_hour_grid", "AGG-24 WIN-09 PRJ-05", sql("calls_heatmap", """
  WITH cells AS (SELECT CAST(i // 24 + 1 AS INTEGER) AS d, CAST(i % 24 AS INTEGER) AS h FROM range(168) t(i)),
  counts AS (SELECT day_of_week_sun1 AS d, hour_of_day AS h, CAST(sum(total_calls) AS BIGINT) AS n FROM calls_heatmap GROUP BY 1, 2)
  SELECT cells.d AS day_of_week_sun1, cells.h AS hour_of_day,
    ['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][cells.d] AS day_label,
    CAST(CASE WHEN cells.h % 12 = 0 THEN 12 ELSE cells.h % 12 END AS VARCHAR) || CASE WHEN cells.h < 12 THEN 'a' ELSE 'p' END
      AS hour_label,
    coalesce(n, 0) AS total_calls, CAST(coalesce(n, 0) AS DOUBLE) / (SELECT max(n) FROM counts) AS intensity
  FROM cells LEFT JOIN counts ON cells.d = counts.d AND cells.h = counts.h"""))
def _(f: Frames) -> DataFrame:
    return C.dow_hour_grid(f.calls_heatmap)


@query("ads_daily", "PRJ-02", sql("spend_unified", f"""
  SELECT {day('date')} AS date, client AS client_name, 'Google Ads' AS channel, CAST(actual AS DOUBLE) AS spend_usd
  FROM spend_unified WHERE channel = 'google_ads'"""))
def _(f: Frames) -> DataFrame:
    return C.ads_daily(f.spend_unified)


@query("client_universe", "SET-02", sql("calls_daily spend_unified", f"""
  SELECT client_name FROM calls_daily WHERE call_date >= {AS_OF} - 100
  UNION SELECT client FROM spend_unified WHERE channel = 'google_ads' AND date >= {AS_OF} - 100"""))
def _(f: Frames) -> DataFrame:
    return C.call_dashboard(f.calls_daily, f.calls_heatmap, f.spend_unified, f.as_of)["clients"]


@query("call_dashboard_feed", "OP-18 FLT-10", sql("calls_daily", f"""
  SELECT * REPLACE ({day('call_date')} AS call_date) FROM calls_daily WHERE call_date >= {AS_OF} - 100"""))
def _(f: Frames) -> DataFrame:
    return C.call_dashboard(f.calls_daily, f.calls_heatmap, f.spend_unified, f.as_of)["calls_daily"]


# ---- cost per lead ------------------------------------------------------------------------
@query("monthly_spend", "AGG-08 JN-02 FLT-11 FLT-12 STR-10 DT-06", sql("cpl_spend", """
  SELECT month, customer_id, client_name, CAST(spend AS DOUBLE) AS spend FROM cpl_spend"""))
def _(f: Frames) -> DataFrame:
    return L.monthly_spend(f.spend_unified, f.mapping, f.as_of, 6)


@query("monthly_leads", "AGG-09 FLT-11", sql("cpl_leads", "SELECT * FROM cpl_leads"))
def _(f: Frames) -> DataFrame:
    return L.monthly_leads(f.attributed, f.as_of, 6)


@query("cost_per_lead", "OP-02 OP-03 JN-07", sql("cpl_rows", """
  SELECT *, CASE WHEN first_time > 0 THEN spend / first_time END AS cpl FROM cpl_rows"""))
def _(f: Frames) -> DataFrame:
    return f.cpl_rows.withColumn("cpl", L.cpl("first_time"))


_TREND = """CASE WHEN cpl IS NULL OR prev_cpl IS NULL THEN NULL
    WHEN prev_cpl = 0 THEN CASE WHEN cpl > 0 THEN 'up' ELSE 'down' END
    WHEN abs((cpl - prev_cpl) / prev_cpl) < 0.03 THEN 'flat' WHEN cpl > prev_cpl THEN 'up' ELSE 'down' END AS trend"""


@query("cpl_trend", "WIN-05", sql("cpl_rows", f"""
  SELECT *, {_TREND} FROM (
    SELECT *, lag(cpl) OVER (PARTITION BY client_name ORDER BY month, customer_id) AS prev_cpl
    FROM (SELECT *, CASE WHEN unique_callers > 0 THEN spend / unique_callers END AS cpl FROM cpl_rows))"""))
def _(f: Frames) -> DataFrame:
    return L.mom_trend(f.cpl_rows, "unique_callers")


_LATEST = f"""
  WITH recent AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS r FROM (SELECT DISTINCT month FROM cpl_rows)),
  total AS (SELECT client_name, r, CAST(sum(CAST(c.spend AS DECIMAL(38,9))) AS DOUBLE) AS spend, CAST(sum(unique_callers) AS BIGINT) AS unique_callers
    FROM cpl_rows c JOIN recent USING (month)
    WHERE r <= 2 AND coalesce(client_name, '') <> '' GROUP BY client_name, r),
  priced AS (SELECT *, CASE WHEN unique_callers > 0 THEN spend / unique_callers END AS cpl FROM total),
  latest AS (SELECT coalesce(a.client_name, b.client_name) AS client_name, coalesce(a.spend, 0.0) AS spend,
      coalesce(a.unique_callers, 0) AS leads, a.cpl, b.cpl AS prev_cpl
    FROM (SELECT * FROM priced WHERE r = 1) a FULL OUTER JOIN (SELECT * FROM priced WHERE r = 2) b
      ON a.client_name = b.client_name)"""


def _latest(f: Frames) -> DataFrame:
    return L.latest_vs_previous(materialize(f.cpl_rows, "cpl-rows"), "unique_callers")


@query("cpl_latest_vs_previous", "WIN-06 SRT-03", sql("cpl_rows", f"""{_LATEST}
  SELECT *, {_TREND} FROM latest WHERE spend > 0 OR leads > 0"""))
def _(f: Frames) -> DataFrame:
    return L.most_expensive_first(_latest(f))


@query("cpl_summary", "AGG-27", sql("cpl_rows", f"""{_LATEST}
  SELECT round(avg(cpl), 4) AS avg_cpl, CAST(sum(leads) AS BIGINT) AS total_leads, round(sum(spend), 2) AS total_spend,
    count(cpl) AS clients_with_cpl FROM latest WHERE spend > 0 OR leads > 0"""))
def _(f: Frames) -> DataFrame:
    out = L.cpl_summary(_latest(f))
    return out.withColumn("avg_cpl", F.round("avg_cpl", 4)).withColumn("total_spend", F.round("total_spend", 2))


@query("months_present", "SET-03", sql("cpl_rows", "SELECT DISTINCT month FROM cpl_rows"))
def _(f: Frames) -> DataFrame:
    return L.months_present(f.cpl_rows)


@query("page_visits_local_hour", "DT-02", sql("ctm_calls", """
  SELECT hour AS printed, CASE WHEN hour <> 'n/a' THEN CAST(CAST(regexp_extract(hour, '([0-9]+)', 1) AS BIGINT) % 12
      + CASE WHEN contains(hour, 'PM') THEN 12 ELSE 0 END AS INTEGER) END AS hour_local, count(*) AS calls
  FROM ctm_calls GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    return f.ctm_calls.groupBy(F.col("hour").alias("printed"), S.clock_hour(F.col("hour")).alias("hour_local")).agg(
        F.count(F.lit(1)).alias("calls"))
