"""Campaign-health detectors, the alert board and the ZIP heatmap."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adloom.functions import scalars as S
from adloom.operators.attribution import voice_calls, with_client
from adloom.operators import alerts as A, board as B, heatmap as H, quality as Q
from adloom.operators.spend import SERVED_ELSEWHERE, actual_spend_mtd, conversions_trailing, spend_trailing
from adloom.plans.catalog import query
from adloom.plans.frames import Frames
from adloom.plans.oracle import AS_OF, NOW, day, sql, stamp
from adloom.session import work_dir
from adloom.sources.tables import newest_partition

_ALERT = f"SELECT * REPLACE ({stamp('detected_at')} AS detected_at) FROM "


@query("alert_campaign_suspended", "OP-10 FLT-06 FLT-08 JN-04 STR-04", sql("a_suspended", _ALERT + "a_suspended"))
def _(f: Frames) -> DataFrame:
    return A.campaign_suspended(f.campaigns, f.mapping, f.now)


@query("alert_ads_disapproved", "OP-11 AGG-05 JN-03 JN-04", sql("a_disapproved", _ALERT + "a_disapproved"))
def _(f: Frames) -> DataFrame:
    return A.ads_disapproved(f.campaigns, f.ads, f.mapping, f.now)


@query("alert_overspend", "OP-12 STR-04 MTH-01", sql("a_overspend", _ALERT + "a_overspend"))
def _(f: Frames) -> DataFrame:
    return A.overspend(f.pacing_calculations, f.mapping, f.now)


@query("alert_no_spend", "OP-14 DT-04", sql("a_no_spend", _ALERT + "a_no_spend"))
def _(f: Frames) -> DataFrame:
    return A.no_spend(f.spend_combined, f.mapping, f.as_of, f.now)


@query("alert_url_disapproved", "OP-15 FLT-07 AGG-07", sql("a_url", _ALERT + "a_url"))
def _(f: Frames) -> DataFrame:
    return A.url_disapproved(f.ad_policy, f.mapping, f.now)


@query("alert_phone_disapproved", "OP-16 FLT-07", sql("a_phone", _ALERT + "a_phone"))
def _(f: Frames) -> DataFrame:
    return A.phone_disapproved(f.call_assets, f.mapping, f.now)


@query("alert_billing_problem", "OP-17 FLT-09", sql("a_billing", _ALERT + "a_billing"))
def _(f: Frames) -> DataFrame:
    return A.billing_problem(f.billing, f.mapping, f.now)


@query("alerts_active", "SET-01 SRT-01", sql("alerts", _ALERT + "alerts"))
def _(f: Frames) -> DataFrame:
    return B.feed_order(f.alerts)


@query("latest_partition_rows", "FLT-06", sql("campaigns", """
  SELECT campaign_status, campaign_serving_status, count(*) AS campaigns FROM campaigns WHERE data_date = latest_date GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    return A.latest_partition(f.campaigns).groupBy("campaign_status", "campaign_serving_status").agg(
        F.count(F.lit(1)).alias("campaigns"))


@query("latest_snapshot_history", "FLT-07", sql("ad_policy", """
  SELECT approval_status, policy_topics, count(*) AS ads FROM ad_policy
  WHERE snapshot_date = (SELECT max(snapshot_date) FROM ad_policy) GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    """The loader keeps a history partitioned by snapshot day; the newest day is found from its folders."""
    path = work_dir(f.spark, "policy-history")
    f.ad_policy.write.partitionBy("snapshot_date").parquet(path)
    newest = newest_partition(f.spark, path, "snapshot_date")
    return newest.groupBy("approval_status", "policy_topics").agg(F.count(F.lit(1)).alias("ads"))


@query("latest_snapshot_rows", "FLT-07", sql("ad_policy", """
  SELECT approval_status, policy_topics, count(*) AS ads FROM ad_policy
  WHERE snapshot_date = (SELECT max(snapshot_date) FROM ad_policy) GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    return A.latest_snapshot(f.ad_policy).groupBy("approval_status", "policy_topics").agg(F.count(F.lit(1)).alias("ads"))


@query("enabled_campaigns", "FLT-08", sql("campaigns", """
  SELECT campaign_id, campaign_name FROM campaigns
  WHERE campaign_status = 'ENABLED' AND campaign_advertising_channel_type <> 'LOCAL_SERVICES'"""))
def _(f: Frames) -> DataFrame:
    return A.enabled_not_local(f.campaigns).select("campaign_id", "campaign_name")


@query("disapproved_per_campaign", "AGG-05", sql("ads", """
  SELECT customer_id, campaign_id, count(*) AS disapproved_count FROM ads
  WHERE data_date = latest_date AND approval = 'DISAPPROVED' GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    return A.disapproved_per_campaign(f.ads)


@query("spend_status", "AGG-06", sql("spend_status", f"""
  SELECT customer_id, platform, {day('last_spend_date')} AS last_spend_date, CAST(spend_30d AS DOUBLE) AS spend_30d FROM spend_status"""))
def _(f: Frames) -> DataFrame:
    return A.spend_status(f.spend_combined, f.as_of)


@query("url_problems", "AGG-07", sql("url_problems", "SELECT * FROM url_problems"))
def _(f: Frames) -> DataFrame:
    return A.url_problems(f.ad_policy)


@query("overspend_forecast", "OP-13 DT-08", sql("line_spend", f"""
  WITH mtd AS (SELECT account_name AS client, channel, CAST(sum(spend) AS DOUBLE) AS spent_mtd FROM line_spend
    WHERE date >= DATE '2024-01-01' AND date <= {AS_OF} GROUP BY 1, 2),
  c AS (SELECT account_name AS client, channel, CAST(sum(spend) AS DOUBLE) AS committed FROM line_spend
    WHERE date BETWEEN DATE '2023-12-01' AND DATE '2023-12-31' GROUP BY 1, 2)
  SELECT client, channel, committed, spent_mtd, spent_mtd / 31 * 31 AS projected_eom FROM c JOIN mtd USING (client, channel)
  WHERE spent_mtd / 31 * 31 > committed * 1.10"""))
def _(f: Frames) -> DataFrame:
    # last month's spend stands in for the commitment
    mtd = actual_spend_mtd(f.spend_unified, f.as_of).withColumn("spent_mtd", F.col("spent_mtd").cast("double"))
    committed = f.spend_unified.filter("date BETWEEN '2023-12-01' AND '2023-12-31'").groupBy("client", "channel").agg(
        F.sum("actual").cast("double").alias("committed"))
    return A.overspend_forecast(committed.join(mtd, ["client", "channel"]), f.as_of)


# ---- board --------------------------------------------------------------------------------
_NORMAL = f"""SELECT alert_type, severity, source, customer_id, nullif(client_name, '') AS client_name,
    coalesce(nullif(account_manager, ''), '(Unassigned)') AS account_manager, tier, sub_mcc, av_status, entity_id,
    entity_name, coalesce(detail, '') AS detail, detected_at,
    CASE alert_type WHEN 'campaign_suspended' THEN 'Campaign suspended' WHEN 'ads_disapproved' THEN 'Ads disapproved'
      WHEN 'overspend' THEN 'Overspend' WHEN 'no_spend' THEN 'Stopped spending' ELSE alert_type END AS type_label FROM alerts"""


@query("normalized_alerts", "PRJ-01", sql("alerts", f"{_ALERT} ({_NORMAL})"))
def _(f: Frames) -> DataFrame:
    return B.normalize_alerts(f.alerts)


@query("filtered_alerts", "FLT-14", sql("alerts", f"""{_ALERT} ({_NORMAL})
  WHERE severity = 'P0' AND lower(coalesce(av_status, '')) NOT IN ('av approved', 'no', 'no av')
    AND contains(lower(coalesce(client_name, '') || ' ' || coalesce(entity_name, '') || ' ' || detail || ' ' || customer_id
        || ' ' || coalesce(account_manager, '')), 'nation_1')"""))
def _(f: Frames) -> DataFrame:
    return B.alert_filter(B.normalize_alerts(f.alerts), severity="P0", av="other", q="NATION_1")


@query("alerts_on_av", "FLT-14", sql("alerts", f"""
  SELECT severity, alert_type, count(*) AS alerts FROM ({_NORMAL})
  WHERE lower(av_status) = 'av approved' AND account_manager = 'NATION_7' GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    rows = B.alert_filter(B.normalize_alerts(f.alerts), av="has", manager="NATION_7")
    return rows.groupBy("severity", "alert_type").agg(F.count(F.lit(1)).alias("alerts"))


@query("av_buckets", "FLT-15", sql("alerts", """
  SELECT CASE lower(coalesce(av_status, '')) WHEN 'av approved' THEN 'ok' WHEN 'no' THEN 'no' WHEN 'no av' THEN 'no'
      WHEN 'in progress' THEN 'prog' WHEN 'stuck' THEN 'stuck' ELSE 'na' END AS bucket,
    CASE lower(coalesce(av_status, '')) WHEN 'av approved' THEN 'AV Approved' WHEN 'no' THEN 'No AV' WHEN 'no av' THEN 'No AV'
      WHEN 'in progress' THEN 'In Progress' WHEN 'stuck' THEN 'Stuck' ELSE coalesce(nullif(av_status, ''), 'no data') END AS label,
    count(*) AS alerts FROM alerts GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    av = F.col("av_status")
    return f.alerts.groupBy(B.av_bucket(av).alias("bucket"), B.av_text(av).alias("label")).agg(
        F.count(F.lit(1)).alias("alerts"))


@query("alert_age", "FLT-18", sql("order_cells", """
  WITH a AS (SELECT event_id, round((epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(changed_at)) / 3600.0) AS h,
      TIMESTAMP '2001-08-02 00:00:00' - changed_at < INTERVAL 24 HOUR AS is_new FROM order_cells)
  SELECT event_id, is_new, CASE WHEN h < 1 THEN 'just now' WHEN h < 24 THEN CAST(CAST(h AS BIGINT) AS VARCHAR) || 'h ago'
      ELSE CAST(CAST(floor(h / 24) AS BIGINT) AS VARCHAR) || 'd ago' END AS age FROM a"""))
def _(f: Frames) -> DataFrame:
    now, at = F.to_timestamp(F.lit("2001-08-02 00:00:00")), F.col("changed_at").cast("timestamp")
    return f.order_cells.select("event_id", B.is_new(at, now).alias("is_new"), B.age_label(at, now).alias("age"))


@query("alert_metrics", "AGG-28", sql("alerts", """
  SELECT count(*) AS total, count(*) FILTER (severity = 'P0') AS p0, count(*) FILTER (severity = 'P1') AS p1,
    count(*) FILTER (lower(av_status) = 'av approved') AS on_av FROM alerts"""))
def _(f: Frames) -> DataFrame:
    return B.alert_metrics(f.alerts)


@query("alert_by_type", "AGG-29 WIN-09", sql("alerts", """
  WITH c AS (SELECT alert_type, count(*) AS alerts FROM alerts GROUP BY 1)
  SELECT alert_type, alerts, CAST(round(CAST(alerts AS DOUBLE) / (SELECT max(alerts) FROM c) * 100) AS INTEGER) AS pct_of_max,
    CASE alert_type WHEN 'campaign_suspended' THEN 'Campaign suspended' WHEN 'ads_disapproved' THEN 'Ads disapproved'
      WHEN 'overspend' THEN 'Overspend' WHEN 'no_spend' THEN 'Stopped spending' ELSE alert_type END AS type_label FROM c"""))
def _(f: Frames) -> DataFrame:
    return B.alert_by_type(f.alerts)


@query("alert_by_manager", "AGG-30 SRT-09", sql("alerts", f"""
  SELECT account_manager, count(*) AS alerts, bool_or(severity = 'P0') AS has_p0 FROM ({_NORMAL}) GROUP BY 1
  ORDER BY alerts DESC, account_manager LIMIT 15"""))
def _(f: Frames) -> DataFrame:
    return B.alert_by_manager(B.normalize_alerts(f.alerts))


@query("alert_page", "SRT-02 SRT-08", sql("alerts", f"""{_ALERT} ({_NORMAL})
  ORDER BY CASE severity WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 ELSE 9 END, detected_at DESC, alert_type, customer_id, entity_id, detail
  LIMIT 25 OFFSET 50"""))
def _(f: Frames) -> DataFrame:
    rows = B.normalize_alerts(f.alerts)
    return B.page(rows, B.board_order(rows), number=3)


@query("manager_options", "SET-03", sql("alerts", f"SELECT DISTINCT account_manager FROM ({_NORMAL})"))
def _(f: Frames) -> DataFrame:
    return B.normalize_alerts(f.alerts).select("account_manager").distinct().orderBy("account_manager")


# ---- heatmap ------------------------------------------------------------------------------
_GEO = """SELECT client_name, vertical, state AS primary_state,
    TRY_CAST(nullif(regexp_replace(google_ads_customer_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS cid, trim(z) AS zip
  FROM (SELECT *, unnest(string_split(main_locations_zips, ',')) AS z FROM mapping WHERE main_locations_zips IS NOT NULL)
  WHERE regexp_full_match(trim(z), '\\d{5}')"""
_HEAT = f"""WITH geo AS ({_GEO}),
  fp AS (SELECT cid, count(DISTINCT zip) AS zip_count FROM geo GROUP BY 1),
  sp AS (SELECT TRY_CAST(customer_id AS BIGINT) AS cid, sum(spend) AS spend_90d FROM spend_combined
    WHERE lower(platform) = 'google' AND spend_date >= {AS_OF} - 90 GROUP BY 1),
  cv AS (SELECT CAST(customer_id AS BIGINT) AS cid, sum(conversions) AS conversions_90d FROM line_spend
    WHERE date >= {AS_OF} - 90 GROUP BY 1),
  zz AS (SELECT DISTINCT lpad(CAST(c_custkey * 7 % 100000 AS VARCHAR), 5, '0') AS zip,
      CAST((c_custkey * 7 % 100000) / 1000.0 AS DOUBLE) AS lat, CAST((c_custkey * 7 % 100000) / -500.0 AS DOUBLE) AS lng
    FROM customer WHERE c_acctbal >= 0),
  heat AS (SELECT client_name, g.cid AS google_ads_customer_id, g.zip, vertical, primary_state, lat, lng,
      CAST(spend_90d AS DOUBLE) AS spend_90d, CAST(conversions_90d AS DOUBLE) AS conversions_90d,
      CAST(spend_90d AS DOUBLE) / nullif(conversions_90d, 0) AS cpa_90d, zip_count, {stamp(NOW)} AS view_refreshed_at
    FROM geo g LEFT JOIN fp ON g.cid = fp.cid LEFT JOIN sp ON g.cid = sp.cid LEFT JOIN cv ON g.cid = cv.cid
    LEFT JOIN zz ON g.zip = zz.zip)"""


def _heat(f: Frames) -> DataFrame:
    return H.client_heatmap(f.mapping, f.spend_combined, f.conversion_stats, f.zips, f.as_of, f.now)


@query("client_heatmap_90d", "OP-04 JN-05 JN-11 STR-05 STR-06", sql("mapping spend_combined line_spend", f"{_HEAT} SELECT * FROM heat"))
def _(f: Frames) -> DataFrame:
    return _heat(f)


@query("client_zips", "JN-11 ARR-02", sql("mapping", _GEO))
def _(f: Frames) -> DataFrame:
    return H.client_zips(f.mapping)


@query("spend_trailing", "AGG-01 FLT-10", sql("spend_combined", f"""
  SELECT TRY_CAST(customer_id AS BIGINT) AS cid, CAST(sum(spend) AS DOUBLE) AS spend_90d FROM spend_combined
  WHERE lower(platform) = 'google' AND spend_date >= {AS_OF} - 90 GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    return spend_trailing(f.spend_combined, f.as_of)


@query("conversions_trailing", "AGG-02", sql("line_spend", f"""
  SELECT CAST(customer_id AS BIGINT) AS cid, CAST(sum(conversions) AS DOUBLE) AS conversions_90d FROM line_spend
  WHERE date >= {AS_OF} - 90 GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    return conversions_trailing(f.conversion_stats, f.as_of)


@query("zip_footprint", "AGG-03", sql("mapping", f"SELECT cid, count(DISTINCT zip) AS zip_count FROM ({_GEO}) GROUP BY 1"))
def _(f: Frames) -> DataFrame:
    return H.zip_footprint(H.client_zips(f.mapping))


@query("heatmap_row_count", "OP-05", sql("mapping", f"SELECT count(*) AS row_count FROM ({_GEO})"))
def _(f: Frames) -> DataFrame:
    return H.heatmap_row_count(_heat(f))


@query("heatmap_ungeocoded", "OP-05", sql("mapping spend_combined line_spend", f"{_HEAT} SELECT client_name, zip FROM heat WHERE lat IS NULL"))
def _(f: Frames) -> DataFrame:
    return H.ungeocoded(_heat(f))


@query("heatmap_without_metrics", "OP-05", sql("mapping spend_combined line_spend", f"""{_HEAT}
  SELECT DISTINCT client_name, google_ads_customer_id FROM heat WHERE spend_90d IS NULL"""))
def _(f: Frames) -> DataFrame:
    return H.without_metrics(_heat(f))


@query("heatmap_cpa_by_client", "OP-05", sql("mapping spend_combined line_spend", f"""{_HEAT}
  SELECT client_name, max(spend_90d) AS spend_90d, max(conversions_90d) AS conv_90d, max(cpa_90d) AS cpa_90d FROM heat GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    return H.cpa_by_client(_heat(f))


@query("normalized_ids", "STR-05 NUL-02", sql("mapping", """
  SELECT google_ads_customer_id AS raw_id, TRY_CAST(nullif(google_ads_customer_id, '') AS BIGINT) AS cast_id,
    TRY_CAST(nullif(regexp_replace(google_ads_customer_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits_id FROM mapping"""))
def _(f: Frames) -> DataFrame:
    raw = F.col("google_ads_customer_id")
    return f.mapping.select(raw.alias("raw_id"), F.nullif(raw, F.lit("")).try_cast("bigint").alias("cast_id"),
                            S.normalize_id(raw).alias("digits_id"))


# ---- quality ------------------------------------------------------------------------------
@query("mapping_fanout", "Q-01", sql("call_base ctm_calls", """
  SELECT (SELECT count(*) FROM ctm_calls WHERE call_status NOT IN ('sent','delivered','received','undelivered',
      'delivery_failed','unsent','sending_failed','queued')) AS rows_before,
    (SELECT count(*) FROM call_base) AS rows_after,
    (SELECT count(*) FROM (SELECT ctm_account FROM mapping GROUP BY 1 HAVING count(DISTINCT client_name) > 1)) AS keys_with_many"""))
def _(f: Frames) -> DataFrame:
    pre = voice_calls(f.ctm_calls)
    return Q.fanout_check(pre, with_client(pre, f.mapping), f.mapping, "ctm_account", "client_name")


@query("duplicate_ad_keys", "Q-02", sql("ad_policy", """
  SELECT customer_id, campaign_id, count(*) AS copies FROM ad_policy GROUP BY 1, 2 HAVING count(*) > 1"""))
def _(f: Frames) -> DataFrame:
    return Q.duplicate_keys(f.ad_policy, ["customer_id", "campaign_id"])


@query("suppressed_feed_rows", "Q-03", sql("line_spend", """
  SELECT channel, count(*) FILTER (channel = 'lsa') AS suppressed, count(*) AS total FROM line_spend
  WHERE channel IN ('bing', 'lsa') GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    return Q.suppressed_rows(f.feeds["other"], F.lower("channel").isin(list(SERVED_ELSEWHERE)), ["channel"])


@query("feed_parity", "Q-04", sql("spend_unified spend_months_daily", """
  WITH a AS (SELECT client, CAST(month(date) AS INTEGER) AS month, CAST(sum(actual) AS DOUBLE) AS v FROM spend_unified GROUP BY 1, 2),
  b AS (SELECT client, CAST(month(date) AS INTEGER) AS month, CAST(sum(actual) AS DOUBLE) AS v FROM spend_months_daily GROUP BY 1, 2)
  SELECT client, month, coalesce(a.v, 0.0) AS left_value, coalesce(b.v, 0.0) AS right_value,
    coalesce(a.v, 0.0) - coalesce(b.v, 0.0) AS delta, abs(coalesce(a.v, 0.0) - coalesce(b.v, 0.0)) <= 1000.0 AS within_tolerance
  FROM a FULL OUTER JOIN b USING (client, month)"""))
def _(f: Frames) -> DataFrame:
    def monthly(df: DataFrame) -> DataFrame:
        return df.groupBy("client", F.month("date").alias("month")).agg(F.sum("actual").cast("double").alias("value"))

    return Q.parity(monthly(f.spend_unified), monthly(f.spend_months_daily), ["client", "month"], "value", 1000.0)


@query("channel_coverage", "Q-05", sql("spend_unified", """
  SELECT e.channel, s.channel IS NOT NULL AS present
  FROM (SELECT unnest(['google_ads','lsa','bing','meta','nextdoor','yelp']) AS channel) e
  LEFT JOIN (SELECT DISTINCT channel FROM spend_unified) s ON e.channel = s.channel"""))
def _(f: Frames) -> DataFrame:
    return Q.channel_coverage(f.spend_unified)


@query("required_columns", "Q-06", sql("billing", """
  SELECT 'billing_setup_status' AS column_name, count(*) FILTER (billing_setup_status IS NULL) AS violations FROM billing
  UNION ALL SELECT 'account_budget_status', count(*) FILTER (account_budget_status IS NULL) FROM billing
  UNION ALL SELECT 'customer_id', count(*) FILTER (customer_id IS NULL) FROM billing"""))
def _(f: Frames) -> DataFrame:
    return Q.required_columns(f.billing, ["billing_setup_status", "account_budget_status", "customer_id"])


@query("data_gaps", "Q-07", sql("spend_combined", """
  WITH k AS (SELECT DISTINCT customer_id, platform FROM spend_combined),
  r AS (SELECT min(date_trunc('month', spend_date)) AS lo, max(date_trunc('month', spend_date)) AS hi FROM spend_combined),
  m AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS month FROM r),
  h AS (SELECT DISTINCT customer_id, platform, date_trunc('month', spend_date) AS month FROM spend_combined)
  SELECT k.customer_id, k.platform, strftime(m.month, '%Y-%m-%d') AS month FROM k, m
  WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.customer_id = k.customer_id AND h.platform = k.platform AND h.month = m.month)"""))
def _(f: Frames) -> DataFrame:
    return Q.data_gap(f.spend_combined, ["customer_id", "platform"], "spend_date")
