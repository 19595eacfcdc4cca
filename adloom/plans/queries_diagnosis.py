"""Account diagnosis: snapshots, waste, evidence, verdicts and the change ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adloom.functions import scalars as S
from adloom.operators import changes as C, diagnosis as D, verdicts as V
from adloom.plans.catalog import query
from adloom.plans.frames import Frames
from adloom.plans.oracle import AS_OF, RATES, day, sql


@query("campaign_types", "FLT-25", sql("line_spend", """
  SELECT CASE WHEN channel = 'lsa' THEN 'lsa' WHEN channel IN ('google_ads', 'meta') THEN 'brand' ELSE 'service' END AS campaign_type,
    count(*) AS rows FROM line_spend GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    kind = D.campaign_type(F.col("campaign_advertising_channel_type"), F.col("campaign_name"))
    return f.campaign_stats.groupBy(kind.alias("campaign_type")).agg(F.count(F.lit(1)).alias("rows"))


@query("account_type_daily", "AGG-39 MTH-03", sql("account_daily", f"SELECT * REPLACE ({day('snapshot_date')} AS snapshot_date) FROM account_daily"))
def _(f: Frames) -> DataFrame:
    return f.account_daily


@query("portfolio_medians", "AGG-38", sql("medians", "SELECT * FROM medians"))
def _(f: Frames) -> DataFrame:
    return D.portfolio_medians(f.account_30d)


@query("vs_portfolio", "WIN-14", sql("account_30d medians", """
  SELECT a.*, ctr / nullif(median_ctr, 0) AS ctr_vs_portfolio, cvr / nullif(median_cvr, 0) AS cvr_vs_portfolio
  FROM account_30d a JOIN medians m USING (campaign_type)"""))
def _(f: Frames) -> DataFrame:
    return D.vs_portfolio(f.account_30d, D.portfolio_medians(f.account_30d))


@query("account_snapshot", "OP-41 NUL-03", sql("account_daily mapping medians", f"""
  WITH r AS (SELECT *, {RATES} FROM account_daily WHERE snapshot_date = DATE '2024-01-15')
  SELECT {day('snapshot_date')} AS snapshot_date, r.account_id, r.campaign_type, spend, clicks, impressions, conversions, ctr, cvr, cpc, platform_cpa,
    m.monday_item_id AS client_key, ctr / nullif(median_ctr, 0) AS ctr_vs_portfolio, cvr / nullif(median_cvr, 0) AS cvr_vs_portfolio,
    '2024-01-31 12:00:00.000000' AS loaded_at, 'snapshot_daily' AS source_job
  FROM r LEFT JOIN mapping m ON m.google_ads_customer_id = r.account_id JOIN medians p ON p.campaign_type = r.campaign_type"""))
def _(f: Frames) -> DataFrame:
    return D.account_snapshot(f.account_daily, f.mapping, D.portfolio_medians(f.account_30d), F.to_date(F.lit("2024-01-15")), f.now)


@query("days_since_last_conversion", "WIN-13", sql("account_daily", f"""
  WITH d AS (SELECT account_id, snapshot_date, sum(clicks) AS clicks, sum(conversions) AS conversions FROM account_daily GROUP BY 1, 2),
  l AS (SELECT account_id, max(CASE WHEN conversions > 0 THEN snapshot_date END) AS last_conversion FROM d GROUP BY 1)
  SELECT account_id, {day('last_conversion')} AS last_conversion,
    CAST(coalesce(sum(CASE WHEN last_conversion IS NULL OR snapshot_date > last_conversion THEN clicks END), 0) AS BIGINT) AS clicks_since,
    CAST({AS_OF} - l.last_conversion AS INTEGER) AS days_since_last_conv
  FROM d JOIN l USING (account_id) GROUP BY account_id, l.last_conversion"""))
def _(f: Frames) -> DataFrame:
    return D.days_since_last_conversion(f.account_daily, f.as_of)


@query("tracking_states", "OP-41", sql("account_daily", f"""
  WITH d AS (SELECT account_id, snapshot_date, sum(clicks) AS clicks, sum(conversions) AS conversions FROM account_daily GROUP BY 1, 2),
  l AS (SELECT account_id, max(CASE WHEN conversions > 0 THEN snapshot_date END) AS last_conversion FROM d GROUP BY 1),
  s AS (SELECT account_id, CAST(coalesce(sum(CASE WHEN last_conversion IS NULL OR snapshot_date > last_conversion THEN clicks END), 0) AS BIGINT) AS clicks_since,
      CAST({AS_OF} - l.last_conversion AS INTEGER) AS days_since FROM d JOIN l USING (account_id) GROUP BY account_id, l.last_conversion)
  SELECT account_id, CASE WHEN clicks_since <= 200 THEN 'ok' WHEN coalesce(days_since, 1000000) > 14 THEN 'fail'
    WHEN coalesce(days_since, 1000000) >= 7 THEN 'warn' ELSE 'ok' END AS tracking_state FROM s"""))
def _(f: Frames) -> DataFrame:
    since = D.days_since_last_conversion(f.account_daily, f.as_of)
    return since.select("account_id", D.tracking_state(F.col("days_since_last_conv"), F.col("clicks_since")).alias("tracking_state"))


@query("waste_by_cause", "AGG-40", sql("terms", f"""
  SELECT account_id, campaign_type, CASE WHEN NOT term_visible THEN 'unattributable' WHEN relevance_class = 'irrelevant' THEN 'irrelevant_term'
      WHEN geo_bad THEN 'geo_nonconverting' WHEN hour_bad THEN 'hours_nonconverting' ELSE 'clean' END AS waste_cause,
    CAST(sum(spend) AS DOUBLE) AS spend_30d FROM terms WHERE spend_date >= {AS_OF} - 30 GROUP BY 1, 2, 3"""))
def _(f: Frames) -> DataFrame:
    return D.waste_by_cause(f.search_terms, f.as_of)


@query("masked_spend", "AGG-41", sql("terms", """
  SELECT *, masked_spend / nullif(visible_spend + masked_spend, 0) AS masked_spend_pct FROM (
    SELECT account_id, coalesce(CAST(sum(CASE WHEN term_visible THEN spend END) AS DOUBLE), 0.0) AS visible_spend,
      coalesce(CAST(sum(CASE WHEN NOT term_visible THEN spend END) AS DOUBLE), 0.0) AS masked_spend FROM terms GROUP BY 1)"""))
def _(f: Frames) -> DataFrame:
    return D.masked_spend(f.search_terms)


@query("relevant_ctr", "AGG-44", sql("terms", f"""
  SELECT account_id, campaign_type, CAST(c AS DOUBLE) / nullif(i, 0) AS relevant_ctr_visible, coalesce(s / nullif(t, 0), 0.0) AS relevant_ctr_coverage_pct
  FROM (SELECT account_id, campaign_type, CAST(sum(CASE WHEN g THEN clicks END) AS DOUBLE) AS c, CAST(sum(CASE WHEN g THEN impressions END) AS DOUBLE) AS i,
      CAST(sum(CASE WHEN g THEN spend END) AS DOUBLE) AS s, CAST(sum(spend) AS DOUBLE) AS t
    FROM (SELECT *, term_visible AND relevance_class = 'relevant' AS g FROM terms WHERE spend_date >= {AS_OF} - 30) GROUP BY 1, 2)"""))
def _(f: Frames) -> DataFrame:
    return D.relevant_ctr(f.search_terms, f.as_of)


@query("negative_conflicts", "JN-16", sql("terms", """
  WITH n AS (SELECT CAST(s_suppkey AS VARCHAR) AS account_id,
      CASE s_nationkey % 5 WHEN 0 THEN 'Ring' WHEN 1 THEN 'red widget' WHEN 2 THEN 'widget  promo' WHEN 3 THEN 'in' ELSE 'blue bolt small' END AS keyword
    FROM supplier),
  q AS (SELECT account_id, term, CAST(sum(conversions) AS BIGINT) AS conversions, CAST(sum(spend) AS DOUBLE) AS spend FROM terms
    WHERE conversions > 0 GROUP BY 1, 2)
  SELECT account_id, keyword, term, conversions, spend FROM q JOIN n USING (account_id)
  WHERE contains(' ' || lower(term) || ' ', ' ' || regexp_replace(lower(keyword), ' +', ' ', 'g') || ' ')"""))
def _(f: Frames) -> DataFrame:
    return D.negative_conflicts(f.negatives, f.search_terms)


@query("classifier_audit", "AGG-45", sql("terms", """
  WITH s AS (SELECT campaign_type AS v, relevance_class AS p, audited_class AS a FROM terms),
  p AS (SELECT v, p AS c, count(*) AS n, count(*) FILTER (p = a) AS hits FROM s GROUP BY 1, 2), t AS (SELECT v, a AS c, count(*) AS n FROM s GROUP BY 1, 2)
  SELECT coalesce(p.v, t.v) AS classifier_version, coalesce(p.c, t.c) AS relevance_class, coalesce(p.n, 0) AS sample_n,
    CAST(coalesce(hits, 0) AS DOUBLE) / nullif(coalesce(p.n, 0), 0) AS precision, CAST(coalesce(hits, 0) AS DOUBLE) / nullif(coalesce(t.n, 0), 0) AS recall
  FROM p FULL OUTER JOIN t ON p.v = t.v AND p.c = t.c"""))
def _(f: Frames) -> DataFrame:
    sample = f.search_terms.select(F.col("campaign_type").alias("classifier_version"), F.col("relevance_class").alias("predicted"),
                                   F.col("audited_class").alias("actual"))
    return D.classifier_audit(sample)


@query("quality_score_weighted", "AGG-43", sql("terms", """
  SELECT account_id, campaign_type, CAST(vw AS DOUBLE) / nullif(CAST(w AS DOUBLE), 0) AS weighted, coalesce(CAST(w AS DOUBLE) / nullif(CAST(t AS DOUBLE), 0), 0.0) AS coverage_pct
  FROM (SELECT account_id, campaign_type, sum(quality_score * spend) AS vw, sum(CASE WHEN quality_score IS NOT NULL THEN spend END) AS w, sum(spend) AS t
    FROM terms GROUP BY 1, 2)"""))
def _(f: Frames) -> DataFrame:
    return D.spend_weighted(f.search_terms, ["account_id", "campaign_type"], "quality_score")


@query("ad_strength_share", "AGG-46", sql("terms", """
  SELECT account_id, coalesce(CAST(sum(CASE WHEN ad_strength IN ('POOR', 'AVERAGE') THEN spend END) AS DOUBLE) / nullif(CAST(sum(spend) AS DOUBLE), 0), 0.0)
      AS ad_strength_poor_avg_spend_pct,
    CAST(count(*) FILTER (ad_strength IN ('POOR', 'AVERAGE', 'GOOD', 'EXCELLENT')) AS DOUBLE) / count(*) AS asset_label_coverage_pct
  FROM terms GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    return D.ad_strength_share(f.search_terms)


@query("worst_ads", "SRT-10", sql("terms", """
  SELECT account_id, ad_id, ad_strength, score FROM (
    SELECT *, CAST(spend AS DOUBLE) * CASE ad_strength WHEN 'POOR' THEN CAST(1.0 AS DOUBLE) WHEN 'AVERAGE' THEN CAST(0.5 AS DOUBLE)
      WHEN 'GOOD' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS score FROM terms)
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY score DESC, ad_id) <= 5"""))
def _(f: Frames) -> DataFrame:
    return D.worst_ads(f.search_terms, 5).select("account_id", "ad_id", "ad_strength", "score")


@query("qualified_calls", "AGG-37 DT-07", sql("phone_log", f"""
  SELECT account_id, {day('call_date')} AS call_date, count(*) AS calls, count(*) FILTER (seconds >= 60) AS qualified_calls,
    CAST(count(*) FILTER (answered) AS DOUBLE) / count(*) AS answer_rate FROM phone_log GROUP BY account_id, phone_log.call_date"""))
def _(f: Frames) -> DataFrame:
    return D.qualified_calls(f.phone_log)


_VERIFY = f"""SELECT a.account_id, coalesce(q, 0) AS qualified_calls, conversions, spend, CAST(coalesce(q, 0) AS DOUBLE) / nullif(conversions, 0) AS verification_ratio_30d,
    spend / nullif(coalesce(q, 0), 0) AS verified_cpa_30d
  FROM (SELECT account_id, CAST(sum(conversions) AS BIGINT) AS conversions, CAST(sum(CAST(spend AS DECIMAL(20,6))) AS DOUBLE) AS spend
    FROM account_daily WHERE snapshot_date >= {AS_OF} - 30 GROUP BY 1) a
  LEFT JOIN (SELECT CAST(account_id AS VARCHAR) AS account_id, count(*) FILTER (seconds >= 60) AS q FROM phone_log
    WHERE call_date >= {AS_OF} - 30 GROUP BY 1) c ON c.account_id = a.account_id"""


@query("verification", "AGG-42", sql("account_daily phone_log", _VERIFY))
def _(f: Frames) -> DataFrame:
    return D.verification(D.qualified_calls(f.phone_log), f.account_daily, f.as_of)


@query("budget_capped", "OP-43", sql("line_spend", f"""
  WITH s AS (SELECT campaign_id, date, CAST(sum(spend) AS DOUBLE) AS spend FROM line_spend GROUP BY 1, 2)
  SELECT campaign_id, {day('date')} AS date, spend, p_retailprice * 30 AS daily_budget, spend / nullif(p_retailprice * 30, 0) AS used
  FROM s JOIN part ON p_partkey = campaign_id WHERE spend / nullif(p_retailprice * 30, 0) >= 0.95"""))
def _(f: Frames) -> DataFrame:
    spend = f.line_spend.groupBy("campaign_id", "date").agg(
        F.sum("spend").cast("double").alias("spend"))
    budgets = f.table("part").select(F.col("p_partkey").alias("campaign_id"), (F.col("p_retailprice") * 30).alias("daily_budget"))
    return D.budget_capped(spend, budgets)


@query("impression_share_text", "STR-12", sql("terms", """
  SELECT DISTINCT raw, CASE WHEN contains(raw, '%') THEN CAST(regexp_extract(raw, '([0-9]+)', 1) AS DOUBLE) / 100 ELSE CAST(raw AS DOUBLE) END AS share,
    raw LIKE '<%' AS is_floored
  FROM (SELECT CASE WHEN clicks < 10 THEN '<10%' WHEN clicks < 30 THEN clicks || '%' ELSE '0.' || clicks END AS raw FROM terms)"""))
def _(f: Frames) -> DataFrame:
    clicks = F.col("clicks").cast("string")
    raw = (F.when(F.col("clicks") < 10, F.lit("<10%")).when(F.col("clicks") < 30, F.concat(clicks, F.lit("%")))
           .otherwise(F.concat(F.lit("0."), clicks)))
    rows = f.search_terms.select(raw.alias("raw")).distinct()
    return rows.select("raw", S.impression_share(F.col("raw")).alias("share"), S.is_floored(F.col("raw")).alias("is_floored"))


# ---- verdicts -------------------------------------------------------------------------------
@query("rule_verdicts", "OP-38", sql("verdicts", "SELECT * FROM verdicts"))
def _(f: Frames) -> DataFrame:
    return f.verdicts


@query("trusted_verdicts", "OP-39", sql("voided", "SELECT * FROM voided"))
def _(f: Frames) -> DataFrame:
    return V.trust_void(f.verdicts)


@query("account_state", "OP-40", sql("account_state", "SELECT * FROM account_state"))
def _(f: Frames) -> DataFrame:
    return V.account_state(V.trust_void(f.verdicts))


@query("upsell_headroom", "OP-44", sql("account_30d account_daily phone_log", f"""
  WITH s AS (SELECT account_id, CASE WHEN spend > 100000 THEN 'volume_fail_upsell' ELSE 'healthy' END AS verdict_family FROM ({_VERIFY})),
  x AS (SELECT account_id, verified_cpa_30d AS verified_cpa, CAST(conversions % 50 AS DOUBLE) / 100 AS lost_is_budget FROM ({_VERIFY}))
  SELECT x.*, lost_is_budget * verified_cpa * 0.5 AS headroom FROM x WHERE account_id IN (SELECT account_id FROM s WHERE verdict_family = 'volume_fail_upsell')"""))
def _(f: Frames) -> DataFrame:
    checked = D.verification(D.qualified_calls(f.phone_log), f.account_daily, f.as_of)
    state = checked.select("account_id", F.when(F.col("spend") > 100000, F.lit("volume_fail_upsell")).otherwise(F.lit("healthy"))
                           .alias("verdict_family"))
    snap = checked.select("account_id", F.col("verified_cpa_30d").alias("verified_cpa"),
                          ((F.col("conversions") % 50).cast("double") / 100).alias("lost_is_budget"))
    return D.upsell_headroom(state, snap)


# ---- changes --------------------------------------------------------------------------------
@query("daily_touches", "AGG-47", sql("changes", f"""
  SELECT account_id, changed_by, {day('change_date')} AS change_date, count(*) AS touches FROM changes GROUP BY account_id, changed_by, changes.change_date"""))
def _(f: Frames) -> DataFrame:
    return C.daily_touches(f.changes)


_SERIES = """SELECT account_id, 'spend' AS metric, snapshot_date, CAST(sum(CAST(spend AS DECIMAL(20,6))) AS DOUBLE) AS value FROM account_daily
    GROUP BY account_id, snapshot_date"""


def _series(f: Frames) -> DataFrame:
    return f.account_daily.groupBy("account_id", F.lit("spend").alias("metric"), "snapshot_date").agg(
        F.sum(F.col("spend").cast("decimal(20,6)")).cast("double").alias("value"))


_BASELINE = f"""SELECT *, CAST(sum(CAST(value AS DECIMAL(20,6))) OVER w AS DOUBLE) / nullif(count(value) OVER w, 0) AS baseline FROM ({_SERIES})
  WINDOW w AS (PARTITION BY account_id, metric ORDER BY snapshot_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"""


@query("trailing_baseline", "WIN-11", sql("account_daily", f"SELECT * REPLACE ({day('snapshot_date')} AS snapshot_date) FROM ({_BASELINE})"))
def _(f: Frames) -> DataFrame:
    return C.trailing_baseline(_series(f))


@query("overlapping_windows", "OP-42", sql("changes", """
  SELECT change_id, account_id, target_metric,
    coalesce(window_opens - lag(window_opens) OVER w <= 13, false) OR coalesce(lead(window_opens) OVER w - window_opens <= 13, false) AS attribution_ambiguous
  FROM changes WINDOW w AS (PARTITION BY account_id, target_metric ORDER BY window_opens, change_id)"""))
def _(f: Frames) -> DataFrame:
    return C.mark_overlaps(f.changes).select("change_id", "account_id", "target_metric", "attribution_ambiguous")


_CHECKS = f"""WITH b AS ({_BASELINE}),
  k AS (SELECT change_id, c.account_id, change_date AS check_date, b.value AS metric_value, b.baseline AS baseline_value,
      CASE WHEN target_metric = 'ctr' THEN 'up' ELSE 'down' END AS expected_direction, b.value * 0.9 AS guardrail_value, b.baseline AS guardrail_baseline,
      'down' AS guardrail_direction FROM changes c JOIN b ON b.account_id = c.account_id AND b.snapshot_date = c.change_date),
  r AS (SELECT *, (metric_value - baseline_value) / nullif(abs(baseline_value), 0) AS vs_baseline,
      (guardrail_value - guardrail_baseline) / nullif(abs(guardrail_baseline), 0) AS guardrail_vs_baseline FROM k),
  g AS (SELECT *, CASE expected_direction WHEN 'down' THEN -vs_baseline ELSE vs_baseline END AS good FROM r),
  checked AS (SELECT * EXCLUDE (good), CASE WHEN vs_baseline IS NULL THEN NULL WHEN good > 0.05 THEN 'on_track' WHEN good < -0.05 THEN 'worse' ELSE 'drifting' END AS check_result,
      CASE WHEN coalesce(-guardrail_vs_baseline > 0.10, false) THEN 'collateral_worse' ELSE 'ok' END AS guardrail_result FROM g)"""


def _checked(f: Frames) -> DataFrame:
    base = C.trailing_baseline(_series(f)).withColumnRenamed("snapshot_date", "change_date")
    rows = f.changes.join(base.select("account_id", "change_date", "value", "baseline"), ["account_id", "change_date"]).select(
        "change_id", "account_id", F.col("change_date").alias("check_date"), F.col("value").alias("metric_value"),
        F.col("baseline").alias("baseline_value"),
        F.when(F.col("target_metric") == "ctr", F.lit("up")).otherwise(F.lit("down")).alias("expected_direction"),
        (F.col("value") * 0.9).alias("guardrail_value"), F.col("baseline").alias("guardrail_baseline"),
        F.lit("down").alias("guardrail_direction"))
    return C.change_window_check(rows)


@query("change_window_check", "OP-42", sql("changes account_daily", f"""{_CHECKS}
  SELECT * REPLACE ({day('check_date')} AS check_date) FROM checked"""))
def _(f: Frames) -> DataFrame:
    return _checked(f)


_WEEKLY = f"""WITH b AS ({_BASELINE}),
  p AS (SELECT change_id, account_id, target_metric, CAST(unnest(generate_series(window_opens, window_closes, INTERVAL 7 DAY)) AS DATE) AS check_date
    FROM changes WHERE window_opens <= window_closes),
  k AS (SELECT change_id, p.account_id, check_date, b.value AS metric_value, b.baseline AS baseline_value,
      CASE WHEN target_metric = 'ctr' THEN 'up' ELSE 'down' END AS expected_direction, b.value * 0.9 AS guardrail_value, b.baseline AS guardrail_baseline
    FROM p ASOF LEFT JOIN b ON p.account_id = b.account_id AND p.check_date >= b.snapshot_date),
  r AS (SELECT *, (metric_value - baseline_value) / nullif(abs(baseline_value), 0) AS vs_baseline,
      (guardrail_value - guardrail_baseline) / nullif(abs(guardrail_baseline), 0) AS guardrail_vs_baseline FROM k),
  g AS (SELECT *, CASE expected_direction WHEN 'down' THEN -vs_baseline ELSE vs_baseline END AS good FROM r),
  checked AS (SELECT *, CASE WHEN vs_baseline IS NULL THEN NULL WHEN good > 0.05 THEN 'on_track' WHEN good < -0.05 THEN 'worse' ELSE 'drifting' END AS check_result,
      CASE WHEN coalesce(-guardrail_vs_baseline > 0.10, false) THEN 'collateral_worse' ELSE 'ok' END AS guardrail_result FROM g)"""


@query("early_breaks", "WIN-12 OP-42", sql("changes account_daily", f"""{_WEEKLY},
  w AS (SELECT *, (check_result = 'worse' AND lag(check_result) OVER o = 'worse')
      OR (guardrail_result = 'collateral_worse' AND lag(guardrail_result) OVER o = 'collateral_worse') AS broke FROM checked
    WINDOW o AS (PARTITION BY change_id ORDER BY check_date))
  SELECT change_id, bool_or(coalesce(broke, false)) AS broke_open_early, {day('min(CASE WHEN broke THEN check_date END)')} AS broke_on FROM w GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    """Every change gets its own weekly checks over its window, each against the account's latest value and
    baseline at that date; changes of one account with overlapping windows break independently."""
    series = C.trailing_baseline(_series(f))
    checks = C.weekly_checks(f.changes, series).select(
        "change_id", "account_id", "check_date", F.col("value").alias("metric_value"), F.col("baseline").alias("baseline_value"),
        F.when(F.col("target_metric") == "ctr", F.lit("up")).otherwise(F.lit("down")).alias("expected_direction"),
        (F.col("value") * 0.9).alias("guardrail_value"), F.col("baseline").alias("guardrail_baseline"),
        F.lit("down").alias("guardrail_direction"))
    return C.consecutive_breach(C.change_window_check(checks).select("change_id", "check_date", "check_result", "guardrail_result"))
