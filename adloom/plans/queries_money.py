"""Spend products, budgets and pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from adloom.functions import labels as L, scalars as S
from adloom.operators import budget as B, pacing as P, quality as Q, spend as SP
from adloom.plans.catalog import query
from adloom.plans.frames import PACING_MONTH, PACING_YEAR, Frames, client_name
from adloom.plans.oracle import AS_OF, day, name_of, sql, stamp
from adloom.session import work_dir
from adloom.sinks import tables as T
from adloom.sources.sheets import read_committed_sheet

_MONTHS = ", ".join(f"m{m}" for m in range(1, 13))
_LABEL = ("CASE channel WHEN 'google_ads' THEN 'Google Ads' WHEN 'lsa' THEN 'LSA' WHEN 'bing' THEN 'Bing' "
          "WHEN 'meta' THEN 'Meta' WHEN 'nextdoor' THEN 'Nextdoor' WHEN 'yelp' THEN 'Yelp' ELSE channel END")


def dec(col: str, alias: str | None = None) -> str:
    return f"CAST({col} AS DOUBLE) AS {alias or col}"


# ---- spend products -------------------------------------------------------------------------
@query("spend_union", "SET-04", sql("feed_rows", """
  SELECT channel, customer_id, count(*) AS rows, CAST(sum(spend) AS DOUBLE) AS spend FROM feed_rows GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    return SP.spend_union(f.feeds).groupBy("channel", "customer_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("spend").alias("spend"))


_UNIFIED = """SELECT r.date, coalesce(x.canonical_client, 'UNMAPPED: ' || r.account_name) AS client, r.channel, sum(r.spend) AS actual
  FROM feed_rows r LEFT JOIN crosswalk x ON r.customer_id = x.customer_id GROUP BY 1, 2, 3"""


@query("spend_daily_unified", "OP-22 JN-14", sql("feed_rows crosswalk", f"""
  SELECT {day('date')} AS date, client, channel, CAST(actual AS DOUBLE) AS actual FROM ({_UNIFIED})"""))
def _(f: Frames) -> DataFrame:
    return SP.spend_daily_unified(f.feeds, f.crosswalk)


@query("spend_combined", "OP-22", sql("feed_rows", f"""
  SELECT customer_id, CASE channel WHEN 'google_ads' THEN 'google' ELSE channel END AS platform, {day('date')} AS spend_date,
    CAST(sum(spend) AS DOUBLE) AS spend FROM feed_rows GROUP BY customer_id, channel, date"""))
def _(f: Frames) -> DataFrame:
    return SP.spend_combined(f.feeds)


@query("actual_spend_all", "OP-23", sql("feed_rows crosswalk", f"""
  SELECT client, channel, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(sum(actual) AS DOUBLE) AS actual
  FROM ({_UNIFIED}) GROUP BY 1, 2, 3, 4"""))
def _(f: Frames) -> DataFrame:
    return SP.actual_spend_all(SP.spend_daily_unified(f.feeds, f.crosswalk))


@query("actual_spend_mtd", "OP-23", sql("feed_rows crosswalk", f"""
  SELECT client, channel, CAST(sum(actual) AS DOUBLE) AS spent_mtd FROM ({_UNIFIED})
  WHERE date BETWEEN DATE '2024-01-01' AND {AS_OF} GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    return SP.actual_spend_mtd(SP.spend_daily_unified(f.feeds, f.crosswalk), f.as_of)


@query("source_groups", "PRJ-06", sql("", """
  SELECT n AS source_group, count(*) AS clients FROM (
    SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Other'
                WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE 'Main' END AS n FROM customer) GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    account = (F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.concat(F.lit("Other - "), "c_name"))
               .when(F.col("c_mktsegment") == "HOUSEHOLD", F.col("c_name")).otherwise(F.concat(F.lit("Main "), "c_name")))
    return f.table("customer").groupBy(SP.source_group(account, {"Other -": "Other", "Main ": "Main"}).alias("source_group")).agg(
        F.count(F.lit(1)).alias("clients"))


@query("rolling_months", "FLT-26", sql("spend_unified", """
  SELECT client, channel, CAST(sum(actual) AS DOUBLE) AS actual FROM spend_unified
  WHERE date BETWEEN DATE '2023-07-01' AND DATE '2024-01-31' GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    rows = SP.rolling_months(f.spend_unified, "date", F.to_date(F.lit("2023-10-15")))
    return rows.groupBy("client", "channel").agg(F.sum("actual").alias("actual"))


@query("crosswalk_from_mapping", "OP-45", sql("mapping", """
  SELECT client_name, 'google_ads' AS channel, google_ads_customer_id AS customer_id FROM mapping WHERE trim(google_ads_customer_id) <> ''
  UNION ALL SELECT client_name, 'calls', CAST(ctm_account AS VARCHAR) FROM mapping"""))
def _(f: Frames) -> DataFrame:
    return SP.crosswalk_from_mapping(f.mapping, {"google_ads": "google_ads_customer_id", "calls": "ctm_account"})


@query("id_universe_diff", "SET-06", sql("", """
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS customer_id FROM orders
  WHERE o_custkey NOT IN (SELECT l_suppkey FROM lineitem)"""))
def _(f: Frames) -> DataFrame:
    return Q.ids_missing(f.call_assets, f.spend_combined, "customer_id")


@query("normalized_name_join", "JN-13", sql("pacing mapping", """
  SELECT p.client, p.channel, p.month, p.committed, m.account_manager FROM pacing p
  LEFT JOIN mapping m ON lower(trim(p.client)) = lower(trim('  ' || upper(m.client_name) || ' '))"""))
def _(f: Frames) -> DataFrame:
    messy = f.mapping.select(F.concat(F.lit("  "), F.upper("client_name"), F.lit(" ")).alias("client_name"), "account_manager")
    joined = SP.join_by_normalized_name(f.pacing, "client", messy, "client_name")
    return joined.select("client", "channel", "month", "committed", "account_manager")


# ---- budgets --------------------------------------------------------------------------------
@query("live_events", "JN-09", sql("live_events", "SELECT event_id, client, channel, year, month, CAST(amount AS DOUBLE) AS amount FROM live_events"))
def _(f: Frames) -> DataFrame:
    return B.live_events(f.budget_events, f.tombstones).select("event_id", *B.CELL, "amount")


@query("latest_budget_event", "WIN-08 WIN-03", sql("latest_events", f"""
  SELECT event_id, client, channel, year, month, {dec('amount')}, event_type, {stamp('changed_at')} AS changed_at FROM latest_events"""))
def _(f: Frames) -> DataFrame:
    return B.latest_budget_event(f.budget_events, f.tombstones).select(
        "event_id", *B.CELL, "amount", "event_type", "changed_at")


@query("budget_base_current", "OP-21 SRC-14", sql("base_current", f"""
  SELECT client, channel, year, month, {dec('base_amount')}, source FROM base_current"""))
def _(f: Frames) -> DataFrame:
    return f.base_current


@query("committed_sheet", "SRC-14", sql("order_cells", """
  SELECT client, channel, year, month, CAST(amount AS DOUBLE) AS amount FROM order_cells WHERE event_type <> 'delete'"""))
def _(f: Frames) -> DataFrame:
    raw = f.order_cells.select(
        "client", "channel", F.concat(F.lit(" "), F.col("year").cast("string")).alias("year"),
        F.when(F.col("event_type") == "delete", F.lit("n/a")).otherwise(F.col("month").cast("string")).alias("month"), "amount")
    return read_committed_sheet(raw)


@query("source_mix", "AGG-36", sql("base_current", """
  SELECT source, count(DISTINCT client) AS clients, count(*) AS rows FROM base_current GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    return B.source_mix(f.base_current)


@query("event_history", "OP-19 SRT-07", sql("live_events", f"""
  SELECT event_id, client, channel, year, month, {dec('amount')}, alloc_type, event_type, changed_by,
    {stamp('changed_at')} AS changed_at, note FROM live_events ORDER BY live_events.changed_at DESC, event_id DESC LIMIT 200"""))
def _(f: Frames) -> DataFrame:
    return B.event_history(f.budget_events, f.tombstones)


@query("event_filter", "FLT-16", sql("live_events", """
  SELECT event_id, client, note FROM live_events WHERE channel = 'bing' AND changed_by = 'user3@example.com'
    AND (contains(lower(client), 'medium') OR contains(lower(note), 'medium'))"""))
def _(f: Frames) -> DataFrame:
    live = B.live_events(f.budget_events, f.tombstones)
    return B.event_filter(live, channel="bing", user="user3@example.com", q="MEDIUM").select("event_id", "client", "note")


@query("month_range_events", "OP-20", sql("order_cells", """
  SELECT event_id, client, channel, year, CAST(unnest(generate_series(month, 12)) AS INTEGER) AS month, 'create' AS event_type
  FROM order_cells"""))
def _(f: Frames) -> DataFrame:
    rows = f.order_cells.select("event_id", "client", "channel", "year", F.col("month").alias("month_from"),
                                F.lit(12).alias("month_to"))
    return B.expand_month_range(rows)


@query("large_changes", "FLT-24", sql("budget_events sheet", """
  SELECT event_id, coalesce(current > 0 AND (e.amount = 0 OR abs(CAST(e.amount - current AS DOUBLE)) / CAST(current AS DOUBLE) > 0.5), false)
    AS is_large
  FROM budget_events e LEFT JOIN (SELECT client, channel, year, month, sum(amount) AS current FROM sheet GROUP BY 1, 2, 3, 4) s
    ON e.client = s.client AND e.channel = s.channel AND e.year = s.year AND e.month = s.month"""))
def _(f: Frames) -> DataFrame:
    current = f.sheet_typed.groupBy(*B.CELL).agg(F.sum("amount").alias("current"))
    rows = f.budget_events.join(current, B.CELL, "left")
    return rows.select("event_id", B.large_change(F.col("current"), F.col("amount")).alias("is_large"))


@query("validated_events", "FLT-19", sql("order_cells", """
  WITH e AS (SELECT event_id, CASE WHEN order_key % 7 = 0 THEN '  ' ELSE client END AS client, channel, year + 25 AS year,
      CASE WHEN order_key % 11 = 0 THEN 13 ELSE month END AS month,
      CASE WHEN order_key % 13 = 0 THEN 'abc' ELSE CAST(amount AS VARCHAR) END AS amount,
      CASE WHEN o_orderstatus = 'F' THEN 'void' ELSE event_type END AS event_type FROM order_cells)
  SELECT event_id, CASE WHEN trim(client) = '' THEN 'client is required'
    WHEN year NOT BETWEEN 2020 AND 2100 THEN 'year must be a valid integer' WHEN month NOT BETWEEN 1 AND 12 THEN 'month must be 1-12'
    WHEN TRY_CAST(amount AS DOUBLE) IS NULL THEN 'amount must be a number'
    WHEN event_type NOT IN ('create', 'update', 'delete') THEN 'event_type must be one of create, update, delete' END AS error FROM e"""))
def _(f: Frames) -> DataFrame:
    key = F.col("order_key")
    rows = f.order_cells.select(
        "event_id", F.when(key % 7 == 0, F.lit("  ")).otherwise(F.col("client")).alias("client"), "channel",
        (F.col("year") + 25).alias("year"), F.when(key % 11 == 0, F.lit(13)).otherwise(F.col("month")).alias("month"),
        F.when(key % 13 == 0, F.lit("abc")).otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(F.col("o_orderstatus") == "F", F.lit("void")).otherwise(F.col("event_type")).alias("event_type"))
    return B.validate_event(rows).select("event_id", "error")


@query("recorded_budget_edits", "FLT-19 SNK-05", sql("order_cells", """
  WITH e AS (SELECT event_id, CASE WHEN order_key % 7 = 0 THEN '  ' ELSE ' ' || client || ' ' END AS client, channel, year + 25 AS year,
      CASE WHEN order_key % 11 = 0 THEN 13 ELSE month END AS month,
      CASE WHEN order_key % 13 = 0 THEN 'abc' ELSE CAST(amount AS VARCHAR) END AS amount,
      CASE WHEN o_orderstatus = 'F' THEN 'void' ELSE event_type END AS event_type FROM order_cells)
  SELECT event_id, trim(client) AS client, channel, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month,
    CAST(amount AS DOUBLE) AS amount, event_type, 'editor@example.com' AS changed_by FROM e
  WHERE trim(client) <> '' AND year BETWEEN 2020 AND 2100 AND month BETWEEN 1 AND 12 AND TRY_CAST(amount AS DOUBLE) IS NOT NULL
    AND event_type IN ('create', 'update', 'delete')"""))
def _(f: Frames) -> DataFrame:
    """Edits with holes and padded names recorded in three requests: all of them, a retry of the same
    request (same batch id), and a retry of the valid half under a new batch id; the log holds each valid
    edit once, trimmed and stamped by the server."""
    key = F.col("order_key")
    edits = f.order_cells.select(
        "event_id", F.when(key % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("client"), F.lit(" "))).alias("client"), "channel",
        (F.col("year") + 25).alias("year"), F.when(key % 11 == 0, F.lit(13)).otherwise(F.col("month")).alias("month"),
        F.when(key % 13 == 0, F.lit("abc")).otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(F.col("o_orderstatus") == "F", F.lit("void")).otherwise(F.col("event_type")).alias("event_type"),
        F.lit("someone.else@example.com").alias("changed_by"))
    log = work_dir(f.spark, "budget-log")
    editor, now = F.lit("editor@example.com"), F.lit("2024-01-31 12:00:00").cast("timestamp")
    B.record_edits(log, edits, editor, now, batch="request-1")
    B.record_edits(log, edits, editor, now, batch="request-1")
    B.record_edits(log, edits.where(key % 2 == 0), editor, now, batch="request-2")
    rows = T.read_log(f.spark, log, StructType.fromDDL(B.EDIT_SCHEMA))
    return rows.select("event_id", "client", "channel", "year", "month", F.col("amount").cast("double").alias("amount"), "event_type", "changed_by")


@query("validated_tombstones", "FLT-23", sql("order_cells", """
  WITH t AS (SELECT changed_by || '-' || year AS batch_id, CASE WHEN event_type = 'delete' THEN 'x' || event_id ELSE event_id END AS event_id
    FROM order_cells),
  n AS (SELECT batch_id, count(*) AS size FROM t GROUP BY 1)
  SELECT batch_id, event_id, CASE WHEN size > 100 THEN 'Max 100 events per delete'
    WHEN NOT regexp_full_match(event_id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN 'Invalid event_id' END AS error
  FROM t JOIN n USING (batch_id)"""))
def _(f: Frames) -> DataFrame:
    rows = f.order_cells.select(
        F.concat_ws("-", "changed_by", "year").alias("batch_id"),
        F.when(F.col("event_type") == "delete", F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id")).alias("event_id"))
    return B.validate_tombstones(rows)


_MATRIX = "SELECT client, channel, " + ", ".join(
    f"CAST(sum(CASE WHEN month = {m} THEN base_amount ELSE 0 END) AS DOUBLE) AS m{m}" for m in range(1, 13)
) + f", CAST(sum(base_amount) AS DOUBLE) AS row_total FROM base_current WHERE year = {PACING_YEAR} AND month BETWEEN 1 AND 12 GROUP BY 1, 2"


@query("budget_matrix", "AGG-10", sql("base_current", _MATRIX))
def _(f: Frames) -> DataFrame:
    return B.budget_matrix(f.base_current, PACING_YEAR)


@query("budget_summary", "AGG-11", sql("base_current", f"""
  SELECT count(DISTINCT client) AS clients, count(*) AS lines, CAST(round(sum(v), 2) AS DOUBLE) AS total_committed,
    CAST(round(sum(v), 2) AS DOUBLE) / 12 AS monthly_average
  FROM (SELECT client, channel, sum(base_amount) AS v FROM base_current WHERE year = {PACING_YEAR} GROUP BY 1, 2)"""))
def _(f: Frames) -> DataFrame:
    return B.budget_summary(B.budget_matrix(f.base_current, PACING_YEAR))


@query("budget_client_totals", "AGG-12", sql("base_current", f"""
  SELECT client, '__total__' AS channel, """ + ", ".join(
    f"CAST(sum(CASE WHEN month = {m} THEN base_amount ELSE 0 END) AS DOUBLE) AS m{m}" for m in range(1, 13)) + f""",
    CAST(sum(base_amount) AS DOUBLE) AS row_total FROM base_current WHERE year = {PACING_YEAR} GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    return B.client_totals(B.budget_matrix(f.base_current, PACING_YEAR))


@query("budget_view_totals", "FLT-16 AGG-12", sql("base_current", f"""
  SELECT count(*) AS lines, coalesce(CAST(sum(v) AS DOUBLE), 0.0) AS committed FROM (SELECT client, channel, sum(base_amount) AS v FROM base_current
    WHERE year = {PACING_YEAR} AND channel = 'meta' AND contains(lower(client), 'customer#0000000') GROUP BY 1, 2)"""))
def _(f: Frames) -> DataFrame:
    return B.view_totals(B.budget_filter(B.budget_matrix(f.base_current, PACING_YEAR), "meta", "Customer#0000000"))


@query("budget_sorted", "SRT-06", sql("base_current", f"SELECT client, channel, m3, row_total FROM ({_MATRIX})"))
def _(f: Frames) -> DataFrame:
    matrix = B.budget_matrix(f.base_current, PACING_YEAR)
    return B.sort_by(matrix, "m3", descending=True).select("client", "channel", "m3", "row_total")


# ---- pacing ---------------------------------------------------------------------------------
@query("pacing_api", "OP-06 AGG-04 JN-06 DT-01", sql("pacing", "SELECT * FROM pacing"))
def _(f: Frames) -> DataFrame:
    return f.pacing


@query("committed_by_month", "AGG-04", sql("order_cells", """
  SELECT client, channel, year, month, CAST(sum(amount) AS DOUBLE) AS committed FROM order_cells GROUP BY 1, 2, 3, 4"""))
def _(f: Frames) -> DataFrame:
    return P.committed_by_month(f.committed)


@query("coerced_pacing_rows", "PRJ-03 NUL-04", sql("pacing", """
  SELECT client, channel, year, month, CASE WHEN channel = 'bing' THEN 0.0 ELSE committed END AS committed, actual FROM pacing"""))
def _(f: Frames) -> DataFrame:
    text = f.pacing.select(
        "client", "channel", *[F.col(c).cast("string").alias(c) for c in ("year", "month", "actual")],
        F.when(F.col("channel") == "bing", F.lit("n/a")).otherwise(F.col("committed").cast("string")).alias("committed"))
    return P.coerce_pacing_rows(text)


_MONTH = f"""SELECT client, coalesce(CAST(sum(CASE WHEN month = {PACING_MONTH} THEN CAST(committed AS DECIMAL(18,4)) END) AS DOUBLE), 0.0) AS committed,
    coalesce(CAST(sum(CASE WHEN month = {PACING_MONTH} THEN CAST(actual AS DECIMAL(18,4)) END) AS DOUBLE), 0.0) AS actual
  FROM pacing GROUP BY 1"""
_MONTH_FULL = f"""SELECT *, actual - committed AS variance, CASE WHEN committed <> 0 THEN actual / committed ELSE 0.0 END AS pct,
    committed = 0 AND actual > 0 AS unbudgeted FROM ({_MONTH})"""
_STATUS = "CASE WHEN pct > 1.08 THEN 'Overspending' WHEN pct < 0.92 THEN 'Underspending' ELSE 'On track' END"


@query("month_pacing", "AGG-13 OP-07", sql("pacing", f"SELECT *, {_STATUS} AS status FROM ({_MONTH_FULL})"))
def _(f: Frames) -> DataFrame:
    return P.month_pacing(f.pacing, PACING_MONTH).withColumn("status", P.pacing_status(F.col("pct")))


def _year(rows: str) -> str:
    return f"""SELECT *, spent_ytd - committed_ytd AS ytd_variance, CASE WHEN committed_ytd <> 0 THEN spent_ytd / committed_ytd ELSE 0.0 END AS ytd_pct,
      full_year_committed - spent_ytd AS remaining FROM (
    SELECT client, CAST(sum(CAST(committed AS DECIMAL(18,4))) AS DOUBLE) AS full_year_committed,
      coalesce(CAST(sum(CASE WHEN month <= {PACING_MONTH} THEN CAST(committed AS DECIMAL(18,4)) END) AS DOUBLE), 0.0) AS committed_ytd,
      coalesce(CAST(sum(CASE WHEN month <= {PACING_MONTH} THEN CAST(actual AS DECIMAL(18,4)) END) AS DOUBLE), 0.0) AS spent_ytd
    FROM {rows} GROUP BY 1)"""


@query("year_pacing", "AGG-14 OP-08", sql("pacing", f"""
  SELECT *, CASE WHEN ytd_pct > 1.05 THEN 'over' WHEN ytd_pct < 0.95 THEN 'under' ELSE 'on' END AS status FROM ({_year('pacing')})"""))
def _(f: Frames) -> DataFrame:
    return P.year_pacing(f.pacing, PACING_MONTH).withColumn("status", P.year_status(F.col("ytd_pct")))


_CHANNELS = f"""SELECT client, channel, CAST(sum(CAST(committed AS DECIMAL(18,4))) AS DOUBLE) AS committed,
    CAST(sum(CAST(actual AS DECIMAL(18,4))) AS DOUBLE) AS actual FROM pacing WHERE month = {PACING_MONTH} GROUP BY 1, 2"""


@query("channel_breakdown", "AGG-15 PRJ-04", sql("pacing", f"""
  SELECT *, actual - committed AS variance, {_LABEL} AS channel_label FROM ({_CHANNELS})"""))
def _(f: Frames) -> DataFrame:
    return P.channel_breakdown(f.pacing, PACING_MONTH)


@query("pacing_overview", "AGG-16", sql("pacing", f"""
  SELECT *, actual - committed AS variance FROM (
    SELECT CAST(sum(CAST(committed AS DECIMAL(18,4))) AS DOUBLE) AS committed, CAST(sum(CAST(actual AS DECIMAL(18,4))) AS DOUBLE) AS actual,
      count(*) FILTER (pct BETWEEN 0.92 AND 1.08) AS on_track, count(*) AS clients FROM ({_MONTH_FULL}))"""))
def _(f: Frames) -> DataFrame:
    return P.pacing_overview(f.pacing, PACING_MONTH)


_EXCEPTIONS = f"SELECT {name_of('c_custkey')} AS client, 'lsa' AS channel FROM customer WHERE c_mktsegment = 'BUILDING'"
_STARTS = f"SELECT {name_of('c_custkey')} AS client, 5 AS start_month FROM customer WHERE c_acctbal > 5000"


def _exceptions(f: Frames) -> DataFrame:
    return f.table("customer").filter("c_mktsegment = 'BUILDING'").select(
        client_name("c_custkey").alias("client"), F.lit("lsa").alias("channel"))


def _starts(f: Frames) -> DataFrame:
    return f.table("customer").filter("c_acctbal > 5000").select(
        client_name("c_custkey").alias("client"), F.lit(5).alias("start_month"))


@query("year_pacing_managed", "AGG-17 FLT-12 FLT-13", sql("pacing", f"""
  WITH x AS ({_EXCEPTIONS}), st AS ({_STARTS}),
  managed AS (SELECT p.* FROM pacing p LEFT JOIN st USING (client)
    WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.client = p.client AND x.channel = p.channel) AND p.month >= coalesce(start_month, 1))
  {_year('managed')}"""))
def _(f: Frames) -> DataFrame:
    return P.year_pacing_managed(f.pacing, _starts(f), _exceptions(f), PACING_MONTH)


@query("status_actual", "AGG-18 FLT-13", sql("pacing", f"""
  WITH x AS ({_EXCEPTIONS})
  SELECT client, CAST(sum(CAST(actual AS DECIMAL(18,4))) AS DOUBLE) AS actual FROM pacing p
  WHERE month = {PACING_MONTH} AND NOT EXISTS (SELECT 1 FROM x WHERE x.client = p.client AND x.channel = p.channel) GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    return P.status_actual(f.pacing, _exceptions(f), PACING_MONTH)


@query("pacing_context", "OP-09", sql("pacing", f"""
  WITH m AS ({_MONTH_FULL}), y AS ({_year('pacing')}),
  c AS (SELECT client, string_agg(channel || ':' || CAST(round(committed) AS BIGINT) || ':' || CAST(round(actual) AS BIGINT) || ':'
      || CAST(round(actual - committed) AS BIGINT), '|' ORDER BY channel) AS channels FROM ({_CHANNELS}) GROUP BY 1)
  SELECT m.client, CAST(round(committed) AS BIGINT) AS committed_month, CAST(round(actual) AS BIGINT) AS actual_month,
    CAST(round(variance) AS BIGINT) AS variance_month, round(pct, 3) AS pacing_pct_month, coalesce(channels, '') AS channels,
    CAST(round(committed_ytd) AS BIGINT) AS committed_to_date, CAST(round(spent_ytd) AS BIGINT) AS spent_to_date,
    CAST(round(ytd_variance) AS BIGINT) AS ytd_variance, CAST(round(full_year_committed) AS BIGINT) AS full_year_committed,
    CAST(round(remaining) AS BIGINT) AS remaining_pool
  FROM m JOIN y USING (client) LEFT JOIN c USING (client)"""))
def _(f: Frames) -> DataFrame:
    out = P.pacing_context(f.pacing, PACING_MONTH)
    line = F.transform("channels", lambda c: F.concat_ws(":", c.channel, c.committed, c.actual, c.variance))
    return out.select("client", "committed_month", "actual_month", "variance_month", "pacing_pct_month",
                      F.array_join(line, "|").alias("channels"), "year.*")


_ROLL = """SELECT *, coalesce(sum(base - actual) OVER (PARTITION BY client, channel, year ORDER BY month
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rollover_in
  FROM (SELECT coalesce(b.client, a.client) AS client, coalesce(b.channel, a.channel) AS channel, coalesce(b.year, a.year) AS year,
      coalesce(b.month, a.month) AS month, coalesce(b.base, 0) AS base, coalesce(a.actual, 0) AS actual
    FROM (SELECT client, channel, year, month, sum(base_amount) AS base FROM base_current GROUP BY 1, 2, 3, 4) b
    FULL OUTER JOIN actual_months a ON b.client = a.client AND b.channel = a.channel AND b.year = a.year AND b.month = a.month)"""


@query("budget_rollover", "WIN-07", sql("base_current actual_months", f"""
  SELECT client, channel, year, month, {dec('base')}, {dec('actual')}, {dec('rollover_in')}, CAST(base + rollover_in AS DOUBLE) AS available
  FROM ({_ROLL})"""))
def _(f: Frames) -> DataFrame:
    return P.rollover(f.base_current, f.actual_months)


@query("pacing_live", "OP-24 DT-08", sql("base_current actual_months spend_months_daily crosswalk", """
  WITH p AS (SELECT coalesce(c.client, a.client) AS client, coalesce(c.channel, a.channel) AS channel, coalesce(c.month, a.month) AS month,
      CAST(coalesce(c.committed, 0) AS DOUBLE) AS committed, CAST(coalesce(a.actual, 0) AS DOUBLE) AS actual
    FROM (SELECT client, channel, year, month, sum(base_amount) AS committed FROM base_current WHERE year = 1998 GROUP BY 1, 2, 3, 4) c
    FULL OUTER JOIN (SELECT * FROM actual_months WHERE year = 1998) a ON c.client = a.client AND c.channel = a.channel AND c.month = a.month),
  o AS (SELECT canonical_client AS client, min(account_manager) AS account_manager, min(source_group) AS source_group
    FROM crosswalk WHERE active GROUP BY 1),
  t AS (SELECT client, channel, CAST(sum(actual) AS DOUBLE) AS spent_mtd FROM spend_months_daily
    WHERE date BETWEEN DATE '1998-06-01' AND DATE '1998-06-14' GROUP BY 1, 2)
  SELECT p.client, p.channel, CAST(1998 AS INTEGER) AS year, p.month, committed, actual, account_manager, source_group,
    CASE WHEN month = 6 THEN coalesce(spent_mtd, 0.0) END AS spent_mtd, CAST(30 AS INTEGER) AS days_in_month, CAST(14 AS INTEGER) AS days_elapsed,
    CAST(16 AS INTEGER) AS days_remaining
  FROM p LEFT JOIN o USING (client) LEFT JOIN t ON p.client = t.client AND p.channel = t.channel"""))
def _(f: Frames) -> DataFrame:
    # 02:00 UTC on the 15th is still the 14th in Chicago
    now = F.to_timestamp(F.lit("1998-06-15 02:00:00"))
    mtd = SP.actual_spend_mtd(f.spend_months_daily, S.local_date(now, "America/Chicago"))
    return P.pacing_live(f.base_current, f.actual_months, mtd, f.crosswalk, now, PACING_YEAR)


_TARGET = f"""WITH r AS (SELECT client, year, month, CAST(sum(rollover_in) AS DOUBLE) AS catchup FROM ({_ROLL}) GROUP BY 1, 2, 3),
  s AS (SELECT p.*, coalesce(r.catchup, 0.0) AS catchup,
      CAST(sum(CAST(committed AS DECIMAL(18,4))) OVER w AS DOUBLE) AS c_all, CAST(sum(CAST(actual AS DECIMAL(18,4))) OVER w AS DOUBLE) AS a_all
    FROM pacing p LEFT JOIN r USING (client, year, month) WINDOW w AS (PARTITION BY client, year, month)),
  t AS (SELECT *, catchup * CASE WHEN c_all <> 0 THEN committed / c_all ELSE 0.0 END AS channel_catchup, c_all + catchup AS client_target FROM s),
  u AS (SELECT *, committed + channel_catchup AS target, CASE WHEN client_target <> 0 THEN a_all / client_target ELSE 0.0 END AS pct FROM t)"""


def _targets(f: Frames) -> DataFrame:
    # the rollover restarts every January, so one year needs only that year
    base, actual = (df.filter(F.col("year") == PACING_YEAR) for df in (f.base_current, f.actual_months))
    catchup = P.rollover(base, actual).groupBy("client", "year", "month").agg(
        F.sum("rollover_in").cast("double").alias("catchup"))
    rows = f.pacing.join(catchup, ["client", "year", "month"], "left").fillna(0.0, subset=["catchup"])
    return P.target_with_catchup(rows)


@query("target_with_catchup", "OP-25", sql("pacing base_current actual_months", f"""{_TARGET}
  SELECT client, channel, year, month, committed, actual, catchup, channel_catchup, target, client_target, {_STATUS} AS status FROM u"""))
def _(f: Frames) -> DataFrame:
    return _targets(f)


@query("daily_recommendation", "OP-26", sql("pacing base_current actual_months", f"""{_TARGET}
  SELECT client, channel, (target - actual) / 17 AS recommended FROM u WHERE month = 6"""))
def _(f: Frames) -> DataFrame:
    rows = _targets(f).filter("month = 6")
    return rows.select("client", "channel",
                       P.daily_recommendation(F.col("target"), F.col("actual"), F.lit(16)).alias("recommended"))


@query("capture_status", "OP-27", sql("pacing", """
  WITH c AS (SELECT client, channel, month, committed AS reported, actual AS captured, NOT (actual = 0 AND channel IN ('bing', 'lsa')) AS data_available
    FROM pacing),
  s AS (SELECT *, CASE WHEN reported = 0 AND captured = 0 THEN 'Paused (Historical)' WHEN NOT data_available THEN 'BQ Data Gap'
      WHEN captured = 0 AND reported > 0 THEN 'Captured Mismatch (AM Over-reported)'
      WHEN reported = 0 AND captured > 0 THEN 'Captured Mismatch (AM Under-reported)'
      WHEN abs(captured - reported) / nullif(reported, 0) > 0.10 THEN 'Captured Mismatch (>10% diff)' ELSE 'Historical Match' END AS capture_status FROM c)
  SELECT *, CASE WHEN capture_status IN ('Historical Match', 'Paused (Historical)') THEN 'Healthy' WHEN capture_status = 'BQ Data Gap' THEN 'Neutral'
      WHEN capture_status LIKE '%Under-reported)' THEN 'Critical' ELSE 'Review' END AS severity,
    captured / nullif(reported, 0) AS capture_accuracy_ratio FROM s"""))
def _(f: Frames) -> DataFrame:
    rows = f.pacing.select(
        "client", "channel", "month", F.col("committed").alias("reported"), F.col("actual").alias("captured"),
        (~((F.col("actual") == 0) & F.col("channel").isin("bing", "lsa"))).alias("data_available"))
    return P.capture_status(rows)


@query("money_texts", "STR-11", sql("pacing", f"""
  SELECT client, CASE WHEN variance < 0 THEN '-$' ELSE '$' END || format('{{:,}}', CAST(abs(round(variance)) AS BIGINT)) AS variance_text,
    CAST(CAST(round(pct * 100) AS BIGINT) AS VARCHAR) || '%' AS pct_text FROM ({_MONTH_FULL})"""))
def _(f: Frames) -> DataFrame:
    return P.month_pacing(f.pacing, PACING_MONTH).select(
        "client", S.money_text(F.col("variance")).alias("variance_text"), S.percent_text(F.col("pct")).alias("pct_text"))


@query("channel_labels", "PRJ-04", sql("pacing", f"SELECT {_LABEL} AS label, count(*) AS rows FROM pacing GROUP BY 1"))
def _(f: Frames) -> DataFrame:
    return f.pacing.groupBy(S.label_of(F.col("channel"), L.CHANNEL_LABELS).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
