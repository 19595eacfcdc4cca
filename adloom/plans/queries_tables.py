"""Landed sources, table maintenance and streaming."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DateType, DecimalType, IntegerType, LongType, StringType, StructField, StructType

from adloom.functions import scalars as S
from adloom.operators.budget import HISTORY_COLUMNS
from adloom.operators.triage import campaign_triage
from adloom.plans.catalog import query
from adloom.plans.frames import Frames
from adloom.plans.oracle import AS_OF, day, sql, stamp
from adloom.session import work_dir
from adloom.sinks import tables as T
from adloom.sources import landed as L, payloads as P, sheets
from adloom.sources.tables import read_table
from adloom.streaming import jobs as J, pulls as PL


@query("pruned_scan", "SRC-01", sql("", "SELECT l_returnflag, count(*) AS rows FROM lineitem GROUP BY 1"))
def _(f: Frames) -> DataFrame:
    rows = read_table(f.spark, f.dir, "lineitem", columns=["l_returnflag"])
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"))


# ---- landed responses -------------------------------------------------------------------------
@query("social_spend_landed", "SRC-02 SRC-03", sql("line_spend", f"""
  SELECT s_name AS account_name, customer_id, 'Campaign ' || campaign_id AS campaign, {day('date')} AS date,
    CASE WHEN conversions > 3 THEN CAST(CAST(spend AS DECIMAL(12,2)) AS DOUBLE) ELSE 0.0 END AS cost, 'meta' AS channel
  FROM line_spend JOIN supplier ON CAST(s_suppkey AS VARCHAR) = customer_id WHERE channel = 'meta' AND s_acctbal > 0"""))
def _(f: Frames) -> DataFrame:
    return L.read_campaign_spend_landed(f.insights, f.social_accounts)


@query("landed_spend_counts", "SRC-02 Q-03", sql("line_spend", """
  WITH l AS (SELECT s.*, sup.s_acctbal FROM line_spend s LEFT JOIN supplier sup ON CAST(sup.s_suppkey AS VARCHAR) = s.customer_id
             WHERE channel = 'meta')
  SELECT count(*) FILTER (WHERE conversions = 1) AS unreadable,
    count(*) FILTER (WHERE conversions <> 1 AND NOT coalesce(s_acctbal > 0, false)) AS unmatched,
    count(*) FILTER (WHERE conversions <> 1 AND s_acctbal > 0) AS kept,
    CAST(sum(CASE WHEN conversions <> 1 AND s_acctbal > 0 THEN
      CASE WHEN conversions > 3 THEN CAST(spend AS DECIMAL(12,2)) ELSE 0 END END) AS DOUBLE) AS kept_cost
  FROM l"""))
def _(f: Frames) -> DataFrame:
    """Landed lines, those of single-conversion rows cut short in transit, to typed rows written to a table;
    the counts come from the same pass."""
    spark = f.spark
    line = F.to_json(F.struct(
        F.col("customer_id").alias("account_id"),
        F.concat(F.lit("Campaign "), F.col("campaign_id").cast("string")).alias("campaign_name"),
        F.col("date").cast("string").alias("date_start"),
        F.when(F.col("conversions") > 3, F.col("spend").cast("decimal(12,2)").cast("string")).alias("spend")))
    cut = F.when(F.col("conversions") == 1, F.expr("substring(value, 1, length(value) div 2)")).otherwise(F.col("value"))
    landing = work_dir(spark, "landed-json")
    f.line_spend.filter("channel = 'meta'").select(line.alias("value"), "conversions").select(cut.alias("value")).write.text(landing)
    rows, seen = L.land_campaign_spend(spark, landing, f.social_accounts)
    rows.write.parquet(work_dir(spark, "landed-rows"))
    counts = seen.get
    return spark.createDataFrame([(counts["unreadable"], counts["unmatched"], counts["kept"],
                                   float(counts["kept_cost"] or 0))],
                                 "unreadable long, unmatched long, kept long, kept_cost double")


@query("active_social_accounts", "SRC-03", "SELECT CAST(s_suppkey AS VARCHAR) AS account_id, s_name AS name FROM supplier WHERE s_acctbal > 0")
def _(f: Frames) -> DataFrame:
    return L.filter_active_accounts(f.social_accounts).select("account_id", "name")


_STATS = """SELECT customer_id AS advertiser_id, date AS report_date, CASE WHEN q >= 5 THEN CAST(spend AS DECIMAL(38,9)) END AS billable_spend,
    CASE WHEN q > 10 THEN q * 10 ELSE 0 END AS impressions, CASE WHEN q > 3 THEN q ELSE 0 END AS clicks, n
  FROM (SELECT customer_id, date, sum(spend) AS spend, CAST(sum(conversions) AS BIGINT) AS q, count(*) AS n FROM line_spend
    WHERE channel = 'nextdoor' GROUP BY 1, 2)"""


@query("advertiser_stats_landed", "SRC-04 SRC-06 MTH-02", sql("line_spend", f"""
  SELECT {day('report_date')} AS report_date, advertiser_id, s_name AS advertiser_name, 'USD' AS currency_code, CAST(billable_spend AS DOUBLE) AS billable_spend,
    impressions, clicks, CAST(NULL AS DOUBLE) AS ctr, CAST(n AS DOUBLE) AS cpc, CAST(NULL AS DOUBLE) AS cpm, n AS total_conversions,
    CAST(0 AS BIGINT) AS lead_conversions
  FROM ({_STATS}) x JOIN supplier ON CAST(s_suppkey AS VARCHAR) = advertiser_id"""))
def _(f: Frames) -> DataFrame:
    return L.read_advertiser_stats_landed(f.advertiser_stats, f.advertisers)


@query("active_advertiser_days", "SRC-07", sql("line_spend", f"""
  SELECT {day('report_date')} AS report_date, advertiser_id FROM ({_STATS}) x
  WHERE coalesce(billable_spend, 0) > 0 OR impressions > 0 OR clicks > 0"""))
def _(f: Frames) -> DataFrame:
    return L.active_days(L.read_advertiser_stats_landed(f.advertiser_stats, f.advertisers)).select("report_date", "advertiser_id")


@query("advertiser_access", "SRC-05", "SELECT CAST(s_suppkey AS VARCHAR) AS advertiser_id FROM supplier WHERE s_acctbal >= 0")
def _(f: Frames) -> DataFrame:
    return L.filter_advertiser_access(f.advertisers).select("advertiser_id")


@query("advertiser_target_dates", "SRC-08", """
  WITH a AS (SELECT CAST(s_suppkey AS VARCHAR) AS advertiser_id, CASE s_nationkey WHEN 1 THEN 'America/Chicago' WHEN 2 THEN 'America/Los_Angeles'
      WHEN 3 THEN 'Asia/Tokyo' ELSE 'America/New_York' END AS timezone,
      CASE s_nationkey WHEN 3 THEN DATE '2024-01-30' ELSE DATE '2024-01-29' END AS last FROM supplier)
  SELECT advertiser_id, timezone, strftime(unnest(generate_series(last - 2, last, INTERVAL 1 DAY)), '%Y-%m-%d') AS report_date FROM a""")
def _(f: Frames) -> DataFrame:
    # 02:00 UTC on the 31st: still the 30th in America, already the 31st in Tokyo
    return L.target_dates(f.advertisers, F.to_timestamp(F.lit("2024-01-31 02:00:00")), f.zones, 3)


@query("ad_policy_landed", "SRC-09", f"""
  SELECT '2024-01-31' AS snapshot_date, CAST(l_partkey % 97 AS VARCHAR) AS customer_id, CAST(l_partkey AS VARCHAR) AS campaign_id,
    'Campaign ' || l_partkey AS campaign_name, CAST(l_suppkey AS VARCHAR) AS ad_group_id, l_orderkey || '-' || l_linenumber AS ad_id,
    CASE l_returnflag WHEN 'R' THEN 'DISAPPROVED' ELSE 'APPROVED_LIMITED' END AS approval_status, 'REVIEWED' AS review_status,
    CASE WHEN l_linenumber = 1 THEN 'DESTINATION_NOT_WORKING,,ALCOHOL' WHEN l_linenumber IN (3, 4, 5) THEN 'TRADEMARKS' END AS policy_topics
  FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linestatus = 'O'""")
def _(f: Frames) -> DataFrame:
    return L.read_ad_policy_landed(f.policy_records, f.as_of)


@query("call_assets_landed", "SRC-10", """
  SELECT '2024-01-31' AS snapshot_date, CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS asset_id,
    CASE WHEN o_totalprice > 100000 THEN '+1' || o_orderkey END AS phone_number, o_orderpriority AS approval_status FROM orders WHERE o_orderstatus <> 'F'""")
def _(f: Frames) -> DataFrame:
    raw = f.table("orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("asset_id"),
        F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("+1"), F.col("o_orderkey").cast("string"))).otherwise(F.lit("")).alias("phone_number"),
        F.col("o_orderpriority").alias("approval_status"),
        F.when(F.col("o_orderstatus") == "F", F.lit("SITELINK")).otherwise(F.lit("CALL")).alias("asset_type"))
    return L.read_call_assets_landed(raw, f.as_of)


@query("billing_landed", "SRC-11", """
  SELECT '2024-01-31' AS snapshot_date, CAST(c_custkey AS VARCHAR) AS customer_id, s.v AS billing_setup_status, b.v AS account_budget_status
  FROM customer LEFT JOIN (SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) s ON s.o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def _(f: Frames) -> DataFrame:
    o = f.table("orders").select(F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderkey").alias("id"),
                                 F.col("o_orderpriority").alias("status"), "o_orderstatus")
    accounts = f.table("customer").select(F.col("c_custkey").cast("string").alias("customer_id"))
    return L.read_billing_landed(accounts, o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'P'"), f.as_of)


@query("child_accounts", "SRC-12", """
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS descriptive_name FROM customer
  WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 7""")
def _(f: Frames) -> DataFrame:
    raw = f.table("customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("descriptive_name"),
        (F.col("c_mktsegment") == "BUILDING").alias("manager"),
        F.when(F.col("c_nationkey") == 7, F.lit("SUSPENDED")).otherwise(F.lit("ENABLED")).alias("status"))
    return L.list_child_accounts(raw)


@query("payload_items", "SRC-15 JSN-01", """
  SELECT o_orderkey, o_orderpriority AS channel, o_totalprice AS amount FROM orders""")
def _(f: Frames) -> DataFrame:
    # the same document in each of the wrappings a response can have
    items = F.array(F.struct(F.col("o_orderpriority").alias("channel"), F.col("o_totalprice").alias("amount")))
    body = F.to_json(F.struct(items.alias("items")))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)
    wrapped = (
        F.when(F.col("o_orderpriority") == "1-URGENT", body)
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit('[{"json":'), body, F.lit("}]")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit('[{"json":'), quoted(body), F.lit("}]")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(quoted(body))
    )
    raw = f.table("orders").select("o_orderkey", wrapped.alias("raw"))
    return P.payload_items(raw, "raw", "channel:string,amount:double")


@query("triage_documents", "SRC-16", sql("triaged", """
  SELECT CAST(campaign AS VARCHAR) AS campaign_name, cost, clicks, cpa, status FROM triaged"""))
def _(f: Frames) -> DataFrame:
    # one document per campaign with its weeks as items
    item = F.struct(F.col("campaign").cast("string").alias("campaign_name"), "cost", "clicks", "cpa", "status",
                    F.array(F.lit(-1.0), F.col("cost")).alias("cpa_history"))
    docs = campaign_triage(f.campaign_weeks).groupBy("campaign").agg(F.collect_list(item).alias("items"))
    path = work_dir(f.spark, "triage")
    docs.select("items").write.json(path)
    rows = P.read_triage_items(f.spark, path, multi_line=False)
    return rows.filter(F.get("cpa_history", F.lit(0)).isNull()).select("campaign_name", "cost", "clicks", "cpa", "status")


# ---- table maintenance ------------------------------------------------------------------------
_SOCIAL = StructType([
    StructField("customer_id", StringType()),
    StructField("campaign", StringType()),
    StructField("date", DateType()),
    StructField("cost", DecimalType(28, 4)),
])


def _daily(f: Frames) -> DataFrame:
    return f.line_spend.groupBy("customer_id", F.col("channel").alias("campaign"), "date").agg(F.sum("spend").alias("cost"))


def _monthly(f: Frames) -> DataFrame:
    """All spend at month grain: few partitions, every row of the source."""
    return f.line_spend.groupBy("customer_id", F.col("channel").alias("campaign"), F.trunc("date", "MM").alias("date")).agg(
        F.sum("spend").cast("decimal(28,4)").alias("cost"))


_MONTHLY = """SELECT customer_id, channel AS campaign, CAST(date_trunc('month', date) AS DATE) AS date, sum(spend) AS cost
  FROM line_spend GROUP BY 1, 2, 3"""


@query("range_replaced_rows", "SNK-01", sql("line_spend", f"""
  WITH d AS (SELECT customer_id, channel AS campaign, date, sum(spend) AS cost FROM line_spend GROUP BY 1, 2, 3)
  SELECT customer_id, campaign, {day('date')} AS date, CAST(cost AS DOUBLE) AS cost FROM d WHERE d.date NOT BETWEEN DATE '2023-12-01' AND DATE '2024-01-15'
  UNION ALL SELECT customer_id, campaign, {day('date')}, CAST(cost * 2 AS DOUBLE) FROM d WHERE d.date BETWEEN DATE '2023-12-01' AND DATE '2024-01-15' AND campaign <> 'meta'"""))
def _(f: Frames) -> DataFrame:
    since, until = F.to_date(F.lit("2023-12-01")), F.to_date(F.lit("2024-01-15"))
    staged = _daily(f).filter(F.col("date").between(since, until) & (F.col("campaign") != "meta")).withColumn("cost", F.col("cost") * 2)
    return T.replaced_range(_daily(f), staged, "date", since, until)


@query("upserted_rows", "SNK-02", sql("line_spend", f"""
  WITH d AS (SELECT customer_id, channel AS campaign, date, sum(spend) AS cost FROM line_spend GROUP BY 1, 2, 3)
  SELECT customer_id, campaign, {day('date')} AS date, CAST(CASE WHEN d.date >= DATE '2024-01-01' THEN cost * 3 ELSE cost END AS DOUBLE) AS cost,
    CASE WHEN d.date >= DATE '2024-01-01' THEN '2024-01-31 12:00:00.000000' ELSE '2024-01-01 00:00:00.000000' END AS load_timestamp
  FROM d WHERE campaign <> 'bing' OR d.date >= DATE '2024-01-01'"""))
def _(f: Frames) -> DataFrame:
    old = _daily(f).filter("campaign <> 'bing'").withColumn("load_timestamp", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    staged = _daily(f).filter("date >= '2024-01-01'").withColumn("cost", F.col("cost") * 3)
    return T.merged(old, staged, ["customer_id", "campaign", "date"], f.now)


@query("upserted_table", "SNK-02 SNK-03 SNK-04", sql("line_spend", f"""
  SELECT customer_id, campaign, {day('date')} AS date, CAST(CASE WHEN d.date >= DATE '2020-01-01' THEN cost * 3 ELSE cost END AS DOUBLE) AS cost
  FROM ({_MONTHLY}) d WHERE campaign <> 'bing' OR d.date >= DATE '2020-01-01'"""))
def _(f: Frames) -> DataFrame:
    path = work_dir(f.spark, "table")
    T.ensure_table(f.spark, path, _SOCIAL, "date")
    keys = ["customer_id", "campaign", "date"]
    T.merge_upsert(f.spark, path, _monthly(f).filter("campaign <> 'bing'"), _SOCIAL, keys, "date", f.now)
    staged = _monthly(f).filter("date >= '2020-01-01'").withColumn("cost", (F.col("cost") * 3).cast("decimal(28,4)"))
    T.merge_upsert(f.spark, path, staged, _SOCIAL, keys, "date", f.now)
    return T.read_partitioned(f.spark, path, _SOCIAL)


@query("range_replaced_table", "SNK-01", sql("line_spend", f"""
  SELECT customer_id, campaign, {day('date')} AS date, CAST(cost AS DOUBLE) AS cost FROM ({_MONTHLY}) d
  WHERE d.date NOT BETWEEN DATE '2020-03-01' AND DATE '2022-03-31' OR (d.date < DATE '2022-01-01' AND campaign = 'lsa')"""))
def _(f: Frames) -> DataFrame:
    path = work_dir(f.spark, "table")
    T.ensure_table(f.spark, path, _SOCIAL, "date")
    T.replace_range(f.spark, path, _monthly(f), _SOCIAL, "date", date(2000, 1, 1), date(2024, 12, 31))
    # the new pull has one channel only, and nothing at all for the last months of the range
    pulled = _monthly(f).filter("date BETWEEN '2020-03-01' AND '2021-12-31' AND campaign = 'lsa'")
    T.replace_range(f.spark, path, pulled, _SOCIAL, "date", date(2020, 3, 1), date(2022, 3, 31))
    return T.read_partitioned(f.spark, path, _SOCIAL)


@query("accumulated_snapshots", "SNK-12", sql("ad_policy", f"""
  SELECT {day('snapshot_date')} AS snapshot_date, customer_id, approval_status, count(*) AS ads FROM ad_policy GROUP BY ad_policy.snapshot_date, 2, 3"""))
def _(f: Frames) -> DataFrame:
    path = work_dir(f.spark, "history")
    schema = StructType.fromDDL("snapshot_date date, customer_id string, approval_status string, ads bigint")
    daily = f.ad_policy.groupBy("snapshot_date", "customer_id", "approval_status").agg(F.count(F.lit(1)).alias("ads"))
    for back in (1, 0, 0):  # the last day is loaded twice
        T.accumulate_snapshot(f.spark, path, daily.filter(F.col("snapshot_date") == F.date_sub(f.as_of, back)), schema,
                              ["snapshot_date", "customer_id", "approval_status"], "snapshot_date", f.now)
    return T.read_partitioned(f.spark, path, schema)


@query("appended_events", "SNK-05 SNK-06", sql("live_events", "SELECT event_id, client, CAST(amount AS DOUBLE) AS amount FROM live_events"))
def _(f: Frames) -> DataFrame:
    log, stones = work_dir(f.spark, "log"), work_dir(f.spark, "tombstones")
    events = f.budget_events.select("event_id", "client", "amount")
    T.append_event(f.spark, log, events.filter("amount < 300000"), events.schema)
    T.append_event(f.spark, log, events, events.schema)  # a retry overlapping the first call
    schema = StructType.fromDDL("event_id string, deleted_by string, deleted_at timestamp")
    for _ in range(2):
        T.append_tombstones(f.spark, stones, f.tombstones, F.lit("admin@example.com"), f.now, schema)
    return T.read_log(f.spark, log, events.schema).join(T.read_log(f.spark, stones, schema), "event_id", "left_anti")


@query("materialized_sheet", "SRC-13 SNK-03", sql("sheet", """
  SELECT client, channel, year, month, CAST(amount AS DOUBLE) AS amount FROM sheet"""))
def _(f: Frames) -> DataFrame:
    export, base = work_dir(f.spark, "export"), work_dir(f.spark, "sheet")
    f.sheet.write.option("header", True).csv(export)
    raw = sheets.read_sheet(f.spark, export, "client string, channel string, year string, month string, amount decimal(12,2)")
    sheets.materialize_sheet(sheets.read_committed_sheet(raw), base)
    return T.current(f.spark, base)


# ---- streaming --------------------------------------------------------------------------------
def _drop_in(f: Frames, df: DataFrame, label: str) -> str:
    """Land rows as files that a stream can pick up."""
    path = work_dir(f.spark, label)
    df.write.parquet(path)
    return path


@query("streamed_events", "STM-01", sql("budget_events", f"""
  SELECT event_id, client, channel, year, month, CAST(amount AS DOUBLE) AS amount, event_type, {stamp('changed_at')} AS changed_at FROM budget_events"""))
def _(f: Frames) -> DataFrame:
    rows = f.budget_events.withColumn("changed_at", F.col("changed_at").cast("timestamp"))
    schema = rows.select(*HISTORY_COLUMNS).schema
    landing = _drop_in(f, rows, "landing")
    rows.filter("channel = 'bing'").write.mode("append").parquet(landing)  # delivered twice
    log = work_dir(f.spark, "log")
    J.stream_events(J.file_stream(f.spark, landing, schema, "parquet"), log, schema, work_dir(f.spark, "ckpt")).awaitTermination()
    return f.spark.read.schema(schema).parquet(log).select("event_id", "client", "channel", "year", "month", "amount", "event_type", "changed_at")


@query("streamed_tombstones", "STM-02", sql("tombstones", "SELECT event_id FROM tombstones"))
def _(f: Frames) -> DataFrame:
    rows = f.tombstones.withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))
    landing = _drop_in(f, rows, "landing")
    rows.write.mode("append").parquet(landing)
    log = work_dir(f.spark, "log")
    J.stream_tombstones(J.file_stream(f.spark, landing, rows.schema, "parquet"), log, rows.schema, work_dir(f.spark, "ckpt")).awaitTermination()
    return f.spark.read.schema(rows.schema).parquet(log).select("event_id")


@query("streamed_restatement", "STM-03", sql("line_spend", f"""
  SELECT customer_id, campaign, {day('date')} AS date, CAST(cost AS DOUBLE) AS cost FROM ({_MONTHLY}) d"""))
def _(f: Frames) -> DataFrame:
    rows = _monthly(f)
    landing = _drop_in(f, rows.withColumn("cost", (F.col("cost") * 0).cast("decimal(28,4)")).withColumn("pull", F.lit(1)), "landing")
    path, ckpt = work_dir(f.spark, "table"), work_dir(f.spark, "ckpt")
    T.ensure_table(f.spark, path, _SOCIAL, "date")
    schema = StructType([*_SOCIAL.fields, StructField("pull", IntegerType())])
    for pull in (1, 2):
        if pull == 2:  # the corrected figures arrive later
            rows.withColumn("pull", F.lit(2)).write.mode("append").parquet(landing)
        J.stream_restate(J.file_stream(f.spark, landing, schema, "parquet"), path, _SOCIAL, ["customer_id", "campaign", "date"], "date",
                         ckpt, f.now, newest=[F.desc("pull")]).awaitTermination()
    return T.read_partitioned(f.spark, path, _SOCIAL)


#: Rows of a landed file, about.
FILE_ROWS = 500_000


@query("streamed_range_pulls", "STM-03", sql("line_spend", f"""
  WITH d AS (SELECT customer_id, channel AS campaign, date, CAST(sum(spend) AS DECIMAL(28,4)) AS cost FROM line_spend GROUP BY 1, 2, 3)
  SELECT customer_id, campaign, {day('date')} AS date, CAST(cost * 0 AS DOUBLE) AS cost FROM d
  WHERE d.date NOT BETWEEN DATE '2023-01-01' AND DATE '2023-12-31'
  UNION ALL SELECT customer_id, campaign, {day('date')}, CAST(cost AS DOUBLE) FROM d WHERE d.date BETWEEN DATE '2023-01-01' AND DATE '2023-05-31'
  UNION ALL SELECT customer_id, campaign, {day('date')}, CAST(cost AS DOUBLE) FROM d
  WHERE d.date BETWEEN DATE '2023-06-01' AND DATE '2023-12-30' AND campaign <> 'meta'"""))
def _(f: Frames) -> DataFrame:
    """Four pulls at day grain over two rounds of landing: pull 1 (old figures, every day), pull 2 (corrected
    figures for the second half of 2023 without one channel and with nothing on its last day) over both rounds,
    pull 3 (an older retry of pull 2's range with wrong figures) and pull 4 (the first half of 2023) in the
    second. Newest complete pull per day wins; pull 2's last day is emptied."""
    spark = f.spark
    rows = _daily(f).select("customer_id", "campaign", "date", F.col("cost").cast("decimal(28,4)").alias("cost"))
    rows = T.materialize(rows, "pull-days-in")  # landed by several pulls
    base = work_dir(spark, "pulls")
    landing, manifests, staging, markers, path = (f"{base}/{n}" for n in ("landing", "manifests", "staging", "markers", "table"))
    schema = StructType([*_SOCIAL.fields, StructField("pull_id", LongType())])
    files: dict[int, int] = {}

    def land(pull: int, df: DataFrame, chunk: int, parts: int) -> None:
        folder = f"{landing}/p{pull}-c{chunk}"
        # files of at most FILE_ROWS rows, so that more rows are more files, not larger ones
        parts = max(parts, math.ceil(df.count() / FILE_ROWS))
        df.withColumn("pull_id", F.lit(pull).cast("long")).repartition(parts).write.parquet(folder)
        files[pull] = files.get(pull, 0) + sum(1 for n in T.children(spark, folder) if n.endswith(".parquet"))

    def manifest(pull: int, since: date, until: date, pulled_at: str) -> None:
        spark.createDataFrame([(pull, since, until, files.get(pull, 0))], "pull_id long, since date, until date, n_files long") \
            .withColumn("pulled_at", F.to_timestamp(F.lit(pulled_at))).write.mode("append").parquet(manifests)

    def run(round_: int) -> None:
        data = spark.readStream.schema(schema).parquet(f"{landing}/*")
        PL.stage_files(data, staging, markers, f"{base}/ckpt-stage").awaitTermination()
        marks = spark.readStream.schema(PL.MARKER).parquet(f"{markers}/*")
        heads = spark.readStream.schema(PL.MANIFEST).parquet(manifests)
        PL.apply_pulls(marks, heads, staging, path, _SOCIAL, "date", f"{base}/ckpt-apply").awaitTermination()

    span = rows.agg(F.min("date"), F.max("date")).first()
    h1, h2, mid, end = date(2023, 1, 1), date(2023, 6, 1), date(2023, 9, 15), date(2023, 12, 31)
    corrected = rows.where(F.col("date").between(h2, end) & (F.col("campaign") != "meta") & (F.col("date") != end))
    land(1, rows.withColumn("cost", (F.col("cost") * 0).cast("decimal(28,4)")), 0, 2)
    manifest(1, span[0], span[1], "2024-02-01 00:00:00")
    land(2, corrected.where(F.col("date") < mid), 0, 1)
    run(1)
    land(2, corrected.where(F.col("date") >= mid), 1, 2)
    manifest(2, h2, end, "2024-03-01 00:00:00")
    land(3, rows.where(F.col("date").between(h2, end)).withColumn("cost", (F.col("cost") * 5).cast("decimal(28,4)")), 0, 1)
    manifest(3, h2, end, "2024-02-15 00:00:00")
    land(4, rows.where(F.col("date").between(h1, date(2023, 5, 31))), 0, 1)
    manifest(4, h1, date(2023, 5, 31), "2024-02-20 00:00:00")
    run(2)
    return T.read_partitioned(spark, path, _SOCIAL)


@query("streamed_audit", "STM-04", """
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS action, 'user' || user_id || '@example.com' AS target_email, props AS detail FROM events""")
def _(f: Frames) -> DataFrame:
    rows = f.audit_events.withColumn("changed_at", F.timestamp_seconds("changed_at"))
    landing = _drop_in(f, rows, "landing")
    log = work_dir(f.spark, "log")
    J.stream_audit(J.file_stream(f.spark, landing, rows.schema, "parquet"), log, rows.schema, work_dir(f.spark, "ckpt")).awaitTermination()
    return f.spark.read.schema(rows.schema).parquet(log).select("event_id", "action", "target_email", "detail")


@query("streamed_calls", "STM-05", """
  SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'answered' ELSE event_type END AS call_status,
    strftime(CASE WHEN event_type = 'view' THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END, '%Y-%m-%d') AS call_date FROM events""")
def _(f: Frames) -> DataFrame:
    rows = f.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("call_status"), F.to_date("ts").alias("call_date"))
    schema, path, ckpt = rows.schema, work_dir(f.spark, "calls"), work_dir(f.spark, "ckpt")
    landing = _drop_in(f, rows, "landing")
    T.ensure_table(f.spark, path, schema, "call_date")
    for late in (False, True):
        if late:  # corrected calls move to the next day
            fixed = rows.filter("call_status = 'view'").select("id", F.lit("answered").alias("call_status"),
                                                               F.date_add("call_date", 1).alias("call_date"))
            fixed.write.mode("append").parquet(landing)
        J.stream_calls_upsert(J.file_stream(f.spark, landing, schema, "parquet"), path, schema, ckpt, f.now).awaitTermination()
    return T.read_partitioned(f.spark, path, schema)


@query("parsed_money", "SRC-06", sql("line_spend", """
  SELECT DISTINCT raw, TRY_CAST(nullif(string_split(raw, ' ')[-1], '') AS DOUBLE) AS value
  FROM (SELECT CASE WHEN conversions < 3 THEN '' WHEN conversions < 6 THEN 'USD n/a' WHEN conversions < 20 THEN 'USD ' || spend ELSE CAST(spend AS VARCHAR) END AS raw
    FROM line_spend)"""))
def _(f: Frames) -> DataFrame:
    q, text = F.col("conversions"), F.col("spend").cast("string")
    raw = (F.when(q < 3, F.lit("")).when(q < 6, F.lit("USD n/a")).when(q < 20, F.concat(F.lit("USD "), text)).otherwise(text))
    return f.line_spend.select(raw.alias("raw")).distinct().select("raw", S.parse_money(F.col("raw")).alias("value"))


@query("epoch_texts", "DT-07", "SELECT DISTINCT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def _(f: Frames) -> DataFrame:
    return f.audit_events.select(S.epoch_text(F.col("changed_at")).alias("at")).distinct()
