import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from adloom.operators import triage as G
from adloom.sources import landed as L, payloads as P, sheets


def test_landed_json_keeps_broken_lines_visible(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"account_id":"1","campaign_name":"c","date_start":"2024-01-02","spend":"12.34"}\nnot json\n'
                                     '{"account_id":"1","campaign_name":"d","date_start":"2024-01-02"}\n')
    raw = L.read_landed_json(spark, str(tmp_path), L.INSIGHT_SCHEMA).cache()
    assert raw.filter("_corrupt_record IS NOT NULL").count() == 1
    accounts = spark.createDataFrame([("1", "n", 1), ("2", "m", 2)], "account_id string, name string, account_status int")
    out = L.read_campaign_spend_landed(raw.filter("_corrupt_record IS NULL"), accounts)
    assert sorted((r.campaign, str(r.cost), r.date) for r in out.collect()) == [
        ("c", "12.340000000", date(2024, 1, 2)), ("d", "0E-9", date(2024, 1, 2))]
    assert out.columns == ["account_name", "customer_id", "campaign", "date", "cost", "channel"]


def test_target_dates(spark):
    acc = spark.createDataFrame([("ny", None), ("tk", "Asia/Tokyo"), ("bad", "Mars/Base")], "advertiser_id string, timezone string")
    zones = spark.createDataFrame([("Asia/Tokyo",), ("America/New_York",)], "zone string")
    out = L.target_dates(acc, F.lit(datetime(2024, 1, 31, 2)), zones, 2)
    got = sorted((r.advertiser_id, r.report_date.day) for r in out.collect())
    assert got == [("bad", 28), ("bad", 29), ("ny", 28), ("ny", 29), ("tk", 29), ("tk", 30)]
    fixed = L.target_dates(acc, F.lit(datetime(2024, 1, 31, 2)), zones, 2, F.lit(date(2024, 1, 5)), F.lit(date(2024, 1, 4)))
    assert fixed.count() == 0


def test_policy_assets_billing(spark, rows):
    pol = spark.createDataFrame([(1, 2, "n", 3, 4, "DISAPPROVED", "R", "ENABLED", ["A", None, "B"]), (1, 2, "n", 3, 5, "DISAPPROVED", "R", "ENABLED", []),
                                 (1, 2, "n", 3, 6, "DISAPPROVED", "R", "ENABLED", None), (1, 2, "n", 3, 7, "DISAPPROVED", "R", "PAUSED", ["A"]),
                                 (1, 2, "n", 3, 8, "APPROVED", "R", "ENABLED", ["A"])],
                                "customer_id int, campaign_id int, campaign_name string, ad_group_id int, ad_id int, approval_status string, "
                                "review_status string, campaign_status string, topics array<string>")
    out = L.read_ad_policy_landed(pol, F.lit(date(2024, 1, 1)))
    assert rows(out, "ad_id", "policy_topics") == [("4", "A,,B"), ("5", None), ("6", None)]
    s = spark.createDataFrame([("1", 9, "LATER"), ("1", 2, "FIRST")], "customer_id string, id int, status string")
    b = spark.createDataFrame([], "customer_id string, id int, status string")
    acc = spark.createDataFrame([("1",), ("2",)], "customer_id string")
    assert rows(L.read_billing_landed(acc, s, b, F.lit(date(2024, 1, 1))), "customer_id", "billing_setup_status", "account_budget_status") == [
        ("1", "FIRST", None), ("2", None, None)]


def test_advertiser_filters(spark):
    df = spark.createDataFrame([("1", "ADMIN"), ("2", "NO_ACCESS"), ("3", None)], "advertiser_id string, role string")
    assert sorted(r[0] for r in L.filter_advertiser_access(df).collect()) == ["1", "3"]
    assert sorted(r[0] for r in L.filter_advertiser_access(df, ["2"]).collect()) == ["2"]


def test_payload_shapes(spark):
    body = {"items": [{"a": 1}, {"a": 2}]}
    text = json.dumps(body)
    shapes = [text, json.dumps(text), json.dumps([body]), json.dumps([{"json": body}]), json.dumps([{"json": text}]), json.dumps({"json": text})]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "n int, raw string")
    got = sorted((r.n, r.a) for r in P.payload_items(df, "raw", "a:int").collect())
    assert got == [(n, a) for n in range(len(shapes)) for a in (1, 2)]


def test_triage_document(spark, tmp_path):
    item = {"client_name": "c", "cost": 10.0, "conv": 0, "clicks": 3, "status": "OK", "cpa_history": [5, -1], "status_history": ["OK"]}
    (tmp_path / "t.json").write_text(json.dumps({"summary": {"total": 1}, "items": [item]}, indent=1))
    r = P.read_triage_items(spark, str(tmp_path / "t.json")).first()
    assert (r.client_name, r.cpa, r.cpa_history) == ("c", None, [5.0, None])


@pytest.mark.parametrize("cost, conv, clicks, bench, prev, status", [
    (200.0, 0, 3, 20.0, None, "Critical"), (199.0, 0, 3, 20.0, None, "Low Volume"), (160.0, 5, 15, 20.0, None, "Critical"),
    (159.0, 5, 15, 20.0, None, "At Risk"), (10.0, 4, 50, 20.0, 9, "At Risk"), (10.0, 5, 50, 20.0, 10, "OK"), (10.0, 4, 14, 20.0, 9, "At Risk"),
    (320.0, 5, 14, 20.0, None, "Low Volume"), (100.0, 5, 40, 16.0, None, "At Risk"),
])
def test_triage_rules(spark, cost, conv, clicks, bench, prev, status):
    df = spark.createDataFrame([(cost, conv, clicks, bench, prev)], "cost double, conv int, clicks int, bench double, prev_conv int")
    assert G.campaign_triage(df).first().status == status


def test_streak(spark, rows):
    h = [("a", i, s) for i, s in enumerate(["OK", "Critical", "OK", "Critical", "Critical"])] + [("b", 0, "OK")] + [("d", 0, "Critical"), ("d", 1, "OK")]
    out = G.status_streak(spark.createDataFrame(h, "k string, week int, status string"), ["k"], "week")
    assert rows(out, "k", "streak", "status", "direction") == [
        ("a", 2, "Critical", "Stable"), ("b", 1, "OK", "New/insufficient history"), ("d", 1, "OK", "Improving")]


def test_sheet_export(spark, tmp_path):
    (tmp_path / "s.csv").write_text("client,channel,year,month,amount\nc,meta,2024, 3,10.5\nc,meta,soon,3,1\n")
    raw = sheets.read_sheet(spark, str(tmp_path / "s.csv"), "client string, channel string, year string, month string, amount string")
    assert [(r.year, r.month, float(r.amount)) for r in sheets.read_committed_sheet(raw).collect()] == [(2024, 3, 10.5)]


def test_newest_partition_from_folder_names(spark, tmp_path):
    from datetime import date

    from adloom.sources.tables import newest_partition
    path = str(tmp_path / "history")
    rows = [(date(2024, 1, d), f"ad{d}") for d in (1, 2, 3)] + [(None, "no day")]
    spark.createDataFrame(rows, "snapshot_date date, ad string").write.partitionBy("snapshot_date").parquet(path)
    newest = newest_partition(spark, path, "snapshot_date")
    assert [(r.snapshot_date, r.ad) for r in newest.collect()] == [(date(2024, 1, 3), "ad3")]
    assert all("snapshot_date=2024-01-03" in f for f in newest.inputFiles())
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
