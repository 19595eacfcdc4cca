"""Inputs with holes: nothing may vanish, be doubled or be guessed."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from adloom.operators import budget as B, changes as C, spend as S, verdicts as V
from adloom.sinks import tables as T
from adloom.sources import sheets


def test_tombstones_without_a_batch_carry_an_error(spark):
    df = spark.createDataFrame([(None, "x")], "batch_id string, event_id string")
    assert [r.error for r in B.validate_tombstones(df).collect()] == ["Missing batch id"]


def test_open_windows_stay(spark):
    day = dt.date
    data = [(1, "a", "ctr", day(2024, 1, 1), None), (2, "a", "ctr", day(2025, 1, 1), day(2025, 1, 5)), (3, "a", None, day(2025, 1, 1), None)]
    df = spark.createDataFrame(data, "change_id int, account_id string, target_metric string, window_opens date, window_closes date")
    got = {r.change_id: (r.attribution_ambiguous, r.window_closes) for r in C.mark_overlaps(df).collect()}
    assert got == {1: (True, None), 2: (True, day(2025, 1, 5)), 3: (False, None)}


def test_amounts_keep_their_digits(spark):
    raw = spark.createDataFrame([("a", "g", "2024", "1", "12345678901.123456789"), ("a", "g", "x", "1", "1")], "client string, channel string, year string, month string, amount string")
    assert [str(r.amount) for r in sheets.read_committed_sheet(raw).collect()] == ["12345678901.123456789"]
    assert sheets.unreadable_sheet_rows(raw).count() == 1


def test_accounts_without_id_and_ids_under_two_channels(spark):
    schema = "customer_id string, account_name string, campaign_id long, date date, spend double"
    rows = [(None, "Alpha", 1, dt.date(2024, 1, 1), 5.0), (None, "Zeta", 2, dt.date(2024, 1, 1), 10.0), ("7", "Seven", 3, dt.date(2024, 1, 1), 1.0)]
    feeds = {"meta": spark.createDataFrame(rows, schema)}
    walk = spark.createDataFrame([("7", "meta", "M"), ("7", "bing", "B")], "customer_id string, channel string, canonical_client string")
    got = {r.client: r.actual for r in S.spend_daily_unified(feeds, walk).collect()}
    assert got == {"UNMAPPED: Alpha": 5.0, "UNMAPPED: Zeta": 10.0, "M": 1.0}


def test_missing_metrics_cannot_be_assessed(spark):
    metrics = spark.createDataFrame([("a", "s", "ctr", 0.001)], "account_id string, campaign_type string, metric string, value double")
    rules = spark.createDataFrame([(1, "relevant", "all", 0.1, None, None), (2, "visible", "any", 0.1, None, None)],
                                  "rule_id int, stage string, match string, warn_pct double, floor_metric string, floor_value double")
    conds = spark.createDataFrame([(1, "ctr", "lt", 0.01, None), (1, "qs", "lt", 5.0, None), (2, "other", "lt", 5.0, None)],
                                  "rule_id int, metric string, operator string, threshold double, threshold_high double")
    verdicts = V.evaluate_rules(metrics, rules, conds)
    assert {(r.rule_id, r.verdict) for r in verdicts.collect()} == {(1, "cant_assess"), (2, "cant_assess")}
    assert [(r.performing, r.verdict_family) for r in V.account_state(verdicts).collect()] == [("unknown", "unknown")]


def test_a_repeated_staged_key_is_no_guess(spark):
    target = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "k int, v string, load_timestamp timestamp")
    staged = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(PySparkException, match="several staged rows"):
        T.merged(target, staged, ["k"], F.current_timestamp()).collect()


def test_touched_partitions_are_a_literal_list(spark, tmp_path):
    path = str(tmp_path / "t")
    days = [(dt.date(2024, 1, d), d) for d in range(1, 11)]
    table = spark.createDataFrame(days, "date date, x int")
    table.write.partitionBy("date").parquet(path)
    got = T._touched(spark.read.parquet(path), "date", table.filter("x IN (2, 5)"))
    assert len(got.inputFiles()) >= 2 and got.count() == 2
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [date" in scan and "2024-01-02" in scan or "19724" in scan
