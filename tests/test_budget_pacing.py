from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from adloom.operators import budget as B, pacing as P, spend as SP

EVENT = "event_id string, client string, channel string, year int, month int, amount decimal(12,2), changed_at timestamp"
BASE = "client string, channel string, year int, month int, base_amount decimal(12,2)"
ACTUAL = "client string, channel string, year int, month int, actual decimal(12,2)"


def events(spark, *rows):
    from decimal import Decimal

    return spark.createDataFrame([(i, "c", "meta", 2024, m, Decimal(a), datetime(2024, 1, d)) for i, m, a, d in rows], EVENT)


def stones(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "event_id string")


def test_withdrawn_edit_uncovers_the_previous(spark, rows):
    ev = events(spark, ("a", 1, 10, 1), ("b", 1, 20, 2), ("d", 2, 30, 1))
    sheet = spark.createDataFrame([("c", "meta", 2024, 2, None), ("c", "meta", 2024, 3, None)],
                                  "client string, channel string, year int, month int, amount decimal(12,2)").fillna({})
    sheet = sheet.withColumn("amount", F.lit(7).cast("decimal(12,2)"))
    get = lambda *ids: [(m, float(a), s) for m, a, s in rows(B.budget_base_current(ev, stones(spark, *ids), sheet), "month", "base_amount", "source")]
    assert get() == [(1, 20.0, "event"), (2, 30.0, "event"), (3, 7.0, "sheet")]
    assert get("b", "d") == [(1, 10.0, "event"), (2, 7.0, "sheet"), (3, 7.0, "sheet")]
    assert get("a", "b", "d") == [(2, 7.0, "sheet"), (3, 7.0, "sheet")]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.permutations(["a", "b", "d"]), st.integers(0, 3))
def test_tombstone_order_does_not_matter(spark, order, n):
    ev = events(spark, ("a", 1, 10, 1), ("b", 1, 20, 2), ("d", 2, 30, 1))
    ids = order[:n]
    got = {r.event_id for r in B.latest_budget_event(ev, stones(spark, *ids, *ids)).collect()}
    expected = ({"b"} if "b" not in ids else {"a"} if "a" not in ids else set()) | ({"d"} if "d" not in ids else set())
    assert got == expected


def test_validation(spark):
    cases = [("c", "m", "create", "2024", "1", "5", None), (" ", "m", "create", "2024", "1", "5", "client is required"),
             ("c", "", "create", "2024", "1", "5", "channel is required"), ("c", "m", "create", "2019", "1", "5", "year must be a valid integer"),
             ("c", "m", "create", "2024.5", "1", "5", "year must be a valid integer"), ("c", "m", "create", "2024", "13", "5", "month must be 1-12"),
             ("c", "m", "create", "2024", "x", "5", "month must be 1-12"), ("c", "m", "create", "2024", "1", None, "amount must be a number"),
             ("c", "m", "create", "2024", "1", "5d", "amount must be a number"), ("c", "m", "create", " 2024 ", "1", "1.5e2", None),
             ("c", "m", "move", "2024", "1", "5", "event_type must be one of create, update, delete")]
    df = spark.createDataFrame(cases, "client string, channel string, event_type string, year string, month string, amount string, expected string")
    got = B.validate_event(df).collect()
    assert [r.error for r in got] == [r.expected for r in got]


def test_tombstone_batches(spark):
    uuid = "00000000-0000-4000-8000-%012d"
    data = [("big", uuid % i) for i in range(101)] + [("ok", (uuid % 1).upper()), ("ok", "nope"), ("ok", None)]
    out = B.validate_tombstones(spark.createDataFrame(data, "batch_id string, event_id string"))
    assert out.filter("batch_id = 'big' AND error LIKE 'Max 100%'").count() == 101
    assert sorted(str(r.error) for r in out.filter("batch_id = 'ok'").collect()) == ["Invalid event_id", "Invalid event_id", "None"]


def test_ranges_limits_and_large_changes(spark):
    r = spark.createDataFrame([("x", 3, 5), ("y", 5, 3), ("z", 12, 12)], "client string, month_from int, month_to int")
    assert sorted((x.client, x.month) for x in B.expand_month_range(r).collect()) == [("x", 3), ("x", 4), ("x", 5), ("z", 12)]
    assert [B.history_limit(v) for v in ("5", 0, "x", 5000, None)] == [5, 200, 200, 1000, 200]
    cases = [(100.0, 0.0, True), (100.0, 150.0, False), (100.0, 151.0, True), (0.0, 500.0, False), (None, 5.0, False)]
    df = spark.createDataFrame(cases, "cur double, new double, expected boolean")
    assert all(x[0] == x[1] for x in df.select(B.large_change(F.col("cur"), F.col("new")), "expected").collect())


def test_rollover_resets_and_balances(spark):
    from decimal import Decimal as D

    base = spark.createDataFrame([("c", "m", 2023, 12, D(50)), ("c", "m", 2024, 1, D(100)), ("c", "m", 2024, 2, D(100)), ("c", "m", 2024, 4, D(100))], BASE)
    actual = spark.createDataFrame([("c", "m", 2024, 1, D(130)), ("c", "m", 2024, 3, D(20)), ("c", "m", 2024, 4, D(1))], ACTUAL)
    got = {(r.year, r.month): (float(r.rollover_in), float(r.available)) for r in P.rollover(base, actual).collect()}
    assert got == {(2023, 12): (0, 50), (2024, 1): (0, 100), (2024, 2): (-30, 70), (2024, 3): (70, 70), (2024, 4): (50, 150)}
    # identity: carried into a month = everything planned minus everything spent before it
    assert got[(2024, 4)][0] == (100 + 100) - (130 + 20)


def test_unbudgeted_spend_reads_as_underspending(spark):
    p = spark.createDataFrame([("a", "m", 2024, 1, 0.0, 10.0), ("b", "m", 2024, 1, 100.0, 108.0), ("d", "m", 2024, 2, 5.0, 5.0)],
                              "client string, channel string, year int, month int, committed double, actual double")
    got = {r.client: r for r in P.month_pacing(p, 1).withColumn("s", P.pacing_status(F.col("pct"))).collect()}
    assert (got["a"].pct, got["a"].s, got["a"].unbudgeted) == (0.0, "Underspending", True)
    assert (got["b"].s, got["b"].unbudgeted) == ("On track", False)
    assert got["d"].committed == 0.0
    o = P.pacing_overview(p, 1).first()
    assert (o.on_track, o.clients, o.committed, o.actual) == (1, 3, 100.0, 118.0)


def test_full_outer_pacing_fills_zeros(spark, rows):
    committed = spark.createDataFrame([("a", "m", 2024, 1, 10.0), ("a", "m", 2024, 1, 5.0), ("a", "m", 2023, 1, 1.0)],
                                      "client string, channel string, year int, month int, amount double")
    actual = spark.createDataFrame([("b", "m", 2024, 2, 3.0)], "client string, channel string, year int, month int, actual double")
    assert rows(P.pacing_api(committed, actual, 2024)) == [("a", "m", 2024, 1, 15.0, 0.0), ("b", "m", 2024, 2, 0.0, 3.0)]
    assert P.pacing_api(committed, actual, None).count() == 3


def test_capture_and_catchup(spark):
    data = [(0.0, 0.0, True, "Paused (Historical)"), (10.0, 0.0, False, "BQ Data Gap"), (10.0, 0.0, True, "Captured Mismatch (AM Over-reported)"),
            (0.0, 9.0, True, "Captured Mismatch (AM Under-reported)"), (100.0, 111.0, True, "Captured Mismatch (>10% diff)"),
            (100.0, 110.0, True, "Historical Match")]
    df = spark.createDataFrame(data, "reported double, captured double, data_available boolean, expected string")
    assert all(r.capture_status == r.expected for r in P.capture_status(df).collect())
    p = spark.createDataFrame([("c", "a", 2024, 1, 750.0, 900.0, 100.0), ("c", "b", 2024, 1, 250.0, 100.0, 100.0)],
                              "client string, channel string, year int, month int, committed double, actual double, catchup double")
    got = {r.channel: r for r in P.target_with_catchup(p).collect()}
    assert (got["a"].target, got["b"].target, got["a"].status) == (825.0, 275.0, "Underspending")
    assert spark.range(1).select(P.daily_recommendation(F.lit(310.0), F.lit(10.0), F.lit(0))).first()[0] == 300.0


def test_union_drops_channels_served_elsewhere(spark):
    cols = "customer_id string, account_name string, date date, spend double"
    from datetime import date

    one = spark.createDataFrame([("1", "n", date(2024, 1, 1), 5.0)], cols)
    other = one.withColumn("channel", F.lit("Bing")).unionByName(one.withColumn("channel", F.lit("LSA")))
    feeds = {"google_ads": one, "other": other}
    assert sorted(r.channel for r in SP.spend_union(feeds).collect()) == ["bing", "google_ads"]
    crosswalk = spark.createDataFrame([("2", "Known")], "customer_id string, canonical_client string")
    assert {r.client for r in SP.spend_daily_unified(feeds, crosswalk).collect()} == {"UNMAPPED: n"}


@pytest.mark.parametrize("months, expected", [("6", 6), (0, 6), (99, 24), ("x", 6), (None, 6), (24, 24)])
def test_months_clamp(months, expected):
    from adloom.operators.leads import months_clamped

    assert months_clamped(months) == expected
