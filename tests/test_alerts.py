from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from adloom.functions import labels as L, scalars as S
from adloom.operators import alerts as A, board as B

AS_OF = date(2024, 1, 31)
MAPPING = ("google_ads_customer_id string, client_name string, account_manager string, tier string, sub_mcc string, av_status string")


def mapping(spark, *rows):
    return spark.createDataFrame([(i, n, "AM", "T1", "M", av) for i, n, av in rows], MAPPING)


def test_no_spend_persistence(spark):
    silent = {"a3": 3, "a2": 2, "b6": 6, "b7": 7, "c7": 7, "c29": 29}
    spend = [(k, "google", AS_OF - timedelta(days=d), 5.0) for k, d in silent.items()] + [("z", "google", AS_OF - timedelta(days=9), 0.0)]
    df = spark.createDataFrame(spend, "customer_id string, platform string, spend_date date, spend double")
    m = mapping(spark, *[(k, k, "AV Approved" if k.startswith("c") else None) for k in silent])
    out = A.no_spend(df, m, F.lit(AS_OF), F.lit(datetime(2024, 1, 31)))
    assert {r.customer_id for r in out.collect()} == {"a3", "b6", "c7", "c29"}
    assert out.columns == L.ALERT_COLUMNS
    text = out.filter("customer_id = 'b6'").first().detail
    assert text == ('Account "b6" (google) stopped spending: last spend 2024-01-25 (6 days ago). Was active before. '
                    "Check billing/campaigns.")


def test_snapshot_calendar(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), "x")], "snapshot_date date, v string")
    calendar = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 2),)], "snapshot_date date")
    assert A.latest_snapshot(df).count() == 1
    assert A.latest_snapshot(df, calendar=calendar).count() == 0


def test_url_reasons(spark, rows):
    both = "DESTINATION_NOT_ACCESSIBLE,DESTINATION_NOT_WORKING"
    data = [("1", "7", both), ("1", "7", "DESTINATION_NOT_ACCESSIBLE"), ("1", "8", both), ("1", "9", "ALCOHOL"), ("1", "9", None)]
    df = spark.createDataFrame([(AS_OF, c, k, "n", "DISAPPROVED", t) for c, k, t in data],
                               "snapshot_date date, customer_id string, campaign_id string, campaign_name string, approval_status string, policy_topics string")
    assert rows(A.url_problems(df), "campaign_id", "ad_count", "url_reason") == [
        ("7", 2, "URL not accessible, URL not working"), ("8", 1, "URL not working")]


def test_whole_text_and_missing_status(spark):
    r = spark.range(1).select(S.whole_text(F.lit(110.0)), S.whole_text(F.lit(2.5)), A.not_ok(F.lit(None).cast("string")),
                              A.not_ok(F.lit("UNKNOWN")), A.not_ok(F.lit("PENDING"))).first()
    assert tuple(r) == ("110", "3", False, False, True)


def test_fan_out_duplicates_alerts(spark):
    df = spark.createDataFrame([(5, 1, "c", "ENABLED", "SUSPENDED", "SEARCH", AS_OF, AS_OF)],
                               "customer_id bigint, campaign_id bigint, campaign_name string, campaign_status string, "
                               "campaign_serving_status string, campaign_advertising_channel_type string, _DATA_DATE date, _LATEST_DATE date")
    out = A.campaign_suspended(df, mapping(spark, ("5", "x", None), ("5", "y", None)), F.lit(datetime(2024, 1, 1)))
    assert out.count() == 2


def test_board(spark):
    now = datetime(2024, 1, 31, 12)
    data = [("P1", now - timedelta(hours=1), "No"), ("P0", now - timedelta(days=3), "av approved"), ("P0", now - timedelta(minutes=20), None),
            ("PX", now, "Stuck")]
    df = spark.createDataFrame([("overspend", s, "x", str(i), None, None, None, None, av, None, None, None, t)
                                for i, (s, t, av) in enumerate(data)],
                               "alert_type string, severity string, source string, customer_id string, client_name string, account_manager string, "
                               "tier string, sub_mcc string, av_status string, entity_id string, entity_name string, detail string, detected_at timestamp")
    rows = B.normalize_alerts(df)
    assert [r.customer_id for r in rows.orderBy(*B.board_order(rows)).collect()] == ["2", "1", "0", "3"]
    assert [r.customer_id for r in B.page(rows, B.board_order(rows), 2, 3).collect()] == ["3"]
    first = rows.filter("customer_id = '0'").first()
    assert (first.account_manager, first.detail, first.type_label) == ("(Unassigned)", "", "Overspend")
    labels = rows.orderBy("customer_id").select(B.age_label(F.col("detected_at"), F.lit(now)), B.is_new(F.col("detected_at"), F.lit(now))).collect()
    assert [tuple(r) for r in labels] == [("1h ago", True), ("3d ago", False), ("just now", True), ("just now", True)]
    assert B.alert_filter(rows, av="other").count() == 2 and B.alert_filter(rows, q="(UNASS").count() == 4
    m = B.alert_metrics(rows).first()
    assert (m.total, m.p0, m.p1, m.on_av) == (4, 2, 1, 1)
