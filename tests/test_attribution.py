from datetime import datetime

import pytest
from pyspark.sql import functions as F

from adloom.operators import attribution as A

FIELDS = ("source string, medium string, web_source string, landing_page string, last_url string, tag_list string, "
          "call_status string, talk_time int, transcription_text string")


def one(spark, **kw):
    names = [p.split()[0] for p in FIELDS.split(", ")]
    return A.with_signals(spark.createDataFrame([tuple(kw.get(n) for n in names)], FIELDS))


@pytest.mark.parametrize("fields, channel, method", [
    ({"landing_page": "https://a.b/x?GCLID=Z", "source": "Bing Paid"}, "google_paid", "url_click_id"),
    ({"last_url": "https://a.b/x?y=1&wbraid=Z", "landing_page": "https://a.b/?msclkid=1"}, "google_paid", "url_click_id"),
    ({"landing_page": "https://a.b/?msclkid=1", "source": "Google Ads"}, "bing_paid", "url_click_id"),
    ({"last_url": "https://a.b/?msclkid=1"}, "unknown", "none"),
    ({"source": "Google Business Profile - East", "medium": "cpc", "web_source": "google"}, "gbp", "dedicated_number"),
    ({"source": "Google Call Asset"}, "google_paid", "dedicated_number"),
    ({"source": "Yelp"}, "referral", "dedicated_number"),
    ({"source": "Other", "medium": "PPC", "web_source": "Google"}, "google_paid", "medium_field"),
    ({"medium": "organic", "web_source": "bing"}, "bing_organic", "medium_field"),
    ({"medium": "paid", "web_source": "meta"}, "meta_paid", "medium_field"),
    ({"medium": "Streaming TV"}, "offline", "medium_field"),
    ({"medium": "", "web_source": "(direct)"}, "direct", "none"),
    ({"medium": "cpc", "web_source": "yahoo"}, "unknown", "medium_field"),
    ({}, "unknown", "none"),
])
def test_channel_and_method(spark, fields, channel, method):
    r = one(spark, **fields).select(A.channel(), A.method()).first()
    assert tuple(r) == (channel, method)


def test_captures(spark):
    r = one(spark, landing_page="https://h.com/p/q?x=1&gclid=AbC#z", last_url="https://h.com/?gclid=other").select(
        A.gclid(), A.landing_page_path()).first()
    assert tuple(r) == ("abc#z", "/p/q")
    r = one(spark, landing_page="https://h.com", last_url="https://h.com/?gclid=other").select(A.gclid(), A.landing_page_path()).first()
    assert tuple(r) == (None, None)


def test_tags_and_flags(spark):
    def tags(text):
        f = A.flags()
        return tuple(one(spark, tag_list=text, call_status="answered").select(
            f["ctm_tag_closed"], f["ctm_tag_new_customer"], f["ctm_tag_spam"], f["is_likely_voicemail"]).first())

    assert tags("closed, vip") == (True, False, False, True)
    assert tags("disclosed") == (False, False, False, True)
    assert tags("é spam, new customer") == (False, True, True, True)
    assert tags(None) == (False, False, False, True)


def test_local_time(spark):
    rows = [(datetime(2024, 1, 1, 2, 30), "9PM"), (datetime(2024, 1, 1, 2, 30), "n/a"), (datetime(2024, 1, 1, 2, 30), "12AM"),
            (datetime(2024, 1, 1, 20, 0), "5AM"), (datetime(2024, 1, 1, 2, 30), None)]
    df = spark.createDataFrame(rows, "called_at_ts timestamp, hour string")
    out = A.with_local_time(df).select("tz_offset_hours", F.date_format("called_at_local", "dd HH:mm")).collect()
    assert [tuple(r) for r in out] == [(5, "31 21:30"), (0, "01 02:30"), (2, "01 00:30"), (15, "01 05:00"), (0, "01 02:30")]


def test_history(spark):
    day = lambda d, h=0: datetime(2024, 1, 1, h) if d == 0 else datetime(2024, 1, 1 + d, h) if d < 31 else datetime(2024, 2, d - 30, h)
    rows = [(1, "c", "5", day(0, 12)), (2, "c", "5", day(30, 23)), (3, "c", None, day(0)), (4, "c", None, day(1)), (5, "d", "5", day(3)),
            (6, "c", "5", datetime(2024, 3, 3, 0))]
    df = spark.createDataFrame(rows, "id int, client_key string, caller_number_bare string, called_at_ts timestamp")
    got = {r.id: r for r in A.with_caller_history(df).collect()}
    assert (got[2].caller_sequence_num, got[2].days_since_prior_call, got[2].is_duplicate_lead_30d) == (2, 30, True)
    assert (got[6].days_since_prior_call, got[6].is_duplicate_lead_30d) == (32, False)
    assert got[4].caller_sequence_num == 2 and got[3].caller_hash == got[4].caller_hash
    assert got[5].is_first_call and got[1].is_duplicate_lead_30d is False


def test_null_status_is_dropped(spark):
    df = spark.createDataFrame([("answered",), (None,), ("sent",)], "call_status string")
    assert [r[0] for r in A.voice_calls(df).collect()] == ["answered"]
