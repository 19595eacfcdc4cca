"""Numbers verified by hand in the original work."""

import pytest
from pyspark.sql import functions as F

from adloom.functions import scalars as S
from adloom.operators import leads, pacing


@pytest.mark.parametrize("spend, lead_count, expected", [
    (2577.0, 34, 75.79), (10463.0, 39, 268.28), (9786.0, 97, 100.89), (2515.0, 34, 73.97),
    (5000.0, 0, None), (0.0, 0, None), (0.0, 5, 0.0), (2979.0, 23, 129.52), (2979.0, 49, 60.80),
])
def test_cost_per_lead(spark, spend, lead_count, expected):
    df = spark.createDataFrame([(spend, lead_count)], "spend double, first_time bigint")
    value = df.select(leads.cpl("first_time")).first()[0]
    assert value is None if expected is None else value == pytest.approx(expected, abs=0.01)


def test_trend(spark):
    cases = [(90.0, 75.0, "up"), (75.0, 90.0, "down"), (75.0, 74.0, "flat"), (100.0, 100.0, "flat"), (103.0, 100.0, "up"),
             (75.0, None, None), (None, 75.0, None), (5.0, 0.0, "up"), (0.0, 0.0, "down")]
    df = spark.createDataFrame(cases, "cur double, prev double, expected string")
    got = df.select(leads.trend(F.col("cur"), F.col("prev")).alias("t"), "expected").collect()
    assert [r.t for r in got] == [r.expected for r in got]


PACING = [
    ("google_ads", 1, 0.0, 3132.87), ("google_ads", 2, 0.0, 3184.56), ("google_ads", 3, 0.0, 2234.15),
    ("google_ads", 5, 2750.0, 629.82), ("google_ads", 6, 2750.0, 2607.58), ("google_ads", 7, 2750.0, 2299.73),
    ("google_ads", 8, 2750.0, 589.93), ("lsa", 1, 0.0, 1400.31), ("lsa", 5, 0.0, 716.35), ("lsa", 8, 0.0, 511.08),
]


@pytest.fixture
def managed(spark):
    p = spark.createDataFrame([("Client A", c, 2026, m, k, a) for c, m, k, a in PACING],
                              "client string, channel string, year int, month int, committed double, actual double")
    starts = spark.createDataFrame([("Client A", 5)], "client string, start_month int")
    exceptions = spark.createDataFrame([("Client A", "lsa")], "client string, channel string")
    return p, starts, exceptions


def test_managed_year(managed):
    p, starts, exceptions = managed
    r = pacing.year_pacing_managed(p, starts, exceptions, 8).first()
    assert r.committed_ytd == 11000
    assert r.spent_ytd == pytest.approx(6127.06)
    assert r.ytd_variance == pytest.approx(-4872.94)


def test_status_actual(managed):
    p, _, exceptions = managed
    assert pacing.status_actual(p, exceptions, 8).first().actual == pytest.approx(589.93)


def test_money(spark):
    cases = [("USD 9458.925231", "9458.925231000"), ("USD 0", "0E-9"), ("", None), ("USD n/a", None), (None, None), ("12.5", "12.500000000"),
             ("USD 0.0000000005", "0E-9"), ("USD 0.0000000015", "2E-9")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "raw string")
    got = [r[0] for r in df.select(S.parse_money(F.col("raw"))).collect()]
    assert [None if v is None else str(v) for v in got] == [b for _, b in cases]
