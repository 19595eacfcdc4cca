from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from adloom.functions.keyed import latest_per_key, sequence_in_time

START = datetime(2024, 1, 1)


def _brute(df):
    w = Window.partitionBy("a", "b").orderBy(F.col("ts").asc_nulls_first(), "id")
    return df.select("id", F.row_number().over(w).cast("bigint").alias("n"), F.lag("ts").over(w).alias("p"))


def _same(df, bucket):
    got = sequence_in_time(df, ["a", "b"], "ts", "id", "n", "p", bucket).select("id", "n", "p")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, _brute(df).collect()), key=str)


def test_sequence_hot_key(spark):
    """One key holds most rows, keys are NULL, timestamps repeat or are missing."""
    data = [(i, "hot", None, START + timedelta(minutes=7 * (i // 2))) for i in range(400)]
    data += [(1000 + i, "x" if i % 2 else None, str(i % 3), START + timedelta(hours=i % 11)) for i in range(100)]
    data += [(2000, "hot", None, None), (2001, "hot", None, None), (2002, "x", "", START)]
    df = spark.createDataFrame(data, "id int, a string, b string, ts timestamp").repartition(7)
    for bucket in ("hour", "day", "month"):
        _same(df, bucket)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["k", "l", None]), st.sampled_from(["", "m", None]), st.integers(0, 200)), min_size=1, max_size=40))
def test_sequence_property(spark, items):
    data = [(i, a, b, START + timedelta(minutes=13 * m)) for i, (a, b, m) in enumerate(items)]
    _same(spark.createDataFrame(data, "id int, a string, b string, ts timestamp"), "hour")


def test_latest_limits_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    out = latest_per_key(df, ["k"], [F.desc("id")])
    assert sorted(r.id for r in out.collect()) == [997, 998, 999]
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]
