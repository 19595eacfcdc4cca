from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegerType, StringType, StructField, StructType, TimestampType

from adloom.session import work_dir
from adloom.sinks import registry as E, tables as T
from adloom.streaming import jobs as J

SCHEMA = StructType([StructField("date", DateType()), StructField("campaign", StringType()), StructField("cost", IntegerType())])
KEYS = ["date", "campaign"]


def now():
    return F.lit(datetime(2024, 1, 31))


def frame(spark, *rows):
    return spark.createDataFrame([(date(2024, 1, d), c, v) for d, c, v in rows], SCHEMA)


def content(spark, path):
    return sorted((r.date.day, r.campaign, r.cost) for r in T.read_partitioned(spark, path, SCHEMA).collect())


@pytest.fixture
def table(spark):
    path = work_dir(spark, "t")
    T.ensure_table(spark, path, SCHEMA, "date")
    T.replace_range(spark, path, frame(spark, (1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "a", 4)), SCHEMA, "date", date(2024, 1, 1), date(2024, 1, 4))
    return path


def test_range_replace(spark, table):
    pull = frame(spark, (2, "b", 9))
    for _ in range(2):  # running it again changes nothing
        assert T.replace_range(spark, table, pull, SCHEMA, "date", date(2024, 1, 2), date(2024, 1, 3))
        assert content(spark, table) == [(1, "a", 1), (2, "b", 9), (4, "a", 4)]
    assert not T.replace_range(spark, table, frame(spark), SCHEMA, "date", date(2024, 1, 1), date(2024, 1, 4))
    assert content(spark, table) == [(1, "a", 1), (2, "b", 9), (4, "a", 4)]


def test_range_replace_keeps_rows_beside_strays(spark, table):
    T.replace_range(spark, table, frame(spark, (2, "b", 9), (4, "s", 5)), SCHEMA, "date", date(2024, 1, 2), date(2024, 1, 2))
    assert content(spark, table) == [(1, "a", 1), (2, "b", 9), (3, "a", 3), (4, "a", 4), (4, "s", 5)]


def test_upsert(spark, table):
    staged = frame(spark, (1, "a", 10), (1, "n", 11), (9, "z", 12))
    for _ in range(2):
        T.merge_upsert(spark, table, staged, SCHEMA, KEYS, "date", now())
        assert content(spark, table) == [(1, "a", 10), (1, "n", 11), (2, "a", 2), (3, "a", 3), (4, "a", 4), (9, "z", 12)]
    with pytest.raises(ValueError):
        T.merge_upsert(spark, table, staged, SCHEMA, ["campaign"], "date", now())


def test_upsert_moves_rows_between_partitions(spark, table):
    T.upsert_by_id(spark, table, frame(spark, (2, "a", 7)), SCHEMA, ["campaign", "cost"], "date", now())
    T.upsert_by_id(spark, table, frame(spark, (3, "a", 4)), SCHEMA, ["campaign", "cost"], "date", now())
    assert content(spark, table) == [(1, "a", 1), (2, "a", 2), (2, "a", 7), (3, "a", 3), (3, "a", 4)]


def test_set_columns_and_load_time(spark):
    schema = "k int, a string, b string, load_timestamp timestamp"
    old = datetime(2020, 1, 1)
    target = spark.createDataFrame([(1, "x", "y", old), (2, "x", "y", old)], schema)
    staged = spark.createDataFrame([(2, None, "new", 1), (2, "late", "new", 2), (3, "p", "q", 1)], "k int, a string, b string, seq int")
    out = T.merged(target, staged, ["k"], now(), set_cols=["a"], newest=[F.asc("seq")])
    got = {r.k: (r.a, r.b, r.load_timestamp) for r in out.collect()}
    assert got == {1: ("x", "y", old), 2: (None, "y", datetime(2024, 1, 31)), 3: ("p", "q", datetime(2024, 1, 31))}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 5), st.sampled_from("ab"), st.integers(0, 9)), max_size=8))
def test_pure_forms_are_idempotent(spark, staged):
    target = frame(spark, (1, "a", 1), (2, "b", 2))
    rows = frame(spark, *{(d, c): (d, c, v) for d, c, v in staged}.values())
    once = T.merged(target, rows, KEYS, now())
    assert sorted(once.collect()) == sorted(T.merged(once, rows, KEYS, now()).collect())
    span = (F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 5)))
    replaced = T.replaced_range(target, rows, "date", *span)
    assert sorted(replaced.collect()) == sorted((rows if staged else target).collect())
    assert sorted(T.replaced_range(replaced, rows, "date", *span).collect()) == sorted(replaced.collect())


def test_last_complete_copy_survives(spark):
    base = work_dir(spark, "sheet")
    T.publish(spark.range(3).toDF("v"), base)
    assert T.current(spark, base).count() == 3
    bad = spark.range(3).select(F.raise_error(F.lit("broken sheet")).cast("bigint").alias("v"))
    with pytest.raises(Exception):
        T.publish(bad, base)
    assert T.current(spark, base).count() == 3
    T.publish(spark.range(5).toDF("v"), base)
    assert T.current(spark, base).count() == 5


EVENTS = StructType([StructField("event_id", StringType()), StructField("amount", DecimalType(38, 9)), StructField("changed_at", TimestampType())])


def events(spark, *rows):
    return spark.createDataFrame([(i, Decimal(a), datetime(2024, 1, d)) for i, a, d in rows], EVENTS)


def test_append_and_tombstones(spark):
    log, gone = work_dir(spark, "log"), work_dir(spark, "gone")
    T.append_event(spark, log, events(spark, ("a", 1, 1), ("a", 1, 1)), EVENTS)
    T.append_event(spark, log, events(spark, ("a", 1, 1), ("b", 2, 1)), EVENTS)
    assert sorted(r.event_id for r in spark.read.parquet(log).collect()) == ["a", "b"]
    schema = StructType.fromDDL("event_id string, deleted_by string, deleted_at timestamp")
    ids = spark.createDataFrame([("a",), ("a",)], "event_id string")
    for _ in range(2):
        T.append_tombstones(spark, gone, ids, F.lit("me"), now(), schema)
    assert spark.read.parquet(gone).count() == 1


def test_stream_equals_batch(spark):
    """A duplicate in the same file, one in a later file, and a late file."""
    landing, log, ckpt = (work_dir(spark, n) for n in ("landing", "log", "ckpt"))

    def run():
        J.stream_events(J.file_stream(spark, landing, EVENTS, "json"), log, EVENTS, ckpt, horizon="1 day").awaitTermination()

    first = events(spark, ("a", 1, 5), ("a", 1, 5), ("b", 2, 6))
    first.write.mode("append").json(landing)
    run()
    second = events(spark, ("b", 2, 6), ("c", 3, 20))
    second.write.mode("append").json(landing)
    run()
    late = events(spark, ("d", 4, 20), ("a", 1, 20), ("old", 5, 1))
    late.write.mode("append").json(landing)
    run()
    got = sorted(r.event_id for r in spark.read.schema(EVENTS).parquet(log).collect())
    assert got == sorted(r[0] for r in first.union(second).union(late).select("event_id").distinct().collect())


def test_stream_restatement(spark, table):
    landing, ckpt = work_dir(spark, "landing"), work_dir(spark, "ckpt")
    for pull in (frame(spark, (3, "a", 30), (5, "n", 50)), frame(spark, (3, "a", 31))):
        pull.write.mode("append").json(landing)
        J.stream_restate(J.file_stream(spark, landing, SCHEMA), table, SCHEMA, KEYS, "date", ckpt, now()).awaitTermination()
    assert content(spark, table) == [(1, "a", 1), (2, "a", 2), (3, "a", 31), (4, "a", 4), (5, "n", 50)]


def test_stream_range_replace(spark, table):
    landing, ckpt = work_dir(spark, "landing"), work_dir(spark, "ckpt")
    frame(spark, (2, "p", 1), (4, "p", 2)).coalesce(1).write.json(landing)
    J.stream_range_replace(J.file_stream(spark, landing, SCHEMA), table, SCHEMA, "date", ckpt).awaitTermination()
    assert content(spark, table) == [(1, "a", 1), (2, "p", 1), (4, "p", 2)]


def test_registry_edits(spark):
    rules = spark.createDataFrame([(1, 10), (2, 20)], "id int, status_id int")
    conds = spark.createDataFrame([(1, 0, "ctr"), (1, 1, "cvr"), (2, 0, "cpa")], "rule_id int, position int, metric string")
    edits = spark.createDataFrame([(1, [("spend",)]), (3, [("x",), ("y",)])], "rule_id int, conditions array<struct<metric:string>>")
    assert sorted(map(tuple, E.replace_children(conds, edits).collect())) == [(1, 0, "spend"), (2, 0, "cpa"), (3, 0, "x"), (3, 1, "y")]
    r, c = E.delete_cascade(rules, conds, spark.createDataFrame([(1,)], "id int"))
    assert ([x.id for x in r.collect()], [x.rule_id for x in c.collect()]) == ([2], [2])
    statuses = spark.createDataFrame([(10,), (30,)], "id int")
    out = E.delete_guarded(statuses, rules, spark.createDataFrame([(10,), (30,), (99,)], "id int"))
    assert {x.id: x.outcome for x in out.collect()} == {10: "in_use", 30: "deleted", 99: "not_found"}
    users = spark.createDataFrame([("A@x.io",)], "email string")
    more = spark.createDataFrame([("a@X.io",), ("b@x.io",), ("B@x.io",)], "email string")
    assert E.insert_if_absent(users, more).count() == 2


def test_work_dir_reads_the_session_setting(spark):
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_newest_complete_pull_owns_each_day(spark):
    from datetime import date, datetime

    from adloom.streaming.pulls import owned_days
    done = spark.createDataFrame([(2, date(2024, 1, 1), date(2024, 1, 3), datetime(2024, 3, 1)),
                                  (3, date(2024, 1, 2), date(2024, 1, 4), datetime(2024, 2, 1))],
                                 "pull_id long, since date, until date, pulled_at timestamp")
    versions = spark.createDataFrame([(date(2024, 1, 4), 9, datetime(2024, 2, 10)), (date(2024, 1, 1), 1, datetime(2024, 1, 1))],
                                     "day date, pull_id long, pulled_at timestamp")
    got = sorted((r.day.isoformat(), r.pull_id) for r in owned_days(done, versions).collect())
    # day 4 stays with the newer pull 9 of an earlier batch; pull 3 is older than pull 2 on days 2 and 3
    assert got == [("2024-01-01", 2), ("2024-01-02", 2), ("2024-01-03", 2)]


def test_append_reads_only_the_buckets_of_its_batch(spark):
    log = work_dir(spark, "log")
    many = [(f"id{i}", i, 1) for i in range(400)]
    T.append_event(spark, log, events(spark, *many), EVENTS)
    batch = events(spark, ("id7", 7, 1), ("new", 1, 2))
    buckets = sorted({r[0] for r in batch.select(T.log_bucket("event_id")).collect()})
    read = T.log_slice(spark, log, EVENTS, "event_id", buckets).inputFiles()
    assert read and all(any(f"/bucket={b}/" in f for b in buckets) for f in read)
    every = spark.read.parquet(log).inputFiles()
    assert len(read) < len(every)
    T.append_event(spark, log, batch, EVENTS)
    assert T.read_log(spark, log, EVENTS).count() == 401


def test_replayed_batch_reads_nothing_and_repeats_follow_the_order(spark):
    log = work_dir(spark, "log")
    T.append_event(spark, log, events(spark, ("a", 1, 1), ("a", 5, 2)), EVENTS, order=[F.desc("changed_at")], batch="w-0")
    assert [(r.event_id, int(r.amount)) for r in T.read_log(spark, log, EVENTS).collect()] == [("a", 5)]
    # the replay of a committed batch is skipped before anything is read
    T.append_event(spark, log, events(spark, ("b", 1, 1)), EVENTS, batch="w-0")
    assert T.read_log(spark, log, EVENTS).count() == 1
    with pytest.raises(Exception, match="several staged rows"):
        T.append_event(spark, log, events(spark, ("c", 1, 1), ("c", 2, 1)), EVENTS)


def test_upsert_index_follows_moves_and_reads_only_touched_buckets(spark):
    schema = StructType.fromDDL("id string, day date, v int")
    path = work_dir(spark, "moves")
    T.ensure_table(spark, path, schema, "day")
    rows = spark.createDataFrame([(f"k{i}", date(2024, 1, 1 + i % 5), i) for i in range(300)], schema)
    T.upsert_by_id(spark, path, rows, schema, ["id"], "day", now())
    for moved_to in (date(2024, 2, 1), date(2024, 2, 2)):  # one key moves twice
        T.upsert_by_id(spark, path, spark.createDataFrame([("k7", moved_to, 70)], schema), schema, ["id"], "day", now())
    table = T.read_partitioned(spark, path, schema)
    assert table.count() == 300
    assert [(r.day, r.v) for r in table.where("id = 'k7'").collect()] == [(date(2024, 2, 2), 70)]
    index = spark.read.parquet(f"{path}/{T.INDEX}").select("id", "day")
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, table.select("id", "day").collect()))
    bucket = spark.createDataFrame([("k7",)], "id string").select(T.key_bucket(["id"])).first()[0]
    read = T.index_slice(spark, path, schema, ["id"], "day", [bucket]).inputFiles()
    assert read and all(f"/bucket={bucket}/" in f for f in read)


@pytest.fixture
def stream_session(spark):
    """The settings of a stream's batches: adaptive execution off; small parts, so that little data makes several."""
    now = {"spark.sql.adaptive.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_days_are_gathered_in_a_streams_session(stream_session, tmp_path):
    spark = stream_session
    rows = spark.range(0, 4_000, 1, 4).selectExpr("id", "date_add(DATE '2024-01-01', CAST(id % 20 AS INT)) AS date")
    T._write_partitions(rows, str(tmp_path / "t"), "date")
    assert len(list((tmp_path / "t").glob("date=*/*.parquet"))) == 20  # one of each, not one of each input part
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.countDistinct("id")).first()[0] == 4_000
    assert spark.conf.get("spark.sql.adaptive.enabled") == "false"


def test_a_large_landed_file_is_staged_in_parts(stream_session, tmp_path, monkeypatch):
    from adloom.streaming import pulls
    from adloom.streaming.pulls import stage_files

    monkeypatch.setattr(pulls, "PIECE", 64 << 10, raising=False)
    spark = stream_session
    landing, staging, markers = (str(tmp_path / n) for n in ("landing", "staging", "markers"))
    rows = spark.range(0, 40_000, 1, 4).selectExpr("id", "uuid() AS note", "1L AS pull_id")
    rows.write.parquet(landing)
    stage_files(spark.readStream.schema(rows.schema).parquet(landing), staging, markers, str(tmp_path / "ckpt")).awaitTermination()
    folders = list((tmp_path / "staging").glob("pull_id=1/file_key=*"))
    assert len(folders) == 4 and all(len(list(f.glob("*.parquet"))) > 1 for f in folders)
    assert spark.read.parquet(staging).agg(F.countDistinct("id")).first()[0] == 40_000
    assert spark.read.parquet(markers).count() == 4


def test_merged_partitions_are_small(spark):
    from adloom.session import tune

    tune(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
