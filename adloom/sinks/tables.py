"""Table maintenance on plain Parquet: range replace, upsert, append and versioned full replace.

Every operation has a pure form (DataFrames in, DataFrame out) and a write form. The write
forms touch only the partitions that change and go through a written intermediate in the
shared work folder, so a table is never read and overwritten in one plan and a job that
dies half-way can be run again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from adloom.functions.keyed import latest_per_key
from adloom.session import work_dir


# ---- file-system helpers ---------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [status.getPath().getName() for status in fs.listStatus(p)]


def _drop_partition(spark: SparkSession, path: str, column: str, value: str) -> None:
    fs, p = _fs(spark, f"{path}/{column}={value}")
    if fs.exists(p):
        fs.delete(p, True)


# ---- versioned full replace --------------------------------------------------------------
def publish(df: DataFrame, base_path: str) -> str:
    """Write a complete new copy beside the old ones; it becomes current once it is complete."""
    version = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    path = f"{base_path}/copy={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def current(spark: SparkSession, base_path: str) -> DataFrame:
    """The newest complete copy."""
    for name in sorted(children(spark, base_path), reverse=True):
        if name.startswith("copy=") and exists(spark, f"{base_path}/{name}/_SUCCESS"):
            return spark.read.parquet(f"{base_path}/{name}")
    raise FileNotFoundError(f"no complete copy below {base_path}")


# ---- staging and creation ------------------------------------------------------------------
def load_staging(df: DataFrame, path: str) -> DataFrame:
    """Truncate and load."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a result that is used several times to the shared work folder and read it back.

    It cuts the lineage, survives lost executors and is computed once.
    """
    return load_staging(df, work_dir(df.sparkSession, label))


def ensure_table(spark: SparkSession, path: str, schema: StructType, partition: str) -> None:
    """Create an empty partitioned table unless it exists."""
    if not exists(spark, f"{path}/_SUCCESS") and not children(spark, path):
        spark.createDataFrame([], schema).write.partitionBy(partition).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


@contextmanager
def adaptive(spark: SparkSession) -> Iterator[None]:
    """Adaptive execution for a write: a stream turns it off in the session of its batches, where Spark would
    drop the rebalance hint and sort whole input splits, however large, in one task each."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _write_partitions(df: DataFrame, path: str, partition: str, cluster: Sequence[str] = ()) -> None:
    """Replace exactly the partitions present in df.

    The rebalance hint lets adaptive execution gather each date into few files, merge small
    dates and split a date that holds most of the rows, all by measured size.
    """
    with adaptive(df.sparkSession):
        (
            df.hint("rebalance", F.col(partition))
            .sortWithinPartitions(partition, *cluster)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition)
            .parquet(path)
        )


class _Work:
    """Written intermediates of one job; dropped when the job has succeeded, kept when it fails."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, []

    def write(self, df: DataFrame) -> DataFrame:
        path = work_dir(self.spark, self.label)
        out = load_staging(df, path)
        self.paths.append(path)
        return out

    def __enter__(self) -> _Work:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            for path in self.paths:
                fs, p = _fs(self.spark, path)
                fs.delete(p, True)


# ---- range replace ---------------------------------------------------------------------
def replaced_range(target: DataFrame, staged: DataFrame, date_col: str, since: Column, until: Column) -> DataFrame:
    """DELETE the range, INSERT what was staged; an empty pull changes nothing."""
    pulled = staged.agg(F.count(F.lit(1))).scalar() > 0
    outside = ~F.coalesce(F.col(date_col).between(since, until), F.lit(False))
    return target.filter(outside | ~pulled).unionByName(staged.select(*target.columns))


def replace_range(
    spark: SparkSession, path: str, staged: DataFrame, schema: StructType, date_col: str,
    since: date, until: date, cluster: Sequence[str] = (),
) -> bool:
    """Replace [since, until] of a table partitioned by date; also clears dates that are now empty.

    Cost follows the range, not the table. New partitions are written before vanished ones are
    dropped, and repeating the call gives the same table.
    """
    in_range = F.col(date_col).between(F.lit(since), F.lit(until))
    with _Work(spark, "replace-range") as job:
        work = job.write(staged.select(*schema.names))
        if work.isEmpty():
            return False
        kept = _touched(read_partitioned(spark, path, schema).filter(~in_range), date_col, work.filter(~in_range))
        out = job.write(work.unionByName(kept.select(*schema.names)))
        _write_partitions(out, path, date_col, cluster)
        # one row per calendar day of the range: bounded by the look-back, not by the data
        filled = {str(r[0]) for r in work.filter(in_range).select(date_col).distinct().collect()}
        for name in children(spark, path):
            if name.startswith(f"{date_col}="):
                day = name.split("=", 1)[1]
                if str(since) <= day <= str(until) and day not in filled:
                    _drop_partition(spark, path, date_col, day)
    return True


# ---- upsert ----------------------------------------------------------------------------
def _unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows themselves, or an error when two have the same key."""
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) > 1
    text = F.concat(F.lit("several staged rows for key "), F.to_json(F.struct(*keys)), F.lit(": give the order that decides"))
    return rows.withColumn("_again", F.when(again, F.raise_error(text).cast("boolean")).otherwise(F.lit(False))).filter(~F.col("_again")).drop("_again")


def merged(
    target: DataFrame, staged: DataFrame, keys: Sequence[str], now: Column,
    set_cols: Sequence[str] | None = None, newest: Sequence[Column] | None = None,
) -> DataFrame:
    """Update matches, insert the rest, never delete; the load time marks changed rows.

    Of staged rows with one key the newest by the given order wins; without an order a repeated key
    stops the job, since any choice would be a guess.
    """
    data = [c for c in target.columns if c not in (*keys, "load_timestamp")]
    updated = set(data if set_cols is None else set_cols)
    unique = latest_per_key(staged, list(keys), newest) if newest else _unique(staged, list(keys))
    s = unique.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in data], F.lit(True).alias("_hit"))
    t = target.withColumn("_old", F.lit(True))
    hit, old = F.coalesce("_hit", F.lit(False)), F.coalesce("_old", F.lit(False))
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c == "load_timestamp":
            cols.append(F.when(hit, now).otherwise(F.col(c)).alias(c))
        else:
            take = hit if c in updated else (hit & ~old)
            cols.append(F.when(take, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
    return t.join(s, list(keys), "full").select(*cols)


def _touched(table: DataFrame, partition: str, rows: DataFrame) -> DataFrame:
    """The partitions of a table that rows name, as a literal list: the scan lists and reads only those.

    The list has one value per calendar day touched, so the span of the batch bounds it, not its rows.
    """
    days = [r[0] for r in rows.select(partition).distinct().collect()]
    return table.filter(F.col(partition).isin(days) if days else F.lit(False))


def merge_upsert(
    spark: SparkSession, path: str, staged: DataFrame, schema: StructType, keys: Sequence[str], partition: str,
    now: Column, set_cols: Sequence[str] | None = None, newest: Sequence[Column] | None = None,
) -> None:
    """Upsert into a partitioned table; the partition column is part of the key, so only the
    partitions present in the staged rows are read and rewritten."""
    if partition not in keys:
        raise ValueError("the partition column must be part of the key")
    with _Work(spark, "merge") as job:
        work = job.write(staged)
        target = _touched(read_partitioned(spark, path, schema), partition, work)
        out = job.write(merged(target, work, keys, now, set_cols, newest))
        _write_partitions(out, path, partition, [k for k in keys if k != partition])


#: Hash buckets of the key index kept beside a table that `upsert_by_id` maintains.
INDEX_BUCKETS = 64
INDEX = "_index"


def key_bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(INDEX_BUCKETS)).cast("int")


def index_slice(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], partition: str, buckets: Sequence[int],
) -> DataFrame:
    """(keys, partition) of the index in the given buckets; only their files are listed and read.

    A table that has partitions but no index yet gets one, once, from a full scan."""
    fields = StructType([schema[k] for k in keys] + [schema[partition]])
    base = f"{path}/{INDEX}"
    if not exists(spark, base) and any(c.startswith(f"{partition}=") for c in children(spark, path)):
        full = read_partitioned(spark, path, schema).select(*keys, partition).withColumn("bucket", key_bucket(keys))
        full.write.mode("overwrite").partitionBy("bucket").parquet(base)
    found = [f"{base}/bucket={b}" for b in sorted(buckets) if exists(spark, f"{base}/bucket={b}")]
    return spark.read.schema(fields).parquet(*found) if found else spark.createDataFrame([], fields)


def upsert_by_id(
    spark: SparkSession, path: str, staged: DataFrame, schema: StructType, keys: Sequence[str], partition: str,
    now: Column, newest: Sequence[Column] | None = None,
) -> None:
    """Upsert where a row may move to another partition (its date was corrected).

    A key index in hash buckets, kept beside the table, tells which partitions hold old versions: only the
    buckets of the staged keys are read, never the table as a whole. Those partitions and the new ones are
    rewritten, then the touched buckets of the index. A crash between the two leaves old locations in the
    index; replaying the batch reads both old and new partitions and repairs it.
    """
    with _Work(spark, "upsert") as job:
        work = job.write(staged.withColumn("_bucket", key_bucket(keys)))
        buckets = [r[0] for r in work.select("_bucket").distinct().collect()]  # at most INDEX_BUCKETS
        slice_ = job.write(index_slice(spark, path, schema, keys, partition, buckets))
        old_parts = slice_.join(work.select(*keys).distinct(), list(keys), "left_semi").select(partition)
        touched = job.write(old_parts.union(work.select(partition)).distinct())
        days = [r[0] for r in touched.collect()]  # one row per touched calendar day
        target = read_partitioned(spark, path, schema).filter(F.col(partition).isin(days) if days else F.lit(False))
        out = job.write(merged(target.select(*schema.names), work.drop("_bucket"), keys, now, None, newest))
        _write_partitions(out, path, partition, list(keys))
        left = {str(r[0]) for r in out.select(partition).distinct().collect()}
        for value in days:
            if str(value) not in left:
                _drop_partition(spark, path, partition, str(value))
        kept = slice_.filter(~F.col(partition).isin(days) if days else F.lit(True))
        moved = out.select(*keys, partition).filter(key_bucket(keys).isin(buckets))
        (kept.unionByName(moved).withColumn("bucket", key_bucket(keys)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{INDEX}"))


def accumulate_snapshot(
    spark: SparkSession, path: str, today: DataFrame, schema: StructType, keys: Sequence[str], partition: str, now: Column
) -> None:
    """Add a daily snapshot to a growing history; re-running a day replaces it."""
    ensure_table(spark, path, schema, partition)
    merge_upsert(spark, path, today, schema, keys, partition, now)


# ---- append-only logs --------------------------------------------------------------------
#: Hash buckets of an append-only log: an append reads the ids of the buckets its batch touches, no others.
LOG_BUCKETS = 64
COMMITS = "_commits"


def log_bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(LOG_BUCKETS)).cast("int")


def one_per_id(rows: DataFrame, key: str, order: Sequence[Column] | None = None) -> DataFrame:
    """Equal rows are one retry; different rows under one id: the first by `order`, or an error without one."""
    rows = rows.dropDuplicates(rows.columns)
    if order:
        first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
        return rows.withColumn("_first", first).filter("_first").drop("_first")
    return _unique(rows, [key])


def log_slice(spark: SparkSession, path: str, schema: StructType, key: str, buckets: Sequence[int]) -> DataFrame:
    """Ids of the log in the given buckets only: the files of other buckets are not listed or read."""
    ids = StructType([schema[key]])
    found = [f"{path}/bucket={b}" for b in sorted(buckets) if exists(spark, f"{path}/bucket={b}")]
    return spark.read.schema(ids).parquet(*found) if found else spark.createDataFrame([], ids)


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The log's rows without its bucket column."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def _commit_mark(spark: SparkSession, path: str, batch: str):
    fs, p = _fs(spark, f"{path}/{COMMITS}/{batch}")
    return fs, p


def append_event(
    spark: SparkSession, path: str, rows: DataFrame, schema: StructType, key: str = "event_id",
    order: Sequence[Column] | None = None, batch: str | None = None,
) -> None:
    """Append with id de-duplication, so a retried request adds nothing.

    The batch is reduced to one row per id, its buckets are listed (at most LOG_BUCKETS values), and only
    the id column of those buckets is read for the anti join. With `batch`, a committed batch is recorded
    and a replay of it reads nothing; a crash between append and record is caught by the anti join.
    """
    if batch is not None:
        fs, mark = _commit_mark(spark, path, batch)
        if fs.exists(mark):
            return
    staged = one_per_id(rows.select(*schema.names), key, order).withColumn("bucket", log_bucket(key))
    with _Work(spark, "append") as job:
        work = job.write(staged)
        buckets = [r[0] for r in work.select("bucket").distinct().collect()]
        fresh = work.join(log_slice(spark, path, schema, key, buckets), key, "left_anti")
        fresh.select(*schema.names, "bucket").write.mode("append").partitionBy("bucket").parquet(path)
    if batch is not None:
        fs.create(mark).close()


def tombstones_for(ids: DataFrame, by: Column, at: Column) -> DataFrame:
    return ids.select("event_id").distinct().select("event_id", by.alias("deleted_by"), at.alias("deleted_at"))


def append_tombstones(spark: SparkSession, path: str, ids: DataFrame, by: Column, at: Column, schema: StructType) -> None:
    """Soft delete; deleting the same event again is a no-op."""
    append_event(spark, path, tombstones_for(ids, by, at), schema, "event_id")
