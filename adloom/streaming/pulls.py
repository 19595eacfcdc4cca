"""Range re-statement as a stream of pulls.

A puller re-reads a declared date range and lands its rows as files, then a manifest row: pull_id, since,
until, n_files (the files it landed) and pulled_at. Files of one pull may arrive over several micro-batches and
several pulls in one; a pull counts only once all its files and its manifest are in.

Two streaming queries, each with its own checkpoint:

* `stage_files`: the file stream of pull rows is written, per micro-batch, to a staging table partitioned by
  pull and file (dynamic overwrite, so a replayed batch rewrites the same partitions), and only then one marker
  per file is written. A marker therefore proves that the rows of its file are staged.
* `apply_pulls`: markers and manifests, keyed by pull_id, go through per-pull state that holds only the set of
  file keys seen and the manifest; the state emits a pull once, when it is complete. Each micro-batch of
  complete pulls replaces days: of all complete pulls that declare a day, the newest (pulled_at, then pull_id)
  owns it, including pulls applied in earlier batches (kept in a small per-day version table). Owned days get
  exactly the rows of their pull, read from staging pruned to those pulls; a declared day without rows is
  emptied. A pull older than the one that owns a day changes nothing there.

The state sees one row per landed file, never the data rows; the data stays in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from adloom.sinks import tables as T

MANIFEST = "pull_id long, since date, until date, n_files long, pulled_at timestamp"
MARKER = "pull_id long, file_key long"
EVENT = "pull_id long, file_key long, since date, until date, n_files long, pulled_at timestamp, is_manifest boolean"
DONE = "pull_id long, since date, until date, pulled_at timestamp"
STATE = "files array<long>, since date, until date, n_files long, pulled_at timestamp, emitted boolean"
VERSIONS = "_versions"
#: Bytes of a landed file that one task stages, about.
PIECE = 16 << 20


def stage_files(stream: DataFrame, staging: str, markers: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Stage every landed file's rows, then mark the file; `stream` is a file stream with a pull_id column."""
    pieces = F.ceil(F.col("_metadata.file_size") / F.lit(PIECE))  # a large file is staged by several tasks
    piece = F.pmod(F.xxhash64(*[F.col(c) for c in stream.columns]), F.greatest(pieces, F.lit(1)))
    keyed = stream.withColumns({"file_key": F.xxhash64(F.col("_metadata.file_path")), "_piece": piece})

    def write(batch: DataFrame, batch_id: int) -> None:
        # written as it comes first, so that the rows are dealt by measured size: no task sorts a whole large file
        rows = T.materialize(batch, "pull-stage")
        with T.adaptive(rows.sparkSession):
            (rows.hint("rebalance", F.col("pull_id"), F.col("file_key"), F.col("_piece")).drop("_piece").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("pull_id", "file_key").parquet(staging))
        (rows.select("pull_id", "file_key").distinct().write.mode("overwrite")
         .parquet(f"{markers}/batch={batch_id}"))

    return (keyed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _complete(key: tuple, events: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hold a pull's file keys and manifest; emit the pull once, when both are whole."""
    if state.exists:
        files, since, until, n_files, pulled_at, emitted = state.get
        files = set(files)
    else:
        files, since, until, n_files, pulled_at, emitted = set(), None, None, None, None, False
    for chunk in events:
        files.update(int(k) for k in chunk.loc[~chunk.is_manifest, "file_key"])
        head = chunk[chunk.is_manifest]
        if len(head):
            row = head.iloc[-1]
            since, until, n_files, pulled_at = row.since, row.until, int(row.n_files), row.pulled_at
    if emitted:
        return
    if n_files is not None and len(files) >= n_files:
        state.update(([], since, until, n_files, pulled_at, True))
        yield pd.DataFrame({"pull_id": [key[0]], "since": [since], "until": [until], "pulled_at": [pulled_at]})
    else:
        state.update((sorted(files), since, until, n_files, pulled_at, False))


def owned_days(done: DataFrame, versions: DataFrame) -> DataFrame:
    """day, pull_id, pulled_at of the days that the newly complete pulls now own."""
    days = done.select("pull_id", "pulled_at", F.explode(F.sequence("since", "until")).alias("day"))
    old = versions.select("day", "pull_id", "pulled_at", F.lit(True).alias("_old"))
    both = days.withColumn("_old", F.lit(False)).unionByName(old)
    rank = Window.partitionBy("day").orderBy(F.desc("pulled_at"), F.desc("pull_id"), F.asc("_old"))
    top = both.withColumn("_r", F.row_number().over(rank)).where("_r = 1")
    return top.where(~F.col("_old")).select("day", "pull_id", "pulled_at")


def apply_pulls(
    markers: DataFrame, manifests: DataFrame, staging: str, path: str, schema: StructType, date_col: str,
    checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Replace the days owned by pulls as they become complete."""
    events = markers.select("pull_id", "file_key", *[F.lit(None).cast(t).alias(c) for c, t in
                            (("since", "date"), ("until", "date"), ("n_files", "long"), ("pulled_at", "timestamp"))],
                            F.lit(False).alias("is_manifest"))
    events = events.unionByName(manifests.select("pull_id", F.lit(None).cast("long").alias("file_key"), "since", "until",
                                                 "n_files", "pulled_at", F.lit(True).alias("is_manifest")))
    complete = events.groupBy("pull_id").applyInPandasWithState(_complete, DONE, STATE, "append", GroupStateTimeout.NoTimeout)

    def write(done: DataFrame, batch_id: int) -> None:
        spark = done.sparkSession
        pulls = [r.pull_id for r in done.select("pull_id").collect()]  # one row per complete pull of the batch
        if not pulls:
            return
        vpath = f"{path}/{VERSIONS}"
        versions = (spark.read.parquet(vpath) if T.exists(spark, vpath)
                    else spark.createDataFrame([], "day date, pull_id long, pulled_at timestamp"))
        owned = T.materialize(owned_days(done, versions), "pull-days")
        staged = _staged(spark, staging, schema, pulls)
        rows = staged.join(owned.select(F.col("day").alias(date_col), "pull_id"), [date_col, "pull_id"], "left_semi")
        days = [r.day for r in owned.select("day").collect()]  # days of the declared ranges: bounded by the calendar
        filled = T.materialize(rows.select(*schema.names), "pull-rows")
        if not filled.isEmpty():
            T._write_partitions(filled, path, date_col)
        present = {str(r[0]) for r in filled.select(date_col).distinct().collect()}
        for day in days:
            if str(day) not in present:
                T._drop_partition(spark, path, date_col, str(day))
        merged = versions.join(owned.select("day"), "day", "left_anti").unionByName(owned)
        T.materialize(merged, "pull-versions").write.mode("overwrite").parquet(vpath)

    return (complete.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _staged(spark: SparkSession, staging: str, schema: StructType, pulls: list[int]) -> DataFrame:
    """Staged rows of the given pulls only (partition pruning by a literal list)."""
    cols = [*schema.names, "pull_id"]
    return spark.read.option("basePath", staging).parquet(staging).where(F.col("pull_id").isin(pulls)).select(*cols)
