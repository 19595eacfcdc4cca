"""Committed budgets: append-only edit log over a base sheet, year matrix and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adloom.functions import labels as L, scalars as S
from adloom.functions.keyed import latest_per_key

CELL = ["client", "channel", "year", "month"]
MONTHS = list(range(1, 13))
MONTH_COLUMNS = [f"m{m}" for m in MONTHS]
HISTORY_COLUMNS = [
    "event_id", "client", "channel", "year", "month", "amount", "alloc_type",
    "event_type", "changed_by", "changed_at", "note",
]


# ---- the edit log ---------------------------------------------------------------------
def live_events(events: DataFrame, tombstones: DataFrame) -> DataFrame:
    return events.join(tombstones.select("event_id"), "event_id", "left_anti")


def latest_budget_event(events: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Newest surviving edit per cell; a withdrawn edit uncovers the one before it."""
    return latest_per_key(
        live_events(events, tombstones), CELL, [F.desc("changed_at"), F.desc("event_id")]
    )


def budget_base_current(events: DataFrame, tombstones: DataFrame, sheet: DataFrame) -> DataFrame:
    """Latest edit, else the sheet, with the origin of each amount.

    A 'delete' edit counts with its own amount, like any other edit.
    """
    edits = latest_budget_event(events, tombstones).select(*CELL, F.col("amount").alias("event_amount"))
    base = sheet.groupBy(*CELL).agg(F.sum("amount").alias("sheet_amount"))
    return edits.join(base, CELL, "full").select(
        *CELL,
        F.coalesce("event_amount", "sheet_amount").alias("base_amount"),
        F.when(F.col("event_amount").isNotNull(), F.lit("event")).otherwise(F.lit("sheet")).alias("source"),
    )


def source_mix(base: DataFrame) -> DataFrame:
    return base.groupBy("source").agg(
        F.count_distinct("client").alias("clients"), F.count(F.lit(1)).alias("rows")
    )


def history_limit(limit: object, default: int = 200, ceiling: int = 1000) -> int:
    try:
        n = int(limit)
    except (TypeError, ValueError):
        return default
    return default if n < 1 else min(n, ceiling)


def event_history(events: DataFrame, tombstones: DataFrame, limit: object = 200) -> DataFrame:
    """Newest surviving edits first; the limit is the page size of the log view."""
    live = live_events(events, tombstones).select(*HISTORY_COLUMNS)
    return live.orderBy(F.desc("changed_at"), F.desc("event_id")).limit(history_limit(limit))


def event_filter(
    df: DataFrame, channel: str | None = None, user: str | None = None, q: str | None = None
) -> DataFrame:
    if channel:
        df = df.filter(F.col("channel") == channel)
    if user:
        df = df.filter(F.col("changed_by") == user)
    if q:
        text = [S.contains_any_case(F.coalesce(c, F.lit("")), q) for c in ("client", "note")]
        df = df.filter(text[0] | text[1])
    return df


def expand_month_range(rows: DataFrame, first: str = "month_from", last: str = "month_to") -> DataFrame:
    """One create event per month of the range; reversed or out-of-year ranges are invalid."""
    valid = (F.col(first) >= 1) & (F.col(last) <= 12) & (F.col(first) <= F.col(last))
    return (
        rows.filter(valid)
        .withColumn("month", F.explode(F.sequence(F.col(first).cast("int"), F.col(last).cast("int"))))
        .withColumn("event_type", F.lit("create"))
        .drop(first, last)
    )


def large_change(current: Column, new: Column) -> Column:
    """Zeroing out, or moving by more than half, asks for a second look."""
    moved = F.abs(new - current).cast("double") / F.nullif(current.cast("double"), F.lit(0.0))
    return F.coalesce((current > 0) & ((new == 0) | (moved > 0.5)), F.lit(False))


# ---- validation -----------------------------------------------------------------------
def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def _not_whole(name: str, low: int, high: int) -> Column:
    number = S.number(F.col(name))
    return F.coalesce((number != F.floor(number)) | (number < low) | (number > high), F.lit(True))


def validate_event(df: DataFrame) -> DataFrame:
    """First problem of each event as `error`; NULL means it may be appended."""
    error = F.when(_blank("client"), F.lit(L.EVENT_CLIENT_REQUIRED))
    for name in ("channel", "event_type"):
        error = error.when(_blank(name), F.lit(f"{name} is required"))
    error = (
        error.when(_not_whole("year", 2020, 2100), F.lit(L.EVENT_YEAR_INVALID))
        .when(_not_whole("month", 1, 12), F.lit(L.EVENT_MONTH_INVALID))
        .when(S.number(F.col("amount")).isNull(), F.lit(L.EVENT_AMOUNT_INVALID))
        .when(
            ~F.col("event_type").isin(L.EVENT_TYPES),
            F.lit("event_type must be one of " + ", ".join(L.EVENT_TYPES)),
        )
    )
    return df.withColumn("error", error)


EDIT_SCHEMA = ("event_id string, client string, channel string, year int, month int, amount decimal(38,9), alloc_type string, "
               "event_type string, changed_by string, changed_at timestamp, note string")


def record_edits(path: str, edits: DataFrame, editor: Column, now: Column, batch: str | None = None) -> DataFrame:
    """Budget edits as one write: validate, trim and type, stamp editor and time on the server side (any
    changed_by or changed_at of the request is ignored), and append the valid rows to the append-only log at
    `path` with id de-duplication (a retried request adds nothing; a committed `batch` is skipped). Returns the
    rejected rows: event_id and error."""
    from pyspark.sql.types import StructType

    from adloom.sinks import tables as T

    checked = T.materialize(validate_event(edits), "budget-edits")
    shaped = checked.where(F.col("error").isNull()).select(
        F.col("event_id").cast("string").alias("event_id"), F.trim(F.col("client").cast("string")).alias("client"),
        F.trim(F.col("channel").cast("string")).alias("channel"), S.number(F.col("year")).cast("int").alias("year"),
        S.number(F.col("month")).cast("int").alias("month"), S.number(F.col("amount")).cast("decimal(38,9)").alias("amount"),
        (F.col("alloc_type") if "alloc_type" in edits.columns else F.lit(None)).cast("string").alias("alloc_type"),
        F.col("event_type").cast("string").alias("event_type"), editor.cast("string").alias("changed_by"),
        now.cast("timestamp").alias("changed_at"),
        (F.col("note") if "note" in edits.columns else F.lit(None)).cast("string").alias("note"))
    T.append_event(edits.sparkSession, path, shaped, StructType.fromDDL(EDIT_SCHEMA), "event_id", batch=batch)
    return checked.where(F.col("error").isNotNull()).select("event_id", "error")


def validate_tombstones(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Malformed ids, batches above the size limit, and rows without a batch carry an error."""
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_size"))
    error = F.when(F.col(batch).isNull(), F.lit("Missing batch id")).when(
        F.col("_size") > L.MAX_TOMBSTONES_PER_BATCH, F.lit(f"Max {L.MAX_TOMBSTONES_PER_BATCH} events per delete")
    ).when(~F.coalesce(F.col("event_id").rlike(L.UUID_PATTERN), F.lit(False)), F.lit(L.TOMBSTONE_ID_INVALID))
    return df.join(sizes, batch, "left").withColumn("error", error).drop("_size")


# ---- the year matrix ------------------------------------------------------------------
def budget_matrix(base: DataFrame, year: int) -> DataFrame:
    """client x channel rows, m1..m12 and the row total.

    Conditional sums instead of pivot: one map-side-combined aggregation, no wide expand.
    """
    in_year = base.filter((F.col("year") == year) & F.col("month").between(1, 12))
    zero = F.lit(0).cast("decimal(12,2)")
    return in_year.groupBy("client", "channel").agg(
        *[F.sum(F.when(F.col("month") == m, F.col("base_amount")).otherwise(zero)).alias(f"m{m}") for m in MONTHS],
        F.sum("base_amount").alias("row_total"),
    )


def budget_summary(matrix: DataFrame) -> DataFrame:
    total = F.coalesce(F.round(F.sum("row_total"), 2).cast("double"), F.lit(0.0))
    return matrix.agg(
        F.count_distinct("client").alias("clients"),
        F.count(F.lit(1)).alias("lines"),
        total.alias("total_committed"),
        (total / 12).alias("monthly_average"),
    )


def budget_filter(matrix: DataFrame, channel: str | None = None, q: str | None = None) -> DataFrame:
    if channel and channel != "all":
        matrix = matrix.filter(F.col("channel") == channel)
    if q:
        matrix = matrix.filter(S.contains_any_case(F.col("client"), q))
    return matrix


def client_totals(matrix: DataFrame) -> DataFrame:
    return (
        matrix.groupBy("client")
        .agg(*[F.sum(c).alias(c) for c in [*MONTH_COLUMNS, "row_total"]])
        .withColumn("channel", F.lit("__total__"))
        .orderBy("client")
    )


def view_totals(matrix: DataFrame) -> DataFrame:
    """Lines and committed total of whatever is in view."""
    return matrix.agg(
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.sum("row_total").cast("double"), F.lit(0.0)).alias("committed"),
    )


def sort_by(df: DataFrame, column: str | None = None, descending: bool = False) -> DataFrame:
    """Any column, either direction; missing numbers sort as zero."""
    if column is None:
        return df.orderBy("client", "channel")
    key = F.col(column)
    if df.schema[column].dataType.typeName() != "string":
        key = F.coalesce(key, F.lit(0))
    return df.orderBy(key.desc() if descending else key.asc(), "client", "channel")
