"""The alert board: display rows, filters, counts, sorting and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adloom.functions import labels as L, scalars as S
from adloom.functions.keyed import share_of_max

PAGE_SIZE = 25
SEVERITY_ORDER = ["P0", "P1"]


def normalize_alerts(alerts: DataFrame) -> DataFrame:
    """Blank out what the board cannot show as NULL and add the display label."""
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
             for c in ("alert_type", "severity", "source", "customer_id", "entity_id", "detail")}
    null_if_blank = {c: F.nullif(F.col(c), F.lit("")).alias(c)
                     for c in ("client_name", "tier", "sub_mcc", "av_status", "entity_name")}
    manager = F.coalesce(F.nullif(F.col("account_manager"), F.lit("")), F.lit(L.UNASSIGNED)).alias("account_manager")
    cols = [blank.get(c, null_if_blank.get(c, manager if c == "account_manager" else F.col(c))) for c in L.ALERT_COLUMNS]
    return alerts.select(*cols).withColumn("type_label", S.label_of(F.col("alert_type"), L.ALERT_LABELS))


def _av(col: Column) -> Column:
    return F.lower(F.coalesce(col, F.lit("")))


def av_bucket(col: Column) -> Column:
    av = _av(col)
    return (
        F.when(av == "av approved", F.lit("ok"))
        .when(av.isin("no", "no av"), F.lit("no"))
        .when(av == "in progress", F.lit("prog"))
        .when(av == "stuck", F.lit("stuck"))
        .otherwise(F.lit("na"))
    )


def av_text(col: Column) -> Column:
    bucket = av_bucket(col)
    return (
        F.when(bucket == "ok", F.lit("AV Approved"))
        .when(bucket == "no", F.lit("No AV"))
        .when(bucket == "prog", F.lit("In Progress"))
        .when(bucket == "stuck", F.lit("Stuck"))
        .otherwise(F.coalesce(F.nullif(col, F.lit("")), F.lit("no data")))
    )


def alert_filter(
    alerts: DataFrame,
    severity: str = "all",
    alert_type: str = "all",
    manager: str = "all",
    av: str = "all",
    q: str = "",
) -> DataFrame:
    """Board filters; av is one of all, has, no, other; q searches five columns."""
    for column, wanted in (("severity", severity), ("alert_type", alert_type), ("account_manager", manager)):
        if wanted != "all":
            alerts = alerts.filter(F.col(column) == wanted)
    bucket = av_bucket(F.col("av_status"))
    if av == "has":
        alerts = alerts.filter(bucket == "ok")
    elif av == "no":
        alerts = alerts.filter(bucket == "no")
    elif av == "other":
        alerts = alerts.filter(~bucket.isin("ok", "no"))
    if q:
        fields = ("client_name", "entity_name", "detail", "customer_id", "account_manager")
        hay = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields])
        alerts = alerts.filter(S.contains_any_case(hay, q))
    return alerts


def is_new(detected_at: Column, now: Column) -> Column:
    """Detected within the last 24 hours."""
    return F.coalesce(now - detected_at < F.expr("interval 24 hours"), F.lit(False))


def age_label(detected_at: Column, now: Column) -> Column:
    hours = F.round((F.unix_micros(now) - F.unix_micros(detected_at)) / 3_600_000_000).cast("bigint")
    return (
        F.when(detected_at.isNull(), F.lit(""))
        .when(hours < 1, F.lit("just now"))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )


def alert_metrics(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "P0").alias("p0"),
        F.count_if(F.col("severity") == "P1").alias("p1"),
        F.count_if(av_bucket(F.col("av_status")) == "ok").alias("on_av"),
    )


def alert_by_type(alerts: DataFrame) -> DataFrame:
    """Counts per type (a handful of rows) with the percentage of the largest."""
    counts = alerts.groupBy("alert_type").agg(F.count(F.lit(1)).alias("alerts"))
    return (
        share_of_max(counts, "alerts", "_share")
        .withColumn("pct_of_max", F.round(F.col("_share") * 100).cast("int"))
        .withColumn("type_label", S.label_of(F.col("alert_type"), L.ALERT_LABELS))
        .drop("_share")
        .orderBy(F.desc("alerts"), "alert_type")
    )


def alert_by_manager(alerts: DataFrame, k: int = 15) -> DataFrame:
    """Managers with most alerts; the top-k is the report."""
    return (
        alerts.groupBy("account_manager")
        .agg(F.count(F.lit(1)).alias("alerts"), F.bool_or(F.col("severity") == "P0").alias("has_p0"))
        .orderBy(F.desc("alerts"), "account_manager")
        .limit(k)
    )


def feed_order(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("severity", "alert_type", F.asc_nulls_first("client_name"))


def board_order(alerts: DataFrame) -> list[Column]:
    """Urgent first, then newest; ids only break ties."""
    return [
        S.rank_in(F.col("severity"), SEVERITY_ORDER, missing=9).asc(),
        F.desc("detected_at"),
        F.asc("alert_type"),
        F.asc("customer_id"),
        F.asc("entity_id"),
        F.asc("detail"),
    ]


def page(df: DataFrame, order: list[Column], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the sorted result; Spark plans it as a distributed top-k, not a full sort."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
