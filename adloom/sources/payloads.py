"""Payloads that arrive in several wrappings, and nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TRIAGE_SCHEMA = (
    "summary struct<snapshot_date:string,total:bigint,critical:bigint,at_risk:bigint,low_volume:bigint,ok:bigint,"
    "total_cost_7d:double>, "
    "items array<struct<client_name:string,account_manager:string,tier:string,biz_type:string,campaign_name:string,"
    "cost:double,conv:double,clicks:bigint,cpa:double,bench:double,search_is:double,budget_lost_is:double,"
    "conv_delta:double,cpa_delta_pct:double,status:string,reason:string,streak:int,dir:string,"
    "cpa_history:array<double>,conv_history:array<double>,status_history:array<string>,"
    "account_calls_7d:bigint,account_missed_7d:bigint>>"
)


def normalize_payload(raw: Column) -> Column:
    """Text of the inner object, whatever wraps it: an array of one, a `json` member holding an
    object or its text, or the object itself stored as a JSON string."""

    def unquote(col: Column) -> Column:
        # a JSON string literal is read back by placing it in a one-element array
        quoted = F.startswith(F.trim(col), F.lit('"'))
        return F.when(quoted, F.get(F.from_json(F.concat(F.lit("["), col, F.lit("]")), "array<string>"), F.lit(0))).otherwise(col)

    def first_of(col: Column) -> Column:
        return F.when(F.startswith(F.trim(col), F.lit("[")), F.get_json_object(col, "$[0]")).otherwise(col)

    body = unquote(first_of(unquote(raw)))
    inner = F.get_json_object(body, "$.json")
    return unquote(F.coalesce(inner, body))


def payload_items(df: DataFrame, raw: str, item_schema: str) -> DataFrame:
    """One row per element of the payload's `items`."""
    parsed = F.from_json(normalize_payload(F.col(raw)), f"items array<struct<{item_schema}>>")
    keep = [c for c in df.columns if c != raw]
    return df.select(*keep, F.inline(parsed["items"]))


def read_triage_items(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Items of landed triage documents; -1 in a history means no conversions.

    One pretty-printed document per file is read whole by one task; land one document per line
    (multi_line=False) when there is more than a page of them.
    """
    doc = spark.read.schema(TRIAGE_SCHEMA).option("multiLine", multi_line).json(path)
    return doc.select(F.inline("items")).withColumn(
        "cpa_history", F.transform("cpa_history", lambda v: F.when(v >= 0, v))
    )
