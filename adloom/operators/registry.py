"""Versioned registries: account standards, strategy cards and evaluation rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adloom.functions import labels as L, scalars as S
from adloom.functions.keyed import latest_per_key, sequence_in_time


def current_versions(log: DataFrame, key: str, created: str = "created_at", tie: str | None = None) -> DataFrame:
    """Newest version per item, then only the active ones: a deactivated newest version hides
    the item instead of falling back to an older one."""
    order = [F.desc(created)] + ([F.desc(tie)] if tie else [])
    return latest_per_key(log, [key], order).filter("active")


def version_history(log: DataFrame, key: str, value: str, created: str = "created_at") -> DataFrame:
    return log.filter(F.col(key) == value).orderBy(F.desc(created))


def numbered_versions(log: DataFrame, key: str, created: str = "created_at", tie: str = "order_key") -> DataFrame:
    """Every version of every entry: version_no from 1 (oldest, ties by `tie`), n_versions, is_current (newest).

    Numbering runs per (entry, hour) with the count of earlier hours added, so an entry with very many
    versions is never one task; the history of one entry is this table filtered to its key.
    """
    numbered = sequence_in_time(log, [key], created, tie, number="version_no", previous="_prior")
    counts = log.groupBy(key).agg(F.count(F.lit(1)).alias("n_versions"))
    return numbered.drop("_prior").join(counts, key).withColumn("is_current", F.col("version_no") == F.col("n_versions"))


def _search(df: DataFrame, columns: Sequence[str], q: str | None) -> DataFrame:
    if not q:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | S.contains_any_case(F.coalesce(F.col(c), F.lit("")), q)
    return df.filter(hit)


def _equal(df: DataFrame, **wanted: object) -> DataFrame:
    for column, value in wanted.items():
        if value not in (None, ""):
            df = df.filter(F.col(column) == value)
    return df


def filter_standards(
    df: DataFrame, categories: Sequence[str] | None = None, status: str | None = None,
    level: str | None = None, q: str | None = None,
) -> DataFrame:
    if categories is not None:
        df = df.filter(F.col("category").isin(list(categories)))
    return _search(_equal(df, status=status, level=level), ["item", "position", "exception"], q)


def filter_cards(
    df: DataFrame, pillars: Sequence[str] | None = None, status: str | None = None,
    scope: str | None = None, q: str | None = None,
) -> DataFrame:
    if pillars is not None:
        df = df.filter(F.col("pillar").isin(list(pillars)))
    return _search(_equal(df, status=status, applies_to=scope), ["title", "body"], q)


def filter_rules(
    df: DataFrame, levels: Sequence[str] | None = None, status_id: int | None = None,
    campaign_type: str | None = None, q: str | None = None,
) -> DataFrame:
    """The search also looks into the metric names of the nested conditions."""
    if levels is not None:
        df = df.filter(F.col("level").isin(list(levels)))
    df = _equal(df, status_id=status_id, campaign_type=campaign_type)
    if not q:
        return df
    text = S.contains_any_case(F.coalesce("condition_text", F.lit("")), q)
    text = text | S.contains_any_case(F.coalesce("exception_text", F.lit("")), q)
    metric = F.exists("conditions", lambda c: F.contains(F.lower(F.coalesce(c["metric"], F.lit(""))), F.lit(q.lower())))
    return df.filter(text | metric)


def order_standards(df: DataFrame) -> DataFrame:
    return df.orderBy(
        S.rank_in(F.col("category"), L.STANDARD_CATEGORIES, L.UNRANKED), F.coalesce("sort_order", F.lit(0)), "item"
    )


def order_cards(df: DataFrame) -> DataFrame:
    return df.orderBy(S.rank_in(F.col("pillar"), L.STRATEGY_PILLARS, L.UNRANKED), "title")


def order_rules(df: DataFrame) -> DataFrame:
    return df.orderBy(S.rank_in(F.col("level"), L.RULE_LEVELS, L.UNRANKED), "status_rank", "condition_text")


def cards_feed(df: DataFrame) -> DataFrame:
    return df.orderBy("pillar", F.asc_nulls_first("topic"), "title")


def registry_summary(df: DataFrame) -> DataFrame:
    """Everything that is not pending counts as confirmed."""
    pending = F.count_if(F.col("status") == "pending")
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), (total - pending).alias("confirmed"), pending.alias("pending"))


def rule_summary(rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """Rules with at least one condition can be computed; counted without nesting them."""
    backed = conditions.select(F.col("rule_id").alias("id")).distinct().withColumn("_backed", F.lit(True))
    computable = F.count("_backed")
    total = F.count(F.lit(1))
    return rules.join(backed, "id", "left").agg(
        total.alias("total"), computable.alias("computable"), (total - computable).alias("text_only")
    )


CONDITION_FIELDS = ["position", "id", "metric", "operator", "threshold", "threshold_high", "unit", "window_days"]


def rule_registry(rules: DataFrame, statuses: DataFrame, conditions: DataFrame) -> DataFrame:
    """Rules with their status and ordered conditions (a rule holds a handful of them)."""
    nested = conditions.groupBy(F.col("rule_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(*CONDITION_FIELDS))).alias("conditions")
    )
    labels = statuses.select(
        F.col("id").alias("status_id"),
        F.col("label").alias("status_label"),
        F.col("color").alias("status_color"),
        F.col("rank").alias("status_rank"),
    )
    empty = F.array().cast(nested.schema["conditions"].dataType)
    return (
        rules.join(labels, "status_id")
        .join(nested, "id", "left")
        .withColumn("conditions", F.coalesce("conditions", empty))
    )


# ---- validation ---------------------------------------------------------------------------
def _missing(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (F.coalesce(F.col(n).cast("string"), F.lit("")) == "")
    return out


def _outside(col: Column, allowed: Sequence[str]) -> Column:
    return ~F.coalesce(col.isin(list(allowed)), F.lit(False))


def validate_rule(df: DataFrame) -> DataFrame:
    """First problem of each rule edit as `error`."""
    c = F.col("conditions")
    no_metric = F.exists(c, lambda x: F.trim(F.coalesce(x["metric"], F.lit(""))) == "")
    bad_operator = F.exists(c, lambda x: _outside(x["operator"], L.RULE_OPERATORS))
    half_between = F.exists(
        c, lambda x: (x["operator"] == "between") & (x["threshold"].isNull() | x["threshold_high"].isNull())
    )
    error = (
        F.when(_outside(F.col("level"), L.RULE_LEVELS), F.lit("level must be one of " + ", ".join(L.RULE_LEVELS)))
        .when(_missing("status_id"), F.lit(L.RULE_STATUS_REQUIRED))
        .when(F.trim(F.coalesce("condition_text", F.lit(""))) == "", F.lit(L.RULE_TEXT_REQUIRED))
        .when(
            (F.coalesce("match", F.lit("")) != "") & _outside(F.col("match"), L.RULE_MATCHES),
            F.lit("match must be one of " + ", ".join(L.RULE_MATCHES)),
        )
        .when(no_metric, F.lit(L.RULE_METRIC_REQUIRED))
        .when(bad_operator, F.lit("condition operator must be one of " + ", ".join(L.RULE_OPERATORS)))
        .when(half_between, F.lit(L.RULE_BETWEEN_HALF))
    )
    return df.withColumn("error", error)


def validate_standard(df: DataFrame) -> DataFrame:
    error = (
        F.when(_missing("item_id", "category", "level", "item"), F.lit(L.STANDARD_FIELDS_REQUIRED))
        .when(_outside(F.col("status"), L.STANDARD_STATUSES), F.lit(L.STANDARD_STATUS_INVALID))
        .when(_outside(F.col("level"), L.STANDARD_LEVELS), F.lit("invalid level."))
    )
    return df.withColumn("error", error)


def validate_card(df: DataFrame) -> DataFrame:
    missing = _missing("card_id", "pillar", "title", "status")
    return df.withColumn("error", F.when(missing, F.lit(L.CARD_FIELDS_REQUIRED)))
