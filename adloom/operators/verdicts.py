"""Rule evaluation: sufficiency, conditions, warnings, trust and the account roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pyspark.sql.types import ArrayType, DataType, StructType

from adloom.functions import scalars as S

# ---- fixed values: funnel stages in order ----------------------------------------------
STAGES = ["eligible", "visible", "compelling", "relevant", "converting", "answered", "verified"]
VOIDED_BY_TRACKING = ["converting", "answered", "verified"]
KEYS = ["account_id", "campaign_type"]


def long_metrics(wide: DataFrame, metrics: Sequence[str]) -> DataFrame:
    typed = wide.select(*KEYS, *[F.col(m).cast("double").alias(m) for m in metrics])
    return typed.unpivot(KEYS, list(metrics), "metric", "value")


def holds(op: Column, value: Column, low: Column, high: Column) -> Column:
    return (
        F.when(op == "gt", value > low)
        .when(op == "gte", value >= low)
        .when(op == "lt", value < low)
        .when(op == "lte", value <= low)
        .when(op == "eq", value == low)
        .when(op == "neq", value != low)
        .when(op == "between", value.between(low, high))
    )


def near(op: Column, value: Column, low: Column, pct: Column) -> Column:
    """Not failing yet, but within pct of the fail line."""
    distance = S.ratio(F.abs(value - low), F.abs(low))
    return F.coalesce(op.isin("gt", "gte", "lt", "lte") & (distance <= pct), F.lit(False))


#: Largest rule registry (rules and their conditions) that is carried to every account row.
MAX_REGISTRY_ROWS = 100_000


def _literal(value, kind: DataType) -> Column:
    """A typed literal of nested rows and arrays."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind) if value else F.array().cast(kind)
    return F.lit(value).cast(kind)


def _all_any(flags: Column) -> tuple[Column, Column]:
    """bool_and and bool_or of an array, ignoring nulls; null when every element is null."""
    known = F.filter(flags, lambda x: x.isNotNull())
    empty = F.size(known) == 0
    return (F.when(empty, F.lit(None)).otherwise(F.forall(known, lambda x: x)),
            F.when(empty, F.lit(None)).otherwise(F.exists(known, lambda x: x)))


def evaluate_rules(
    metrics: DataFrame, rules: DataFrame, conditions: DataFrame, overrides: DataFrame | None = None
) -> DataFrame:
    """Verdict per account, campaign type and rule.

    metrics: account_id, campaign_type, metric, value
    rules: rule_id, stage, match, warn_pct, floor_metric, floor_value
    conditions: rule_id, metric, operator, threshold, threshold_high
    overrides: account_id, rule_id, metric, threshold - replace a threshold for one account

    A floor that is not met, a missing metric, or a rule without conditions means cant_assess. Conditions
    describe failure; a rule that does not fail but is close on every (match all) or any condition warns.

    Each account becomes one row with a map of its metrics (and one of its overrides); the registry, a table
    kept by hand whose size does not follow the accounts, is checked against MAX_REGISTRY_ROWS and carried as
    one literal array of rules with their conditions. Higher-order functions evaluate every rule against the
    maps, so the only rows made are the verdicts, one per account and rule; none per account and condition.
    """
    spark = metrics.sparkSession
    n_registry = rules.count() + conditions.count()
    if n_registry > MAX_REGISTRY_ROWS:
        raise ValueError(f"rule registry of {n_registry} rows is over MAX_REGISTRY_ROWS={MAX_REGISTRY_ROWS}")
    cond_fields = ["metric", "operator", "threshold", "threshold_high"]
    per_rule = rules.join(conditions.select("rule_id", F.struct(*cond_fields).alias("_c")), "rule_id", "left").groupBy(
        "rule_id", "stage", "match", "warn_pct", "floor_metric", "floor_value"
    ).agg(F.filter(F.collect_list("_c"), lambda c: c.isNotNull()).alias("conditions"))
    registry = per_rule.collect()  # bounded by the check above
    typed = per_rule.schema
    literal = F.array(*[_literal(r, StructType(typed.fields)) for r in registry])

    accounts = metrics.groupBy(*KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.col("value").cast("double")))).alias("_m"))
    if overrides is not None:
        own = overrides.groupBy("account_id").agg(F.map_from_entries(F.collect_list(F.struct(
            F.concat_ws("\u0000", F.col("rule_id").cast("string"), F.col("metric")), F.col("threshold").cast("double")))).alias("_own"))
        accounts = accounts.join(own, "account_id", "left")
    else:
        accounts = accounts.withColumn("_own", F.lit(None).cast("map<string,double>"))

    def verdict(r: Column) -> Column:
        def check(c: Column) -> Column:
            value = F.element_at(F.col("_m"), c["metric"])
            key = F.concat_ws("\u0000", r["rule_id"].cast("string"), c["metric"])
            low = F.coalesce(F.element_at(F.col("_own"), key), c["threshold"])
            fail = holds(c["operator"], value, low, c["threshold_high"])
            close = F.coalesce(fail, F.lit(False)) | near(c["operator"], value, low, r["warn_pct"])
            return F.struct(value.isNull().alias("missing"), fail.alias("fail"), close.alias("near"))

        checked = F.transform(r["conditions"], check)
        all_fail, any_fail = _all_any(F.transform(checked, lambda x: x["fail"]))
        all_near, any_near = _all_any(F.transform(checked, lambda x: x["near"]))
        missing = F.exists(checked, lambda x: x["missing"]) | (F.size(r["conditions"]) == 0)
        floor = F.element_at(F.col("_m"), r["floor_metric"])
        thin = r["floor_metric"].isNotNull() & (F.coalesce(floor, F.lit(0.0)) < r["floor_value"])
        all_of = r["match"] == "all"
        fails = F.when(all_of, all_fail).otherwise(any_fail)
        close = F.when(all_of, all_near).otherwise(any_near)
        word = (F.when(thin | missing, F.lit("cant_assess")).when(fails, F.lit("fail")).when(close, F.lit("warn"))
                .otherwise(F.lit("pass")))
        return F.struct(r["rule_id"].alias("rule_id"), r["stage"].alias("stage"), word.alias("verdict"))

    if not registry:
        return spark.createDataFrame([], f"account_id string, campaign_type string, rule_id {typed['rule_id'].dataType.simpleString()}, "
                                         f"stage string, verdict string")
    out = accounts.select(*KEYS, F.inline(F.transform(literal, verdict)))
    return out.select(*KEYS, "rule_id", "stage", "verdict")


def trust_void(verdicts: DataFrame, stage: str = "eligible", voided: Sequence[str] = VOIDED_BY_TRACKING) -> DataFrame:
    """Doubtful tracking makes the downstream stages impossible to assess.

    Rows here are one account's verdicts, a few per stage, so the window stays small.
    """
    doubt = F.max(F.when((F.col("stage") == stage) & F.col("verdict").isin("warn", "fail"), 1).otherwise(0)).over(
        Window.partitionBy(*KEYS)
    )
    out = verdicts.withColumn("_doubt", doubt == 1)
    hit = F.col("_doubt") & F.col("stage").isin(list(voided))
    return (
        out.withColumn("verdict", F.when(hit, F.lit("cant_assess")).otherwise(F.col("verdict")))
        .withColumn("voided_by", F.when(hit, F.lit("tracking")))
        .drop("_doubt")
    )


def account_state(verdicts: DataFrame, unassessed: str = "unknown") -> DataFrame:
    """First failing stage, its family, and whether the account performs; an account of which nothing could
    be assessed is `unassessed` in both."""
    order = S.rank_in(F.col("stage"), STAGES)
    failing = F.col("verdict") == "fail"
    out = verdicts.groupBy("account_id").agg(
        F.min(F.when(failing, order)).alias("_first"),
        F.bool_and(F.col("verdict") == "cant_assess").alias("_blind"),
        F.bool_or((F.col("stage") == "eligible") & F.col("verdict").isin("warn", "fail")).alias("_doubt"),
        F.bool_or(failing & (F.col("stage") == "visible")).alias("_volume"),
        F.bool_or(failing & ~F.col("stage").isin("visible", "eligible")).alias("_efficiency"),
    )
    family = (
        F.when(F.col("_blind"), F.lit(unassessed))
        .when(F.col("_doubt"), F.lit("trust_issue"))
        .when(F.col("_efficiency"), F.lit("efficiency_fail"))
        .when(F.col("_volume"), F.lit("volume_fail_upsell"))
        .otherwise(F.lit("healthy"))
    )
    stages = F.array(*[F.lit(s) for s in STAGES])
    return out.select(
        "account_id",
        F.when(F.col("_blind"), F.lit(unassessed)).when(F.col("_doubt"), F.lit("unknown")).when(F.col("_first").isNotNull(), F.lit("no")).otherwise(F.lit("yes"))
        .alias("performing"),
        family.alias("verdict_family"),
        F.get(stages, F.col("_first")).alias("first_failing_stage"),
    )
