"""Weekly campaign triage against a benchmark by business type.

Order and cut-offs are inferred from sample output, so all of them are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F


@dataclass(frozen=True)
class Cutoffs:
    cost_without_conversion: float = 200.0
    enough_clicks: int = 15
    critical_ratio: float = 1.6
    risk_ratio: float = 1.25
    conversion_drop: float = 0.5


def campaign_triage(stats: DataFrame, cut: Cutoffs = Cutoffs()) -> DataFrame:
    """stats: cost, conv, clicks, bench, prev_conv (NULL without history)."""
    cost, conv, clicks = F.col("cost"), F.col("conv"), F.col("clicks")
    cpa = F.when(conv > 0, cost / conv)
    ratio = F.coalesce(cpa / F.nullif(F.col("bench"), F.lit(0.0)), F.lit(0.0))
    dropped = F.coalesce(
        (F.col("prev_conv") > 0) & ((F.col("prev_conv") - conv) / F.nullif(F.col("prev_conv"), F.lit(0.0)) > cut.conversion_drop),
        F.lit(False),
    )
    rules = [
        ((conv == 0) & (cost >= cut.cost_without_conversion), "Critical", "Spend without conversions"),
        ((clicks >= cut.enough_clicks) & (ratio >= cut.critical_ratio), "Critical", "CPA far above portfolio benchmark"),
        (dropped, "At Risk", "Conversions dropped week over week"),
        (clicks < cut.enough_clicks, "Low Volume", "Too few clicks to judge"),
        (ratio >= cut.risk_ratio, "At Risk", "CPA above portfolio benchmark"),
    ]
    status = F.when(rules[0][0], F.lit(rules[0][1]))
    reason = F.when(rules[0][0], F.lit(rules[0][2]))
    for condition, s, r in rules[1:]:
        status, reason = status.when(condition, F.lit(s)), reason.when(condition, F.lit(r))
    return stats.select(
        "*", cpa.alias("cpa"), status.otherwise(F.lit("OK")).alias("status"),
        reason.otherwise(F.lit("Within benchmark")).alias("reason"),
    )


def triage_summary(items: DataFrame, cost: str = "cost") -> DataFrame:
    status = F.col("status")
    return items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "Critical").alias("critical"),
        F.count_if(status == "At Risk").alias("at_risk"),
        F.count_if(status == "Low Volume").alias("low_volume"),
        F.count_if(status == "OK").alias("ok"),
        F.coalesce(F.sum(F.col(cost).cast("decimal(24,6)")).cast("double"), F.lit(0.0)).alias("total_cost_7d"),
    )


SEVERITY = {"OK": 0, "Low Volume": 1, "At Risk": 2, "Critical": 3}


def status_streak(history: DataFrame, keys: list[str], period: str, value: str = "status") -> DataFrame:
    """Length of the latest run of equal status per key, and its direction.

    One row per key and period comes in, so a window holds a key's calendar, not its raw rows.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(period))
    running = newest.rowsBetween(Window.unboundedPreceding, 0)
    rank = F.create_map(*[F.lit(v) for pair in SEVERITY.items() for v in pair])
    marked = (
        history.withColumn("_latest", F.first(value).over(running))
        .withColumn("_broken", F.max(F.when(F.col(value) != F.col("_latest"), 1).otherwise(0)).over(running))
        .withColumn("_rank", rank[F.col(value)])
        .withColumn("_n", F.row_number().over(newest))
    )
    out = marked.groupBy(*keys).agg(
        F.count_if(F.col("_broken") == 0).alias("streak"),
        F.max(F.when(F.col("_n") == 1, F.col(value))).alias("status"),
        F.max(F.when(F.col("_n") == 1, F.col("_rank"))).alias("_now"),
        F.max(F.when(F.col("_n") == 2, F.col("_rank"))).alias("_before"),
    )
    direction = (
        F.when(F.col("_before").isNull(), F.lit("New/insufficient history"))
        .when(F.col("_now") > F.col("_before"), F.lit("Worsening"))
        .when(F.col("_now") < F.col("_before"), F.lit("Improving"))
        .otherwise(F.lit("Stable"))
    )
    return out.withColumn("direction", direction).drop("_now", "_before")
