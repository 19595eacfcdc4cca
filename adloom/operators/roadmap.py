"""Project schedule: gates, lateness, what is next, and progress counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

CLOSED = ("done", "dropped")


def _open() -> Column:
    return ~F.coalesce(F.col("status").isin(list(CLOSED)), F.lit(False))


def roadmap_schedule(tasks: DataFrame, today: Column) -> DataFrame:
    """Gate and late flags, signed days to start and to end."""
    return tasks.select(
        "*",
        F.coalesce(F.col("title").ilike("%acceptance%"), F.lit(False)).alias("is_gate"),
        F.coalesce(_open() & (F.col("planned_end") < today), F.lit(False)).alias("is_late"),
        F.datediff("planned_start", today).alias("days_to_start"),
        F.datediff("planned_end", today).alias("days_to_end"),
    ).orderBy("stage_order", "planned_start", "task_id")


def next_up(tasks: DataFrame, today: Column, k: int = 8) -> DataFrame:
    """The next k open tasks; k is the length of the list on the page."""
    return tasks.filter(_open() & (F.col("planned_start") >= today)).orderBy("planned_start", "task_id").limit(k)


def gates(schedule: DataFrame) -> DataFrame:
    over = F.col("days_to_start")
    when = (
        F.when(F.col("status") == "done", F.lit("done"))
        .when(over < 0, F.concat(F.abs(over).cast("string"), F.lit("d overdue")))
        .when(over == 0, F.lit("today"))
        .otherwise(F.concat(F.lit("in "), over.cast("string"), F.lit("d")))
    )
    return schedule.filter("is_gate").select("task_id", "title", "planned_start", when.alias("when_text")).orderBy("planned_start")


def roadmap_counts(tasks: DataFrame) -> DataFrame:
    status = F.col("status")
    return tasks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "done").alias("done"),
        F.count_if(status == "in_progress").alias("in_progress"),
        F.count_if(status == "blocked").alias("blocked"),
        F.count_if("late").alias("late"),
    )


def stage_progress(tasks: DataFrame) -> DataFrame:
    status = F.col("status")
    return tasks.groupBy("stage", "stage_order").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(status == "done").alias("done"),
        F.count_if(status == "in_progress").alias("in_progress"),
        F.count_if("late").alias("late"),
        F.min("planned_start").alias("starts"),
        F.max("planned_end").alias("ends"),
    ).orderBy("stage_order")


def owner_counts(tasks: DataFrame, labels: Mapping[str, str], shared: str = "BOTH") -> DataFrame:
    """Tasks per named owner; everything else is shared."""
    table = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return tasks.groupBy(F.coalesce(table[F.col("owner")], F.lit(shared)).alias("owner")).agg(
        F.count(F.lit(1)).alias("tasks")
    )
