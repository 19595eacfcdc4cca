"""Small in-place edits of registries and permission tables, as DataFrame rewrites.

Each returns the new content; write it with tables.publish.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adloom.functions.keyed import latest_per_key


def update_where(df: DataFrame, predicate: Column, sets: Mapping[str, Column]) -> DataFrame:
    hit = F.coalesce(predicate, F.lit(False))
    return df.select(*[
        F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in df.columns
    ])


def affected_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.agg(F.count_if(predicate).alias("affected"))


def insert_if_absent(users: DataFrame, rows: DataFrame) -> DataFrame:
    """Add users whose e-mail (any case) is not present yet."""
    known = users.select(F.lower("email").alias("_email"))
    fresh = (
        rows.withColumn("_email", F.lower("email")).dropDuplicates(["_email"]).join(known, "_email", "left_anti")
    )
    return users.unionByName(fresh.select(*users.columns))


def replace_children(conditions: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace the conditions of every edited rule; position is the array index.

    edits: rule_id, conditions array<struct>.
    """
    fields = [f.name for f in edits.schema["conditions"].dataType.elementType.fields]
    fresh = edits.select("rule_id", F.posexplode("conditions").alias("position", "c")).select(
        "rule_id", "position", *[F.col(f"c.{name}").alias(name) for name in fields]
    )
    kept = conditions.join(edits.select("rule_id"), "rule_id", "left_anti")
    cols = ["rule_id", "position", *fields]
    return kept.select(*cols).unionByName(fresh.select(*cols))


def edit_rules(rules: DataFrame, conditions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A rule edit as one operation: validate, update the rule's fields, replace its conditions wholesale.

    edits: id, the rule's fields, conditions array<struct<metric, operator, threshold, threshold_high>>.
    Returns (rules, conditions, outcomes); outcomes has id and outcome: the first validation error, or
    `not_found`, or `updated`. Only updated rules change; a missing match means `all`.
    """
    from adloom.operators.registry import validate_rule

    checked = validate_rule(edits).join(rules.select("id", F.lit(True).alias("_known")), "id", "left")
    outcome = F.coalesce(F.col("error"), F.when(F.col("_known").isNull(), F.lit("not_found")), F.lit("updated"))
    checked = checked.withColumn("outcome", outcome)
    applied = checked.where(F.col("outcome") == "updated").drop("error", "_known", "outcome")
    fields = [c for c in rules.columns if c != "id"]
    new_rows = applied.select("id", *[(F.coalesce(F.col(c), F.lit("all")) if c == "match" else F.col(c)).alias(c) for c in fields])
    new_rules = rules.join(applied.select("id"), "id", "left_anti").unionByName(new_rows.select(*rules.columns))
    new_conditions = replace_children(conditions, applied.select(F.col("id").alias("rule_id"), "conditions"))
    return new_rules, new_conditions, checked.select("id", "outcome")


def delete_cascade(rules: DataFrame, conditions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete rules together with their conditions."""
    gone = ids.select("id")
    return (
        rules.join(gone, "id", "left_anti"),
        conditions.join(gone.withColumnRenamed("id", "rule_id"), "rule_id", "left_anti"),
    )


def delete_guarded(statuses: DataFrame, rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Outcome per requested status: deleted, in_use or not_found."""
    used = rules.select(F.col("status_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    known = statuses.select("id").withColumn("_known", F.lit(True))
    return (
        ids.select("id")
        .join(known, "id", "left")
        .join(used, "id", "left")
        .select(
            "id",
            F.when(F.col("_used"), F.lit("in_use"))
            .when(F.col("_known"), F.lit("deleted"))
            .otherwise(F.lit("not_found"))
            .alias("outcome"),
        )
    )


def dedupe_seed(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rebuild a permission table with the latest row per key."""
    return latest_per_key(df, list(keys), list(order))
