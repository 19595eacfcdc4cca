"""Versioned registries, evaluation rules, roadmap, tickets and triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adloom.functions import scalars as S
from adloom.operators import registry as R, roadmap as M, tickets as T, triage as G
from adloom.plans.catalog import query
from adloom.plans.frames import Frames
from adloom.plans.oracle import day, sql, stamp
from adloom.sinks import registry as E

TODAY = "1998-06-15"


def _today():
    return F.to_date(F.lit(TODAY))


def _standards(f: Frames) -> DataFrame:
    return R.current_versions(f.standards_log, "item_id", tie="order_key")


def _cards(f: Frames) -> DataFrame:
    return R.current_versions(f.cards_log, "card_id", tie="order_key")


_STD = "item_id, category, level, item, position, exception, status, sort_order"


@query("current_standards", "WIN-04 WIN-03 SRT-04", sql("current_standards", f"SELECT {_STD}, {stamp('created_at')} AS created_at FROM current_standards"))
def _(f: Frames) -> DataFrame:
    return R.order_standards(_standards(f)).select(*_STD.split(", "), "created_at")


@query("standard_versions", "WIN-04", sql("standards_log", f"""
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY created_at ASC NULLS FIRST, order_key) AS BIGINT) AS version_no,
    count(*) OVER (PARTITION BY item_id) AS n_versions,
    row_number() OVER (PARTITION BY item_id ORDER BY created_at ASC NULLS FIRST, order_key) = count(*) OVER (PARTITION BY item_id) AS is_current,
    {stamp('created_at')} AS created_at, edited_by, status, active FROM standards_log"""))
def _(f: Frames) -> DataFrame:
    """Version history of every standard, numbered; one item's history is a filter on it."""
    return R.numbered_versions(f.standards_log, "item_id").select(
        "item_id", "version_no", "n_versions", "is_current", "created_at", "edited_by", "status", "active")


@query("filtered_standards", "FLT-17", sql("current_standards", f"""
  SELECT {_STD} FROM current_standards WHERE category IN ('Targeting', 'Ad Copy', 'House rules') AND status = 'confirmed' AND level = 'Account'
    AND (contains(lower(item), 'bing') OR contains(lower(position), 'bing') OR contains(lower(coalesce(exception, '')), 'bing'))"""))
def _(f: Frames) -> DataFrame:
    rows = R.filter_standards(_standards(f), ["Targeting", "Ad Copy", "House rules"], "confirmed", "Account", "BING")
    return rows.select(*_STD.split(", "))


@query("current_cards", "WIN-04 SRT-05", sql("current_cards", "SELECT * FROM current_cards"))
def _(f: Frames) -> DataFrame:
    return R.cards_feed(_cards(f)).drop("active", "created_at", "order_key")


@query("filtered_cards", "FLT-17 SRT-04", sql("current_cards", """
  SELECT card_id, pillar, title FROM current_cards WHERE pillar = 'Ad copy' AND status = 'confirmed' AND applies_to = 'brand'
    AND (contains(lower(title), 'item 1') OR contains(lower(body), 'item 1'))"""))
def _(f: Frames) -> DataFrame:
    rows = R.filter_cards(_cards(f), ["Ad copy"], "confirmed", "brand", "Item 1")
    return R.order_cards(rows).select("card_id", "pillar", "title")


@query("registry_summary", "AGG-32", sql("current_standards", """
  SELECT count(*) AS total, count(*) FILTER (status <> 'pending') AS confirmed, count(*) FILTER (status = 'pending') AS pending
  FROM current_standards"""))
def _(f: Frames) -> DataFrame:
    return R.registry_summary(_standards(f))


@query("standard_slugs", "STR-09", sql("standards_log", """
  SELECT DISTINCT category, item, regexp_replace(lower(string_split(category, ' ')[1]), '[^a-z0-9]', '', 'g') || '.' ||
    substring(regexp_replace(regexp_replace(lower(trim(item || ' & ' || position)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug
  FROM standards_log"""))
def _(f: Frames) -> DataFrame:
    title = F.concat_ws(" & ", "item", "position")
    return f.standards_log.select("category", "item", S.slug(F.col("category"), title, "cat").alias("slug")).distinct()


@query("validated_standards", "FLT-21", sql("standards_log", """
  SELECT order_key, CASE WHEN order_key % 7 = 0 THEN 'item_id, category, level, and item are required.'
    WHEN sort_order = 3 THEN 'status must be confirmed or pending.' WHEN level = 'Widget' THEN 'invalid level.' END AS error FROM standards_log"""))
def _(f: Frames) -> DataFrame:
    rows = f.standards_log.withColumn("item_id", F.when(F.col("order_key") % 7 != 0, F.col("item_id"))).withColumn(
        "status", F.when(F.col("sort_order") == 3, F.lit("draft")).otherwise(F.col("status")))
    return R.validate_standard(rows).select("order_key", "error")


@query("validated_cards", "FLT-21", sql("standards_log", """
  SELECT order_key, CASE WHEN category NOT IN ('Data Connections', 'Targeting') THEN 'card_id, pillar, title, and status are required' END AS error
  FROM standards_log"""))
def _(f: Frames) -> DataFrame:
    return R.validate_card(f.cards_log).select("order_key", "error")


# ---- rules ----------------------------------------------------------------------------------
_RULE = "id, level, status_id, condition_text, exception_text, match, campaign_type, status_label, status_color, status_rank"


def _rules(f: Frames) -> DataFrame:
    return R.rule_registry(f.rules, f.statuses, f.conditions)


@query("rule_registry", "OP-31 JN-12 SRT-04", sql("rule_registry", f"SELECT {_RULE}, listed FROM rule_registry"))
def _(f: Frames) -> DataFrame:
    listed = F.transform("conditions", lambda c: F.concat_ws(" ", c["metric"], c["operator"], c["threshold"].cast("int")))
    return R.order_rules(_rules(f)).select(*_RULE.split(", "), F.array_join(listed, "|").alias("listed"))


@query("filtered_rules", "FLT-17 ARR-02", sql("rule_registry", """
  SELECT id, level, condition_text FROM rule_registry WHERE level IN ('account', 'campaign') AND status_id = 2 AND campaign_type = 'service'
    AND (has_ctr OR contains(lower(condition_text), 'ctr'))"""))
def _(f: Frames) -> DataFrame:
    rows = R.filter_rules(_rules(f), ["account", "campaign"], 2, "service", "CTR")
    return rows.select("id", "level", "condition_text")


@query("rule_summary", "AGG-31", sql("rule_registry", """
  SELECT count(*) AS total, count(*) FILTER (n > 0) AS computable, count(*) FILTER (n = 0) AS text_only FROM rule_registry"""))
def _(f: Frames) -> DataFrame:
    return R.rule_summary(f.rules, f.conditions)


@query("validated_rules", "FLT-20", sql("rules conditions", """
  WITH c AS (SELECT rule_id, bool_or(operator = 'between' AND (threshold IS NULL OR threshold_high IS NULL)) AS half FROM conditions GROUP BY 1)
  SELECT id, CASE WHEN id % 5 = 0 THEN 'level must be one of account, campaign, ad_group' WHEN id % 7 = 0 THEN 'condition_text is required'
    WHEN id % 11 = 0 THEN 'match must be one of all, any' WHEN half THEN '''between'' needs both threshold and threshold_high' END AS error
  FROM rules r LEFT JOIN c ON c.rule_id = r.id"""))
def _(f: Frames) -> DataFrame:
    key = F.col("id")
    rows = _rules(f).withColumns({
        "level": F.when(key % 5 == 0, F.lit("keyword")).otherwise(F.col("level")),
        "condition_text": F.when(key % 7 == 0, F.lit(" ")).otherwise(F.col("condition_text")),
        "match": F.when(key % 11 == 0, F.lit("most")).otherwise(F.col("match")),
    })
    return R.validate_rule(rows).select("id", "error")


@query("edited_rules", "SNK-09 FLT-20", sql("rules conditions", """
  WITH e AS (SELECT id FROM rules WHERE level = 'account' AND id % 5 <> 0),
  c AS (SELECT rule_id, count(*) AS n FROM conditions WHERE rule_id NOT IN (SELECT id FROM e) GROUP BY 1)
  SELECT r.id, CASE WHEN e.id IS NOT NULL THEN r.condition_text || ' (edited)' ELSE r.condition_text END AS condition_text,
    CASE WHEN e.id IS NOT NULL THEN 'any' ELSE r.match END AS match,
    CAST(CASE WHEN e.id IS NOT NULL THEN 1 ELSE coalesce(c.n, 0) END AS BIGINT) AS n_conditions
  FROM rules r LEFT JOIN e ON e.id = r.id LEFT JOIN c ON c.rule_id = r.id"""))
def _(f: Frames) -> DataFrame:
    """Every account rule edited in one request: those with id divisible by 5 name an unknown level and are
    refused, and edits of ids that do not exist come back not_found; conditions are replaced wholesale."""
    key = F.col("id")
    cond = F.array(F.struct(F.lit("ctr").alias("metric"), F.lit("lt").alias("operator"), F.lit(0.5).alias("threshold"),
                            F.lit(None).cast("double").alias("threshold_high")))
    asked = f.rules.filter("level = 'account'")
    edits = asked.select(
        key.alias("id"), F.when(key % 5 == 0, F.lit("keyword")).otherwise(F.col("level")).alias("level"), "status_id",
        F.concat("condition_text", F.lit(" (edited)")).alias("condition_text"), "exception_text", F.lit("any").alias("match"),
        "campaign_type", cond.alias("conditions"))
    missing = edits.withColumn("id", -key - 1)
    rules, conditions, _ = E.edit_rules(f.rules, f.conditions, edits.unionByName(missing))
    counts = conditions.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_conditions"))
    return rules.join(counts, rules.id == counts.rule_id, "left").select(
        "id", "condition_text", "match", F.coalesce("n_conditions", F.lit(0)).cast("long").alias("n_conditions"))


@query("replaced_conditions", "SNK-09", sql("rules conditions", """
  SELECT rule_id, position, metric, operator, threshold FROM conditions WHERE rule_id NOT IN (SELECT id FROM rules WHERE level = 'account')
  UNION ALL SELECT id, CAST(0 AS INTEGER), 'ctr', 'lt', CAST(0.5 AS DOUBLE) FROM rules WHERE level = 'account'
  UNION ALL SELECT id, CAST(1 AS INTEGER), 'cvr', 'gte', CAST(2.0 AS DOUBLE) FROM rules WHERE level = 'account'"""))
def _(f: Frames) -> DataFrame:
    def one(metric: str, operator: str, threshold: float):
        return F.struct(F.lit(metric).alias("metric"), F.lit(operator).alias("operator"), F.lit(threshold).alias("threshold"))

    edits = f.rules.filter("level = 'account'").select(
        F.col("id").alias("rule_id"), F.array(one("ctr", "lt", 0.5), one("cvr", "gte", 2.0)).alias("conditions"))
    return E.replace_children(f.conditions, edits)


@query("deleted_rules", "SNK-10", sql("rules conditions", """
  SELECT r.id, count(c.rule_id) AS conditions FROM rules r LEFT JOIN conditions c ON c.rule_id = r.id WHERE r.level <> 'campaign' GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    rules, conds = E.delete_cascade(f.rules, f.conditions, f.rules.filter("level = 'campaign'"))
    counts = conds.groupBy(F.col("rule_id").alias("id")).agg(F.count(F.lit(1)).alias("conditions"))
    return rules.select("id").join(counts, "id", "left").fillna(0, subset=["conditions"])


@query("guarded_status_delete", "SNK-10 JN-10", sql("rules statuses", """
  WITH ids AS (SELECT DISTINCT n_nationkey + 1 AS id FROM nation)
  SELECT id, CASE WHEN id IN (SELECT status_id FROM rules) THEN 'in_use' WHEN id IN (SELECT id FROM statuses) THEN 'deleted' ELSE 'not_found' END AS outcome
  FROM ids"""))
def _(f: Frames) -> DataFrame:
    ids = f.table("nation").select((F.col("n_nationkey") + 1).alias("id"))
    return E.delete_guarded(f.statuses, f.rules, ids)


# ---- roadmap --------------------------------------------------------------------------------
@query("roadmap_schedule", "OP-32 STR-07 DT-04", sql("tasks", f"""
  SELECT * REPLACE ({day('planned_start')} AS planned_start, {day('planned_end')} AS planned_end), title ILIKE '%acceptance%' AS is_gate,
    status NOT IN ('done', 'dropped') AND planned_end < DATE '{TODAY}' AS is_late,
    CAST(planned_start - DATE '{TODAY}' AS INTEGER) AS days_to_start, CAST(planned_end - DATE '{TODAY}' AS INTEGER) AS days_to_end FROM tasks"""))
def _(f: Frames) -> DataFrame:
    return M.roadmap_schedule(f.tasks, _today())


@query("roadmap_next_up", "OP-32 SRT-09", sql("tasks", f"""
  SELECT task_id, title, {day('planned_start')} AS planned_start FROM tasks
  WHERE status NOT IN ('done', 'dropped') AND tasks.planned_start >= DATE '{TODAY}' ORDER BY tasks.planned_start, task_id LIMIT 8"""))
def _(f: Frames) -> DataFrame:
    return M.next_up(f.tasks, _today()).select("task_id", "title", "planned_start")


@query("roadmap_gates", "OP-32", sql("tasks", f"""
  SELECT task_id, title, {day('planned_start')} AS planned_start, CASE WHEN status = 'done' THEN 'done'
      WHEN tasks.planned_start < DATE '{TODAY}' THEN CAST(DATE '{TODAY}' - tasks.planned_start AS VARCHAR) || 'd overdue'
      WHEN tasks.planned_start = DATE '{TODAY}' THEN 'today' ELSE 'in ' || CAST(tasks.planned_start - DATE '{TODAY}' AS VARCHAR) || 'd' END AS when_text
  FROM tasks WHERE title ILIKE '%acceptance%'"""))
def _(f: Frames) -> DataFrame:
    return M.gates(M.roadmap_schedule(f.tasks, _today()))


@query("roadmap_counts", "AGG-33", sql("tasks", """
  SELECT count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'in_progress') AS in_progress,
    count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (late) AS late FROM tasks"""))
def _(f: Frames) -> DataFrame:
    return M.roadmap_counts(f.tasks)


@query("stage_progress", "AGG-34", sql("tasks", f"""
  SELECT stage, stage_order, count(*) AS tasks, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'in_progress') AS in_progress,
    count(*) FILTER (late) AS late, {day('min(planned_start)')} AS starts, {day('max(planned_end)')} AS ends FROM tasks GROUP BY 1, 2"""))
def _(f: Frames) -> DataFrame:
    return M.stage_progress(f.tasks)


@query("owner_counts", "AGG-35", sql("tasks", """
  SELECT CASE owner WHEN 'ana' THEN 'ANA' WHEN 'ben' THEN 'BEN' ELSE 'BOTH' END AS owner, count(*) AS tasks FROM tasks GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    return M.owner_counts(f.tasks, {"ana": "ANA", "ben": "BEN"})


# ---- tickets --------------------------------------------------------------------------------
@query("ticket_board", "OP-30 SET-05", sql("", """
  WITH t AS (SELECT conv_id, turn, role AS board_id, CAST(unnest(list_distinct([conv_id % 50, conv_id % 7])) AS VARCHAR) AS client_id
    FROM conversations WHERE role IN ('user', 'assistant', 'system') AND turn % 4 <> 3
      AND NOT (role = 'user' AND turn = 4) AND NOT (role = 'assistant' AND turn IN (1, 5)) AND NOT (role = 'system' AND turn = 0))
  SELECT client_id, CAST(conv_id * 1000 + turn AS VARCHAR) AS id, 'Ticket ' || conv_id AS name,
    CASE turn % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'Working' ELSE 'Stuck' END AS status,
    CASE WHEN turn % 5 <> 0 THEN '#00ff00' ELSE '#c4c4c4' END AS status_color, 'Board ' || board_id AS board, board_id,
    'https://tickets.example.com/' || board_id || '/' || (conv_id * 1000 + turn) AS url,
    CASE WHEN turn % 3 <> 0 THEN '2024-02-0' || (turn % 9 + 1) END AS due_date FROM t"""))
def _(f: Frames) -> DataFrame:
    boards = {b: f.ticket_items.filter(F.col("board_id") == b).drop("board_id") for b in ("user", "assistant", "system")}
    return T.ticket_board(T.union_boards(boards), f.boards, f.done_statuses)


# ---- triage ---------------------------------------------------------------------------------
@query("campaign_triage", "OP-28", sql("triaged", f"SELECT * REPLACE ({day('week')} AS week) FROM triaged"))
def _(f: Frames) -> DataFrame:
    return G.campaign_triage(f.campaign_weeks)


@query("triage_summary", "OP-29", sql("triaged", """
  SELECT count(*) AS total, count(*) FILTER (status = 'Critical') AS critical, count(*) FILTER (status = 'At Risk') AS at_risk,
    count(*) FILTER (status = 'Low Volume') AS low_volume, count(*) FILTER (status = 'OK') AS ok,
    CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE) AS total_cost_7d FROM triaged"""))
def _(f: Frames) -> DataFrame:
    return G.triage_summary(G.campaign_triage(f.campaign_weeks))


@query("status_streak", "WIN-10", sql("triaged", """
  WITH h AS (SELECT campaign, status, row_number() OVER (PARTITION BY campaign ORDER BY week DESC) AS n,
      first_value(status) OVER (PARTITION BY campaign ORDER BY week DESC) AS latest FROM triaged),
  b AS (SELECT *, max(CASE WHEN status <> latest THEN 1 ELSE 0 END) OVER (PARTITION BY campaign ORDER BY n) AS broken,
      CASE status WHEN 'OK' THEN 0 WHEN 'Low Volume' THEN 1 WHEN 'At Risk' THEN 2 ELSE 3 END AS sev FROM h),
  g AS (SELECT campaign, count(*) FILTER (broken = 0) AS streak, max(latest) AS status, max(CASE WHEN n = 1 THEN sev END) AS a,
      max(CASE WHEN n = 2 THEN sev END) AS p FROM b GROUP BY 1)
  SELECT campaign, streak, status, CASE WHEN p IS NULL THEN 'New/insufficient history' WHEN a > p THEN 'Worsening' WHEN a < p THEN 'Improving'
    ELSE 'Stable' END AS direction FROM g"""))
def _(f: Frames) -> DataFrame:
    rows = G.campaign_triage(f.campaign_weeks).select("campaign", "week", "status")
    return G.status_streak(rows, ["campaign"], "week")
