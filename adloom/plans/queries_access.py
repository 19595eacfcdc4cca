"""Users, roles, capabilities and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adloom.operators import access as A
from adloom.plans.catalog import query
from adloom.plans.frames import Frames, pick
from adloom.plans.oracle import case, sql, stamp
from adloom.sinks import registry as E
from adloom.functions import scalars as S


def _join(col: str) -> str:
    return f"coalesce(array_to_string({col}, '|'), '')"


@query("current_users", "WIN-03", sql("users", f"SELECT email, display_name, role, active, {stamp('updated_at')} AS updated_at FROM users"))
def _(f: Frames) -> DataFrame:
    return f.users.select("email", "display_name", "role", "active", "updated_at")


@query("user_access", "OP-33 JN-15 ARR-01", sql("user_access", f"""
  SELECT email, display_name, role, {_join('capabilities')} AS capabilities FROM user_access"""))
def _(f: Frames) -> DataFrame:
    return A.user_access(f.users, f.roles)


def _has(cap: str) -> str:
    return f"(list_contains(capabilities, '*') OR list_contains(capabilities, '{cap}'))"


@query("permissions", "OP-34 ARR-02", sql("user_access", f"""
  SELECT email, role, {_has('budgets.edit')} AS can_write, list_contains(capabilities, '*') AS is_admin,
    {_has('budgets.history')} AS can_history, {_has('budgets.delete')} AS can_delete FROM user_access"""))
def _(f: Frames) -> DataFrame:
    return A.permissions(A.user_access(f.users, f.roles))


@query("visible_pages", "OP-34", sql("user_access", f"""
  SELECT email, page FROM user_access, (VALUES ('home', NULL), ('budget', 'budgets.view'), ('history', 'budgets.history'),
    ('console', 'admin.console')) p(page, cap)
  WHERE cap IS NULL OR list_contains(capabilities, '*') OR list_contains(capabilities, cap)"""))
def _(f: Frames) -> DataFrame:
    pages = {"home": None, "budget": "budgets.view", "history": "budgets.history", "console": "admin.console"}
    return A.visible_pages(A.user_access(f.users, f.roles), pages)


_LEGACY = {"google_ads": "admin", "meta": " Editor ", "bing": "viewer", "nextdoor": "VIEWER", "lsa": "guest"}


@query("legacy_access", "OP-35", sql("order_cells", f"""
  WITH d AS (SELECT changed_by AS email, {case('channel', _LEGACY)} AS role, changed_at, order_key FROM order_cells WHERE o_orderstatus <> 'F'
    QUALIFY row_number() OVER (PARTITION BY changed_by ORDER BY changed_at DESC) = 1)
  SELECT lower(trim(email)) AS email, lower(trim(role)) AS role, CASE lower(trim(role)) WHEN 'admin' THEN '*'
    WHEN 'editor' THEN 'performance.view|budgets.view|budgets.edit|tickets.use|kpi.view|accounts.view'
    WHEN 'viewer' THEN 'performance.view|budgets.view|tickets.use|kpi.view|accounts.view' ELSE '' END AS capabilities FROM d"""))
def _(f: Frames) -> DataFrame:
    directory = f.order_cells.select(
        F.col("changed_by").alias("email"), pick(F.col("channel"), _LEGACY).alias("role"),
        (F.col("o_orderstatus") != "F").alias("active"), F.col("changed_at").alias("updated_at"))
    return A.legacy_access(directory)


@query("capability_diff", "OP-36", sql("users roles", """
  WITH b AS (SELECT u.*, coalesce(r.capabilities, CAST([] AS VARCHAR[])) AS base FROM users u LEFT JOIN roles r ON r.role = u.role)
  SELECT email, role, array_to_string(base, '|') AS base,
    array_to_string(list_filter(base, lambda x: list_contains(coalesce(revoked, CAST([] AS VARCHAR[])), x)), '|') AS revoked,
    array_to_string(list_filter(coalesce(extra, CAST([] AS VARCHAR[])), lambda x: NOT list_contains(base, x)), '|') AS extra FROM b"""))
def _(f: Frames) -> DataFrame:
    return A.capability_diff(f.users, f.roles)


@query("audit_view", "OP-37 JSN-01 DT-07 SRT-07", sql("", """
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS action, 'user' || user_id || '@example.com' AS target_email,
    'k: ' || regexp_extract(props, '([0-9]+)', 1) AS detail, 'admin@example.com' AS changed_by, strftime(ts, '%Y-%m-%d %H:%M:%S') AS changed_at
  FROM events ORDER BY date_trunc('second', ts) DESC, CAST(event_id AS VARCHAR) DESC LIMIT 100"""))
def _(f: Frames) -> DataFrame:
    return A.audit_view(f.audit_events)


_ASKED = {"google_ads": "set_role", "meta": "grant", "bing": "revoke", "nextdoor": "add_user", "lsa": "set_active"}
_PROTECTED = "user1@example.com"


@query("validated_changes", "FLT-22", sql("users roles order_cells", f"""
  WITH q AS (SELECT order_key, CASE WHEN order_key % 97 = 0 THEN 'retire' ELSE {case('channel', _ASKED)} END AS action,
      CASE WHEN order_key % 31 = 0 THEN 'nobody' WHEN order_key % 29 = 0 THEN 'new' || order_key || '@example.com'
           ELSE ' User' || (order_key % 40) || '@Example.com' END AS email,
      CASE WHEN month = 1 THEN '9lives' WHEN month = 2 THEN 'pilot' WHEN month = 3 THEN NULL ELSE 'Analyst' END AS role,
      CASE WHEN month < 4 THEN 'budgets' ELSE 'budgets.edit' END AS capability, amount > 250000 AS active FROM order_cells),
  n AS (SELECT *, lower(trim(email)) AS e, coalesce(lower(trim(role)), CASE WHEN action = 'add_user' THEN 'analyst' ELSE '' END) AS r FROM q)
  SELECT order_key, CASE WHEN NOT regexp_full_match(e, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}') THEN 'A valid email is required'
    WHEN action = 'retire' THEN 'Unknown action: retire'
    WHEN action IN ('set_role', 'add_user') AND NOT regexp_full_match(r, '[a-z][a-z0-9_]*') THEN 'Invalid role'
    WHEN action IN ('set_role', 'add_user') AND r NOT IN (SELECT role FROM roles) THEN 'Unknown role: ' || r
    WHEN action IN ('grant', 'revoke') AND capability = 'budgets' THEN 'Invalid capability (expected modulo.accion)'
    WHEN action = 'set_role' AND e = '{_PROTECTED}' AND r <> 'admin' THEN 'This account is lockout-protected and must remain admin.'
    WHEN action = 'set_active' AND e = '{_PROTECTED}' AND NOT active THEN 'This account is lockout-protected and cannot be deactivated.'
    WHEN action = 'revoke' AND e = '{_PROTECTED}' THEN 'This account is lockout-protected; nothing to revoke on admin.'
    WHEN action = 'add_user' AND e IN (SELECT lower(email) FROM users) THEN 'User already exists'
    WHEN action <> 'add_user' AND e NOT IN (SELECT lower(email) FROM users) THEN 'No user found with that email' END AS error FROM n"""))
def _(f: Frames) -> DataFrame:
    key, month = F.col("order_key"), F.col("month")
    asked = f.order_cells.select(
        "order_key",
        F.when(key % 97 == 0, F.lit("retire")).otherwise(pick(F.col("channel"), _ASKED)).alias("action"),
        F.when(key % 31 == 0, F.lit("nobody")).when(key % 29 == 0, F.concat(F.lit("new"), key.cast("string"), F.lit("@example.com")))
        .otherwise(F.concat(F.lit(" User"), (key % 40).cast("string"), F.lit("@Example.com"))).alias("email"),
        F.when(month == 1, F.lit("9lives")).when(month == 2, F.lit("pilot")).when(month != 3, F.lit("Analyst")).alias("role"),
        F.when(month < 4, F.lit("budgets")).otherwise(F.lit("budgets.edit")).alias("capability"),
        (F.col("amount") > 250000).alias("active"))
    return A.validate_change(asked, f.roles, f.users, [_PROTECTED]).select("order_key", "error")


@query("updated_users", "SNK-07", sql("users", """
  SELECT email, CASE WHEN role = 'contractor' THEN 'client' ELSE role END AS role, CASE WHEN role = 'contractor' THEN false ELSE active END AS active FROM users"""))
def _(f: Frames) -> DataFrame:
    hit = F.col("role") == "contractor"
    return E.update_where(f.users, hit, {"role": F.lit("client"), "active": F.lit(False)}).select("email", "role", "active")


@query("affected_users", "SNK-07", sql("users", "SELECT count(*) FILTER (role = 'contractor') AS affected FROM users"))
def _(f: Frames) -> DataFrame:
    return E.affected_rows(f.users, F.col("role") == "contractor")


@query("granted_capabilities", "ARR-01 SNK-07", sql("users", f"""
  SELECT email, CASE WHEN role = 'analyst' THEN array_to_string(list_concat(list_filter(coalesce(extra, CAST([] AS VARCHAR[])), lambda x: x <> 'budgets.view'),
      ['budgets.view']), '|') ELSE array_to_string(extra, '|') END AS extra_capabilities,
    CASE WHEN role = 'analyst' THEN array_to_string(list_filter(coalesce(revoked, CAST([] AS VARCHAR[])), lambda x: x <> 'budgets.view'), '|')
      ELSE array_to_string(revoked, '|') END AS revoked_capabilities FROM users"""))
def _(f: Frames) -> DataFrame:
    return A.grant(f.users, F.col("role") == "analyst", F.lit("budgets.view")).select(
        "email", "extra_capabilities", "revoked_capabilities")


@query("revoked_capabilities", "ARR-01", sql("users", f"""
  SELECT email, array_to_string(list_filter(coalesce(extra, CAST([] AS VARCHAR[])), lambda x: x <> 'kpi.view'), '|') AS extra_capabilities,
    array_to_string(list_concat(coalesce(revoked, CAST([] AS VARCHAR[])), ['kpi.view']), '|') AS revoked_capabilities FROM users"""))
def _(f: Frames) -> DataFrame:
    return A.revoke(f.users, F.lit(True), F.lit("kpi.view")).select("email", "extra_capabilities", "revoked_capabilities")


@query("inserted_users", "SNK-08 JN-10", sql("users", """
  SELECT lower(email) AS email, 'existing' AS origin FROM users
  UNION ALL SELECT 'user' || c_custkey || '@example.com', 'new' FROM customer
    WHERE 'user' || c_custkey || '@example.com' NOT IN (SELECT lower(email) FROM users)"""))
def _(f: Frames) -> DataFrame:
    rows = f.table("customer").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
                                      F.lit("new").alias("origin"))
    existing = f.users.select("email", F.lit("existing").alias("origin"))
    return E.insert_if_absent(existing, rows).select(F.lower("email").alias("email"), "origin")


@query("deduplicated_seed", "SNK-11", sql("users_log", f"""
  SELECT display_name, email, role, {stamp('updated_at')} AS updated_at FROM users_log
  QUALIFY row_number() OVER (PARTITION BY display_name ORDER BY users_log.updated_at DESC) = 1"""))
def _(f: Frames) -> DataFrame:
    return E.dedupe_seed(f.users_log, ["display_name"], [F.desc("updated_at")]).select("display_name", "email", "role", "updated_at")


@query("effective_capability_counts", "OP-33", sql("user_access", """
  SELECT cap, count(*) AS users FROM (SELECT unnest(capabilities) AS cap FROM user_access) GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    caps = A.user_access(f.users, f.roles).select(F.explode("capabilities").alias("cap"))
    return caps.groupBy("cap").agg(F.count(F.lit(1)).alias("users"))


@query("capability_checks", "ARR-02 OP-34", sql("user_access", f"""
  SELECT {_has('kpi.view')} AS sees_kpi, count(*) AS users FROM user_access GROUP BY 1"""))
def _(f: Frames) -> DataFrame:
    access = A.user_access(f.users, f.roles)
    return access.groupBy(S.has_capability(F.col("capabilities"), "kpi.view").alias("sees_kpi")).agg(F.count(F.lit(1)).alias("users"))
