"""Users, roles and capabilities; the audit view of access changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adloom.functions import labels as L, scalars as S
from adloom.functions.keyed import latest_per_key

TEXTS = "array<string>"


def _list(col: str) -> Column:
    return F.coalesce(F.col(col), F.array().cast(TEXTS))


def current_users(users: DataFrame) -> DataFrame:
    """Latest row per e-mail, case-insensitive."""
    return latest_per_key(users, [F.lower("email")], [F.desc("updated_at")])


def user_access(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Effective capabilities of active users: role plus extras minus revoked."""
    base = roles.select("role", F.col("capabilities").alias("role_capabilities"))
    effective = F.array_except(
        F.array_union(_list("role_capabilities"), _list("extra_capabilities")), _list("revoked_capabilities")
    )
    return (
        users.filter("active")
        .join(base, "role", "left")
        .select(F.lower(F.trim("email")).alias("email"), "display_name", "role", F.sort_array(effective).alias("capabilities"))
    )


def permissions(access: DataFrame) -> DataFrame:
    caps = F.col("capabilities")
    return access.select(
        "email",
        "role",
        S.has_capability(caps, "budgets.edit").alias("can_write"),
        F.array_contains(F.coalesce(caps, F.array().cast(TEXTS)), L.WILDCARD).alias("is_admin"),
        S.has_capability(caps, "budgets.history").alias("can_history"),
        S.has_capability(caps, "budgets.delete").alias("can_delete"),
    )


def visible_pages(access: DataFrame, pages: Mapping[str, str | None]) -> DataFrame:
    """Pages each user may open; a page without a required capability is open to everyone.

    The page list is configuration of fixed length, so it becomes a literal array.
    """
    caps = F.coalesce("capabilities", F.array().cast(TEXTS))
    allowed = F.array(*[
        F.when(S.has_capability(caps, cap), F.lit(page)) if cap else F.lit(page) for page, cap in pages.items()
    ])
    return access.select("email", F.explode(F.array_compact(allowed)).alias("page"))


def legacy_access(directory: DataFrame) -> DataFrame:
    """Fallback directory: latest active role per e-mail to its capability package."""
    rows = latest_per_key(directory.filter("active"), ["email"], [F.desc("updated_at")])
    role = F.lower(F.trim("role"))
    packages = F.create_map(*[
        part
        for name, caps in L.LEGACY_CAPABILITIES.items()
        for part in (F.lit(name), F.array(*[F.lit(c) for c in caps]))
    ])
    return rows.select(
        F.lower(F.trim("email")).alias("email"),
        role.alias("role"),
        F.coalesce(packages[role], F.array().cast(TEXTS)).alias("capabilities"),
    )


def capability_diff(users: DataFrame, roles: DataFrame) -> DataFrame:
    """What a user page shows: the role's capabilities, which are revoked, which are extra."""
    base = roles.select("role", F.col("capabilities").alias("base"))
    b = _list("base")
    return users.join(base, "role", "left").select(
        "email",
        "role",
        b.alias("base"),
        F.array_intersect(b, _list("revoked_capabilities")).alias("revoked"),
        F.array_except(_list("extra_capabilities"), b).alias("extra"),
    )


# ---- changes ------------------------------------------------------------------------------
def validate_change(df: DataFrame, roles: DataFrame, users: DataFrame, protected: Sequence[str]) -> DataFrame:
    """First problem of each requested access change as `error`.

    Columns: action, email, role, capability, active. Protected accounts cannot lose access.
    """
    email = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    action = F.col("action")
    default = F.when(action == "add_user", F.lit("analyst")).otherwise(F.lit(""))
    role = F.lower(F.trim(F.coalesce(F.nullif(F.col("role"), F.lit("")), default)))
    cap = F.lower(F.trim(F.coalesce("capability", F.lit(""))))
    guarded = F.col("_email").isin(list(protected))
    known_roles = roles.select(F.col("role").alias("_role")).distinct().withColumn("_role_known", F.lit(True))
    known_users = users.select(F.lower("email").alias("_email")).distinct().withColumn("_user_known", F.lit(True))
    rows = (
        df.withColumn("_email", email)
        .withColumn("_role", role)
        .withColumn("_cap", cap)
        .join(known_roles, "_role", "left")
        .join(known_users, "_email", "left")
    )
    with_role = action.isin("set_role", "add_user")
    with_cap = action.isin("grant", "revoke")
    active = F.coalesce("active", F.lit(False))
    error = (
        F.when(~F.col("_email").rlike(L.EMAIL_PATTERN), F.lit(L.ACCESS_EMAIL_REQUIRED))
        .when(~F.coalesce(with_role | with_cap | (action == "set_active"), F.lit(False)),
              F.concat(F.lit("Unknown action: "), F.coalesce(action, F.lit("undefined"))))
        .when(with_role & ~F.col("_role").rlike(L.ROLE_PATTERN), F.lit(L.ACCESS_ROLE_INVALID))
        .when(with_role & F.col("_role_known").isNull(), F.concat(F.lit("Unknown role: "), "_role"))
        .when(with_cap & ~F.col("_cap").rlike(L.CAPABILITY_PATTERN),
              F.lit(L.ACCESS_CAPABILITY_INVALID))
        .when((action == "set_role") & guarded & (F.col("_role") != "admin"),
              F.lit(L.ACCESS_KEEP_ADMIN))
        .when((action == "set_active") & guarded & ~active,
              F.lit(L.ACCESS_KEEP_ACTIVE))
        .when((action == "revoke") & guarded,
              F.lit(L.ACCESS_NOTHING_TO_REVOKE))
        .when((action == "add_user") & F.col("_user_known").isNotNull(), F.lit(L.ACCESS_USER_EXISTS))
        .when((action != "add_user") & F.col("_user_known").isNull(), F.lit(L.ACCESS_USER_MISSING))
    )
    return rows.withColumn("error", error).drop("_email", "_role", "_cap", "_role_known", "_user_known")


def grant(users: DataFrame, who: Column, capability: Column) -> DataFrame:
    """Add to the extras and lift a revocation."""
    hit = F.coalesce(who, F.lit(False))
    return users.withColumns({
        "extra_capabilities": F.when(hit, S.add_element(F.col("extra_capabilities"), capability))
        .otherwise(F.col("extra_capabilities")),
        "revoked_capabilities": F.when(hit, S.drop_element(F.col("revoked_capabilities"), capability))
        .otherwise(F.col("revoked_capabilities")),
    })


def revoke(users: DataFrame, who: Column, capability: Column) -> DataFrame:
    hit = F.coalesce(who, F.lit(False))
    return users.withColumns({
        "revoked_capabilities": F.when(hit, S.add_element(F.col("revoked_capabilities"), capability))
        .otherwise(F.col("revoked_capabilities")),
        "extra_capabilities": F.when(hit, S.drop_element(F.col("extra_capabilities"), capability))
        .otherwise(F.col("extra_capabilities")),
    })


def audit_view(events: DataFrame, limit: int = 100) -> DataFrame:
    """Newest changes with the JSON detail flattened to 'key: value' text; the limit is the page."""
    pairs = F.map_entries(F.from_json("detail", "map<string,string>"))
    flat = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " · ")
    newest = events.orderBy(F.desc("changed_at"), F.desc("event_id")).limit(limit)
    return newest.select(
        "event_id", "action", "target_email", F.coalesce(flat, F.lit("")).alias("detail"), "changed_by",
        S.epoch_text(F.col("changed_at")).alias("changed_at"),
    )
