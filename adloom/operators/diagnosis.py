"""Account diagnosis inputs: snapshots, portfolio medians, waste, verification and evidence.

Thresholds are placeholders in the source material, so each one is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adloom.functions import scalars as S
from adloom.functions.keyed import top_per_key

MEDIAN_ACCURACY = 10_000
#: Rows of a bracket that are ranked directly; larger brackets are narrowed by another sketch first.
MEDIAN_BRACKET_ROWS = 1_000_000
MEDIAN_STEPS = [i / 256 for i in range(257)]
ACCOUNT_TYPE = ["account_id", "campaign_type"]


def campaign_type(channel_type: Column, name: Column) -> Column:
    return (
        F.when(channel_type == "LOCAL_SERVICES", F.lit("lsa"))
        .when(F.lower(name).rlike("brand"), F.lit("brand"))
        .otherwise(F.lit("service"))
    )


# ---- snapshot -----------------------------------------------------------------------------
def account_type_daily(stats: DataFrame) -> DataFrame:
    """Account x campaign type x day; money arrives in micros."""
    kind = campaign_type(F.col("campaign_advertising_channel_type"), F.col("campaign_name"))
    return stats.groupBy(
        F.col("segments_date").alias("snapshot_date"),
        F.col("customer_id").cast("string").alias("account_id"),
        kind.alias("campaign_type"),
    ).agg(
        S.from_micros(F.sum("metrics_cost_micros")).alias("spend"),
        F.sum("metrics_clicks").alias("clicks"),
        F.sum("metrics_impressions").alias("impressions"),
        F.sum("metrics_conversions").alias("conversions"),
    )


def account_type_window(daily: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Trailing totals with the derived rates."""
    out = daily.filter(S.since(F.col("snapshot_date"), as_of, days)).groupBy(*ACCOUNT_TYPE).agg(
        F.sum(F.col("spend").cast("decimal(20,6)")).cast("double").alias("spend"),
        *[F.sum(c).alias(c) for c in ("clicks", "impressions", "conversions")],
    )
    return out.select("*", *rates())


def rates() -> list[Column]:
    spend, clicks, shown, won = (F.col(c) for c in ("spend", "clicks", "impressions", "conversions"))
    return [
        S.ratio(clicks, shown).alias("ctr"),
        S.ratio(won, clicks).alias("cvr"),
        S.ratio(spend, clicks).alias("cpc"),
        S.ratio(spend, won).alias("platform_cpa"),
    ]


def exact_lower_median(base: DataFrame, key: str, col: str) -> DataFrame:
    """key, the lower median of col (the ceil(n/2)-th smallest non-null value), exactly, by distributed selection.

    A quantile sketch brackets the target rank; one pass counts the rows below and inside the bracket. Only the
    rows inside it are ranked, and while a bracket still holds over MEDIAN_BRACKET_ROWS rows it is narrowed again
    by a new sketch of its own rows. A bracket that misses the rank (beyond the sketch's error bound) falls back
    to the whole range of its key, so the result is exact in every case. The per-key tables hold one row per
    key and are broadcast: keys are a fixed vocabulary (campaign types), so few keys cannot all land in few tasks.
    """
    vals = base.select(F.col(key).alias("_k"), F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    bounds = vals.groupBy("_k").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
    ).select("_k", F.ceil(F.col("_n") / 2).cast("long").alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"),
             "_n")
    spark = base.sparkSession
    bounds = spark.createDataFrame(bounds.collect(), bounds.schema)  # one row per key

    def per_key(rows: DataFrame, table: DataFrame, *cols: str) -> DataFrame:
        """rows with the key's columns of a one-row-per-key table; a null key is a key like any other."""
        small = F.broadcast(table.select(F.col("_k").alias("_tk"), *cols))
        return rows.join(small, F.col("_k").eqNullSafe(F.col("_tk"))).drop("_tk")

    while True:
        inside = per_key(vals, bounds, "_lo", "_hi").where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        largest = bounds.agg(F.max("_n")).first()[0]
        if largest is None or largest <= MEDIAN_BRACKET_ROWS:
            break
        # the target's rank among the bracket's rows, bracketed again by a sketch of those rows
        local = bounds.select("_k", (F.col("_rank") - F.col("_below")).alias("_r"), "_n")
        sketch = inside.groupBy("_k").agg(F.percentile_approx("_x", F.array(*[F.lit(q) for q in MEDIAN_STEPS]), MEDIAN_ACCURACY).alias("_q"))
        grid = len(MEDIAN_STEPS) - 1
        share = F.col("_r") / F.col("_n")

        def at(index: Column) -> Column:  # grid point, clamped to the grid, 1-based for element_at
            return F.element_at("_q", F.greatest(F.lit(0), F.least(F.lit(grid), index)).cast("int") + 1)

        guess = per_key(local, sketch, "_q").select(
            "_k", at(F.floor(share * grid) - 1).alias("_nlo"), at(F.ceil(share * grid) + 1).alias("_nhi"))
        tally = per_key(inside.drop("_lo", "_hi"), guess, "_nlo", "_nhi").groupBy("_k").agg(
            F.count(F.when(F.col("_x") < F.col("_nlo"), 1)).alias("_lt"),
            F.count(F.when(F.col("_x").between(F.col("_nlo"), F.col("_nhi")), 1)).alias("_in"),
            F.first("_nlo").alias("_nlo"), F.first("_nhi").alias("_nhi"))
        step = per_key(bounds, tally, "_lt", "_in", "_nlo", "_nhi")
        hit = (F.col("_below") + F.col("_lt") < F.col("_rank")) & (F.col("_rank") <= F.col("_below") + F.col("_lt") + F.col("_in"))
        narrowed = step.select(
            "_k", "_rank",
            F.when(hit, F.col("_nlo")).otherwise(F.col("_lo")).alias("_lo"),
            F.when(hit, F.col("_nhi")).otherwise(F.col("_hi")).alias("_hi"),
            F.when(hit, F.col("_below") + F.col("_lt")).otherwise(F.col("_below")).alias("_below"),
            F.when(hit, F.col("_in")).otherwise(F.col("_n")).alias("_n"))
        rows = narrowed.collect()  # one row per key
        if all(r["_n"] == o["_n"] for r, o in zip(sorted(rows, key=lambda r: str(r["_k"])),
                                                    sorted(bounds.collect(), key=lambda r: str(r["_k"])))):
            break  # no bracket got smaller: rank what is left exactly
        bounds = spark.createDataFrame(rows, narrowed.schema)
    order = Window.partitionBy("_k").orderBy("_x")
    ranked = per_key(inside.drop("_lo", "_hi"), bounds, "_below", "_rank").withColumn(
        "_pos", F.col("_below") + F.row_number().over(order))
    return ranked.where(F.col("_pos") == F.col("_rank")).select(F.col("_k").alias(key), F.col("_x").alias(col))


def portfolio_medians(base: DataFrame) -> DataFrame:
    """Median CTR and CVR per campaign type, never blended over types; exact at every size (lower median)."""
    ctr = exact_lower_median(base, "campaign_type", "ctr").withColumnRenamed("ctr", "median_ctr")
    cvr = exact_lower_median(base, "campaign_type", "cvr").withColumnRenamed("cvr", "median_cvr")
    types = base.select("campaign_type").distinct()
    on = lambda t, m: t.join(m.withColumnRenamed("campaign_type", "_t"), F.col("campaign_type").eqNullSafe(F.col("_t")), "left").drop("_t")
    return on(on(types, ctr), cvr)


def vs_portfolio(base: DataFrame, medians: DataFrame) -> DataFrame:
    return base.join(medians, "campaign_type").select(
        *[F.col(c) for c in base.columns],
        S.ratio(F.col("ctr"), F.col("median_ctr")).alias("ctr_vs_portfolio"),
        S.ratio(F.col("cvr"), F.col("median_cvr")).alias("cvr_vs_portfolio"),
    )


def account_snapshot(
    daily: DataFrame, mapping: DataFrame, medians: DataFrame, day: Column, now: Column, job: str = "snapshot_daily"
) -> DataFrame:
    """One day's rows with client key and portfolio comparison, ready for accumulate_snapshot."""
    clients = mapping.select(
        F.col("google_ads_customer_id").alias("account_id"), F.col("monday_item_id").alias("client_key")
    )
    rows = daily.filter(F.col("snapshot_date") == day).select("*", *rates()).join(clients, "account_id", "left")
    return vs_portfolio(rows, medians).withColumn("loaded_at", now).withColumn("source_job", F.lit(job))


def days_since_last_conversion(daily: DataFrame, as_of: Column) -> DataFrame:
    """Days since the last converting day, and the clicks paid for since then."""
    per_day = daily.groupBy("account_id", "snapshot_date").agg(
        F.sum("clicks").alias("clicks"), F.sum("conversions").alias("conversions")
    )
    last = per_day.groupBy("account_id").agg(
        F.max(F.when(F.col("conversions") > 0, F.col("snapshot_date"))).alias("last_conversion")
    )
    silent = F.col("last_conversion").isNull() | (F.col("snapshot_date") > F.col("last_conversion"))
    return (
        per_day.join(last, "account_id")
        .groupBy("account_id", "last_conversion")
        .agg(F.coalesce(F.sum(F.when(silent, F.col("clicks"))), F.lit(0)).alias("clicks_since"))
        .withColumn("days_since_last_conv", F.datediff(as_of, "last_conversion"))
    )


def tracking_state(days_since: Column, clicks_since: Column, warn_days: int = 7, fail_days: int = 14,
                   clicks_floor: int = 200) -> Column:
    quiet = F.coalesce(days_since, F.lit(10**6))
    return (
        F.when(clicks_since <= clicks_floor, F.lit("ok"))
        .when(quiet > fail_days, F.lit("fail"))
        .when(quiet >= warn_days, F.lit("warn"))
        .otherwise(F.lit("ok"))
    )


# ---- search terms ---------------------------------------------------------------------------
def waste_by_cause(terms: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Each dollar under exactly one cause, by precedence; masked spend is its own line."""
    cause = (
        F.when(~F.col("term_visible"), F.lit("unattributable"))
        .when(F.col("relevance_class") == "irrelevant", F.lit("irrelevant_term"))
        .when(F.col("geo_flag") == "nonconverting_pooled", F.lit("geo_nonconverting"))
        .when(F.col("hour_flag") == "nonconverting_pooled", F.lit("hours_nonconverting"))
        .otherwise(F.lit("clean"))
    )
    return (
        terms.filter(S.since(F.col("spend_date"), as_of, days))
        .groupBy("account_id", "campaign_type", cause.alias("waste_cause"))
        .agg(F.sum("spend").alias("spend_30d"))
    )


def masked_spend(terms: DataFrame) -> DataFrame:
    visible = F.col("term_visible")
    out = terms.groupBy("account_id").agg(
        F.coalesce(F.sum(F.when(visible, F.col("spend"))).cast("double"), F.lit(0.0)).alias("visible_spend"),
        F.coalesce(F.sum(F.when(~visible, F.col("spend"))).cast("double"), F.lit(0.0)).alias("masked_spend"),
    )
    total = F.col("visible_spend") + F.col("masked_spend")
    return out.withColumn("masked_spend_pct", S.ratio(F.col("masked_spend"), total))


def relevant_ctr(terms: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """CTR over visible relevant terms and the share of spend behind it."""
    good = F.col("term_visible") & (F.col("relevance_class") == "relevant")
    out = terms.filter(S.since(F.col("spend_date"), as_of, days)).groupBy(*ACCOUNT_TYPE).agg(
        F.sum(F.when(good, F.col("clicks"))).alias("_clicks"),
        F.sum(F.when(good, F.col("impressions"))).alias("_shown"),
        F.sum(F.when(good, F.col("spend"))).cast("double").alias("_spend"),
        F.sum("spend").cast("double").alias("_all"),
    )
    return out.select(
        *ACCOUNT_TYPE,
        S.ratio(F.col("_clicks"), F.col("_shown")).alias("relevant_ctr_visible"),
        F.coalesce(S.ratio(F.col("_spend"), F.col("_all")), F.lit(0.0)).alias("relevant_ctr_coverage_pct"),
    )


def _words(col: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(col)), r"\s+"), lambda w: w != "")


def negative_conflicts(negatives: DataFrame, terms: DataFrame) -> DataFrame:
    """Negative keywords that block a converting query of the same account (phrase match).

    A query contains a keyword when the keyword's words occur in it in sequence. Each distinct
    query is cut into its word sequences, so matching is an equi-join on (account, phrase)
    instead of testing every keyword against every query. Only sequence lengths that some
    negative has are generated.
    """
    neg = (
        negatives.withColumn("_w", _words(F.col("keyword")))
        .filter(F.size("_w") > 0)
        .select("account_id", "keyword", F.array_join("_w", " ").alias("phrase"), F.size("_w").alias("n"))
    )
    lengths = neg.agg(F.collect_set("n")).scalar()
    # pre-aggregated to one row per distinct query before anything is multiplied
    queries = (
        terms.filter(F.col("conversions") > 0)
        .groupBy("account_id", "term")
        .agg(F.sum("conversions").alias("conversions"), F.sum("spend").alias("spend"))
        .withColumn("_w", _words(F.col("term")))
    )
    phrases = queries.withColumn("_n", F.explode(lengths)).filter(F.col("_n") <= F.size("_w"))
    starts = F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1)
    cut = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(F.col("_w"), i, F.col("_n")), " ")))
    phrases = phrases.select("account_id", "term", "conversions", "spend", F.explode(cut).alias("phrase"))
    return phrases.join(neg.select("account_id", "phrase", "keyword"), ["account_id", "phrase"]).select(
        "account_id", "keyword", "term", "conversions", "spend"
    )


def classifier_audit(sample: DataFrame) -> DataFrame:
    """Precision and recall per classifier version and class."""
    hits = F.count_if(F.col("predicted") == F.col("actual"))
    one = F.count(F.lit(1))
    guessed = sample.groupBy("classifier_version", F.col("predicted").alias("relevance_class")).agg(
        one.alias("predicted_n"), hits.alias("hits")
    )
    true = sample.groupBy("classifier_version", F.col("actual").alias("relevance_class")).agg(one.alias("actual_n"))
    both = guessed.join(true, ["classifier_version", "relevance_class"], "full").fillna(0)
    return both.select(
        "classifier_version",
        "relevance_class",
        (F.col("predicted_n")).alias("sample_n"),
        S.ratio(F.col("hits"), F.col("predicted_n")).alias("precision"),
        S.ratio(F.col("hits"), F.col("actual_n")).alias("recall"),
    )


# ---- weighted evidence ------------------------------------------------------------------------
def spend_weighted(df: DataFrame, keys: Sequence[str], value: str, weight: str = "spend") -> DataFrame:
    """Weighted mean over rows that have a value, and the share of weight they cover."""
    have = F.when(F.col(value).isNotNull(), F.col(weight))
    out = df.groupBy(*keys).agg(
        F.sum(F.col(value) * F.col(weight)).cast("double").alias("_vw"),
        F.sum(have).cast("double").alias("_w"),
        F.sum(weight).cast("double").alias("_all"),
    )
    return out.select(
        *keys,
        S.ratio(F.col("_vw"), F.col("_w")).alias("weighted"),
        F.coalesce(S.ratio(F.col("_w"), F.col("_all")), F.lit(0.0)).alias("coverage_pct"),
    )


def ad_strength_share(ads: DataFrame, keys: Sequence[str] = ("account_id",)) -> DataFrame:
    """Share of spend on poor or average ads, and share of ads with any rating."""
    strength = F.upper("ad_strength")
    weak = F.sum(F.when(strength.isin("POOR", "AVERAGE"), F.col("spend"))).cast("double")
    rated = F.count_if(strength.isin("POOR", "AVERAGE", "GOOD", "EXCELLENT"))
    return ads.groupBy(*keys).agg(
        F.coalesce(S.ratio(weak, F.sum("spend")), F.lit(0.0)).alias("ad_strength_poor_avg_spend_pct"),
        S.ratio(rated, F.count(F.lit(1))).alias("asset_label_coverage_pct"),
    )


def worst_ads(ads: DataFrame, n: int = 5) -> DataFrame:
    """Per account the n ads with most spend behind a weak strength; n is the evidence size."""
    weakness = F.create_map(*[
        F.lit(v) for pair in {"POOR": 1.0, "AVERAGE": 0.5, "GOOD": 0.1}.items() for v in pair
    ])[F.upper("ad_strength")]
    scored = ads.withColumn("score", F.col("spend").cast("double") * F.coalesce(weakness, F.lit(0.0)))
    return top_per_key(scored, ["account_id"], [F.desc("score"), F.asc("ad_id")], n)


# ---- calls against platform conversions ---------------------------------------------------------
def qualified_calls(calls: DataFrame, min_seconds: int = 60) -> DataFrame:
    """Calls, qualified calls and answer rate per account and day, from epoch seconds."""
    return calls.groupBy(
        "account_id", F.to_date(F.timestamp_seconds("unix_time")).alias("call_date")
    ).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("duration_seconds") >= min_seconds).alias("qualified_calls"),
        S.ratio(F.count_if("answered"), F.count(F.lit(1))).alias("answer_rate"),
    )


def verification(qualified: DataFrame, daily: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Qualified calls per platform conversion, and spend per qualified call."""
    calls = (
        qualified.filter(S.since(F.col("call_date"), as_of, days))
        .groupBy(F.col("account_id").cast("string").alias("account_id"))
        .agg(F.sum("qualified_calls").alias("qualified_calls"))
    )
    ads = (
        daily.filter(S.since(F.col("snapshot_date"), as_of, days))
        .groupBy("account_id")
        .agg(F.sum("conversions").alias("conversions"),
             F.sum(F.col("spend").cast("decimal(20,6)")).cast("double").alias("spend"))
    )
    return ads.join(calls, "account_id", "left").fillna(0, subset=["qualified_calls"]).select(
        "account_id", "qualified_calls", "conversions", "spend",
        S.ratio(F.col("qualified_calls"), F.col("conversions")).alias("verification_ratio_30d"),
        S.ratio(F.col("spend"), F.col("qualified_calls")).alias("verified_cpa_30d"),
    )


# ---- money left on the table ------------------------------------------------------------------
def budget_capped(spend: DataFrame, budgets: DataFrame, near: float = 0.95) -> DataFrame:
    """Campaign days whose spend reaches (almost) the daily budget."""
    out = spend.join(budgets, "campaign_id").withColumn("used", S.ratio(F.col("spend"), F.col("daily_budget")))
    return out.filter(F.col("used") >= near)


def upsell_headroom(state: DataFrame, snapshot: DataFrame, haircut: float = 0.5) -> DataFrame:
    """Efficient accounts short of volume, ranked by spend lost to budget after a haircut."""
    want = state.filter(F.col("verdict_family") == "volume_fail_upsell").select("account_id")
    score = F.col("lost_is_budget") * F.col("verified_cpa") * F.lit(1.0 - haircut)
    return snapshot.join(want, "account_id", "left_semi").withColumn("headroom", score).orderBy(
        F.desc_nulls_last("headroom"), "account_id"
    )
