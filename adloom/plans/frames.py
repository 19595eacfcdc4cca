"""Domain tables derived from the given star-schema tables.

Each frame is a projection or join of whole input tables; `plans.oracle` states the same
derivations in SQL. Attributes come from integer arithmetic on keys so that hard cases occur:
NULL callers, unreadable hours, dashed and blank ids, silent accounts, withdrawn edits.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adloom.operators import attribution, budget, calls as call_ops, leads, spend as spend_ops
from adloom.schemas import INPUT
from adloom.sources.tables import read_table

AS_OF = "2024-01-31"
NOW = "2024-01-31 12:00:00"
SHIFT_DAYS = 8123  # aligns ship dates with the event calendar
PACING_YEAR = 1998
PACING_MONTH = 6

CHANNEL_OF_PRIORITY = {
    "1-URGENT": "google_ads", "2-HIGH": "meta", "3-MEDIUM": "bing", "4-NOT SPECIFIED": "nextdoor", "5-LOW": "lsa",
}


def pick(col: Column, values: dict) -> Column:
    """Literal map lookup: one reference to the key however many values there are."""
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[col]


def money(col: str) -> Column:
    return F.col(col).cast("decimal(12,2)")


def client_name(key: str) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(F.col(key).cast("string"), 9, "0"))


class Frames:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        self.as_of = F.to_date(F.lit(AS_OF))
        self.now = F.to_timestamp(F.lit(NOW))

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.dir, name, INPUT[name])

    # ---- calls -------------------------------------------------------------------------
    @cached_property
    def ctm_calls(self) -> DataFrame:
        pages = self.table("pages").select(F.col("page_id").alias("k"), "url")
        ev = self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
        ev = ev.join(pages, "k", "left")
        k, n = F.col("k"), F.col("event_id")
        other = F.col("user_id") % 10 == 9
        mark = F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
        tagged = (
            F.when(~other & (k % 5 == 0), F.concat("url", mark, F.lit("gclid=AbC"), k.cast("string")))
            .when(~other & (k % 11 == 3), F.concat("url", mark, F.lit("msclkid=M"), k.cast("string")))
            .otherwise(F.col("url"))
        )
        status = (
            F.when((F.col("event_type") == "signup") & (k % 7 == 0), F.lit(None))
            .when(F.col("event_type") == "error", F.lit("queued"))
            .when(F.col("event_type") == "view", F.lit("no answer"))
            .otherwise(F.lit("answered"))
        )
        return ev.select(
            n.alias("id"),
            F.col("user_id").alias("account_id"),
            (F.col("ts") - F.make_dt_interval((n % 6 * 31).cast("int"))).alias("called_at_ts"),
            F.when(n % 37 == 0, F.lit("n/a"))
            .otherwise(F.date_format(F.col("ts") - F.expr("interval 6 hours"), "ha"))
            .alias("hour"),
            F.when(k % 29 != 0, F.concat(F.lit("555"), F.lpad(k.cast("string"), 7, "0"))).alias("caller_number_bare"),
            F.concat(F.lit("T"), (k % 10).cast("string")).alias("tracking_number_id"),
            F.lit("inbound").alias("direction"),
            (F.floor("value") + 10).cast("int").alias("duration"),
            F.floor("value").cast("int").alias("talk_time"),
            (k % 30).cast("int").alias("ring_time"),
            status.alias("call_status"),
            F.concat(F.lit("A"), (F.col("user_id") % 5).cast("string")).alias("agent_id"),
            F.concat(F.lit("Agent "), (F.col("user_id") % 5).cast("string")).alias("agent_name"),
            (k % 2 == 0).alias("is_new_caller"),
            (k % 50 == 7).alias("excluded"),
            F.concat(F.lit("GA1."), k.cast("string")).alias("ga_cid"),
            F.when(other, F.lit("Yelp"))
            .otherwise(pick((k % 12).cast("int"), {
                0: "Google Call Asset", 1: "Google Business Profile - Main", 2: "Google Ads", 3: "Google Organic",
                4: "Bing Paid", 5: "Nextdoor", 6: "Meta Ads", 7: "Yelp",
            })).alias("source"),
            F.when(other, F.lit("referral"))
            .otherwise(pick((k % 9).cast("int"), {
                0: "cpc", 1: "CPC", 2: "organic", 3: "organic", 4: "paid", 5: "paid_nextdoor",
                6: "Streaming TV", 7: "referral", 8: "(none)",
            })).alias("medium"),
            F.when(other, F.lit("(direct)"))
            .otherwise(pick((k % 7).cast("int"), {0: "google", 1: "Google", 2: "bing", 3: "meta", 4: "(direct)", 5: ""}))
            .alias("web_source"),
            F.when(k % 13 != 0, tagged).alias("landing_page"),
            tagged.alias("last_url"),
            pick((k % 3).cast("int"), {0: "mobile", 1: "desktop"}).alias("device_type"),
            F.concat(F.lit("City "), (k % 20).cast("string")).alias("city"),
            F.concat(F.lit("S"), (k % 7).cast("string")).alias("state"),
            F.lpad((k * 101).cast("string"), 5, "0").alias("postal_code"),
            F.when(F.col("value") < 30, F.lit("")).when(k % 4 == 0, F.lit(None)).otherwise(F.lit("hello"))
            .alias("transcription_text"),
            pick((k % 6).cast("int"), {0: "closed, vip", 1: "new customer", 2: "spam", 3: "disclosed", 5: "vip"}).alias("tag_list"),
            F.col("ts").alias("_pipeline_loaded_at"),
        )

    @cached_property
    def mapping(self) -> DataFrame:
        nation = self.table("nation").withColumnRenamed("n_nationkey", "c_nationkey")
        c = self.table("customer").join(nation, "c_nationkey")
        key, bal = F.col("c_custkey"), F.col("c_acctbal")
        text = key.cast("string")
        zips = [
            F.lpad((key * 7 % 100000).cast("string"), 5, "0"),
            F.lpad(((key * 7 + 7) % 100000).cast("string"), 5, "0"),
        ]
        return c.select(
            F.concat(F.lit("M"), text).alias("monday_item_id"),
            F.col("c_name").alias("client_name"),
            key.alias("ctm_account"),
            F.when(key % 41 == 40, F.lit("")).when(key % 43 == 42, F.concat(text, F.lit("-0"))).otherwise(text)
            .alias("google_ads_customer_id"),
            F.col("c_mktsegment").alias("vertical"),
            F.when(bal < 3000, F.lit("small")).otherwise(F.lit("large")).alias("city_size"),
            F.col("n_name").alias("state"),
            F.when(key % 17 == 16, F.lit(None))
            .when(key % 5 == 0, F.concat(zips[0], F.lit(", "), zips[1], F.lit(", 20-mile radius")))
            .when(key % 5 == 1, F.concat(zips[0], F.lit(","), zips[0]))
            .otherwise(F.concat_ws(", ", *zips)).alias("main_locations_zips"),
            F.when(key % 5 == 0, F.lit("2023-10-15")).alias("client_start_date"),
            F.when(key % 13 != 12, F.col("n_name")).alias("account_manager"),
            F.when(bal < 0, F.lit("Tier 3")).when(bal < 5000, F.lit("Tier 2")).otherwise(F.lit("Tier 1")).alias("tier"),
            F.concat(F.lit("MCC-"), F.col("n_regionkey").cast("string")).alias("sub_mcc"),
            F.when(bal < 0, F.lit("No")).when(bal < 2500, F.lit("AV Approved")).when(bal < 5000, F.lit("In Progress"))
            .when(bal < 7500, F.lit("Stuck")).alias("av_status"),
        )

    @cached_property
    def attributed(self) -> DataFrame:
        return attribution.calls_attribution(self.ctm_calls, self.mapping)

    @cached_property
    def calls_daily(self) -> DataFrame:
        return call_ops.calls_daily(self.attributed)

    @cached_property
    def calls_heatmap(self) -> DataFrame:
        return call_ops.calls_heatmap(self.attributed)

    # ---- spend -------------------------------------------------------------------------
    @cached_property
    def line_spend(self) -> DataFrame:
        """One spend row per line item, before any aggregation."""
        flag = F.concat("l_returnflag", "l_linestatus")
        return self.table("lineitem").select(
            F.date_add(F.to_date("l_shipdate"), SHIFT_DAYS).alias("date"),
            F.to_date("l_shipdate").alias("ship_date"),
            F.col("l_suppkey").cast("string").alias("customer_id"),
            client_name("l_suppkey").alias("account_name"),
            F.col("l_partkey").alias("campaign_id"),
            pick(flag, {"RF": "google_ads", "RO": "google_ads", "AF": "meta", "AO": "lsa", "NF": "nextdoor", "NO": "bing"})
            .alias("channel"),
            (money("l_extendedprice") * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)")))
            .alias("spend"),
            F.col("l_quantity").alias("conversions"),
        )

    @cached_property
    def spend_unified(self) -> DataFrame:
        """client x channel x day actuals on the shifted calendar."""
        return self.line_spend.groupBy("date", F.col("account_name").alias("client"), "channel").agg(
            F.sum("spend").alias("actual")
        )

    @cached_property
    def spend_combined(self) -> DataFrame:
        platform = pick(F.col("channel"), {"google_ads": "Google", "lsa": "Google LSA"})
        return self.line_spend.select(
            "customer_id",
            F.coalesce(platform, F.col("channel")).alias("platform"),
            F.col("date").alias("spend_date"),
            "spend",
        )

    @cached_property
    def conversion_stats(self) -> DataFrame:
        return self.line_spend.select(
            F.col("customer_id").cast("bigint").alias("customer_id"),
            F.col("date").alias("segments_date"),
            F.col("conversions").alias("metrics_conversions"),
        )

    @cached_property
    def zips(self) -> DataFrame:
        """ZIP centroids; the ZIPs of overdrawn customers have none."""
        code = F.col("c_custkey") * 7 % 100000
        return (
            self.table("customer").filter("c_acctbal >= 0").select(code.alias("z")).distinct().select(
                F.lpad(F.col("z").cast("string"), 5, "0").alias("zip_code"),
                (F.col("z") / 1000.0).cast("double").alias("internal_point_lat"),
                (F.col("z") / -500.0).cast("double").alias("internal_point_lon"),
            )
        )

    @cached_property
    def cpl_rows(self) -> DataFrame:
        return leads.cost_per_lead(self.spend_unified, self.attributed, self.mapping, self.as_of, 6)

    # ---- budgets -----------------------------------------------------------------------
    @cached_property
    def order_cells(self) -> DataFrame:
        key = F.col("o_orderkey")
        uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(key.cast("string"), 12, "0"))
        kind = (
            F.when(F.col("o_totalprice") > 450000, F.lit("delete"))
            .when(F.col("o_orderstatus") == "O", F.lit("create")).otherwise(F.lit("update"))
        )
        return self.table("orders").select(
            key.alias("order_key"),
            "o_orderstatus",
            uuid.alias("event_id"),
            client_name("o_custkey").alias("client"),
            pick(F.col("o_orderpriority"), CHANNEL_OF_PRIORITY).alias("channel"),
            F.year("o_orderdate").alias("year"),
            F.month("o_orderdate").alias("month"),
            money("o_totalprice").alias("amount"),
            F.lit(None).cast("string").alias("alloc_type"),
            kind.alias("event_type"),
            F.concat(F.lit("user"), (F.col("o_custkey") % 20).cast("string"), F.lit("@example.com")).alias("changed_by"),
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (key % 86400).cast("decimal(18,6)")))
            .alias("changed_at"),
            F.concat(F.lit("note "), F.col("o_orderpriority")).alias("note"),
        )

    @cached_property
    def budget_events(self) -> DataFrame:
        return self.order_cells.filter("o_orderstatus <> 'F'").select(*budget.HISTORY_COLUMNS)

    @cached_property
    def tombstones(self) -> DataFrame:
        """Edits below a minimum amount were withdrawn."""
        return self.order_cells.filter("o_orderstatus <> 'F' AND amount < 20000").select(
            "event_id", F.lit("admin@example.com").alias("deleted_by"),
            (F.col("changed_at") + F.expr("interval 1 day")).alias("deleted_at"),
        )

    @cached_property
    def sheet(self) -> DataFrame:
        """The base sheet: year and month are text there."""
        return self.order_cells.filter("o_orderstatus = 'F'").select(
            "client", "channel", F.col("year").cast("string").alias("year"),
            F.col("month").cast("string").alias("month"), "amount",
        )

    @cached_property
    def sheet_typed(self) -> DataFrame:
        from adloom.sources.sheets import read_committed_sheet

        return read_committed_sheet(self.sheet)

    @cached_property
    def base_current(self) -> DataFrame:
        return budget.budget_base_current(self.budget_events, self.tombstones, self.sheet_typed)

    @cached_property
    def committed(self) -> DataFrame:
        return self.order_cells.select("client", "channel", "year", "month", "amount")

    @cached_property
    def spend_months_daily(self) -> DataFrame:
        """client x channel x day on the unshifted calendar, for pacing."""
        return self.line_spend.groupBy(
            F.col("ship_date").alias("date"), F.col("account_name").alias("client"), "channel"
        ).agg(F.sum("spend").alias("actual"))

    @cached_property
    def actual_months(self) -> DataFrame:
        return spend_ops.actual_spend_all(self.spend_months_daily)

    @cached_property
    def pacing(self) -> DataFrame:
        from adloom.operators.pacing import pacing_api

        return pacing_api(self.committed, self.actual_months, PACING_YEAR)

    @cached_property
    def crosswalk(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").filter("c_acctbal >= -500").select(
            key.cast("string").alias("customer_id"),
            F.col("c_name").alias("canonical_client"),
            F.concat(F.lit("Manager "), F.col("c_nationkey").cast("string")).alias("account_manager"),
            F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Other")).otherwise(F.lit("Main")).alias("source_group"),
            (F.col("c_acctbal") > 0).alias("active"),
        )

    @cached_property
    def feeds(self) -> dict[str, DataFrame]:
        cols = spend_ops.FEED_COLUMNS
        out = {
            ch: self.line_spend.filter(F.col("channel") == ch).select(*[c for c in cols if c != "channel"])
            for ch in ("google_ads", "lsa", "meta", "nextdoor")
        }
        # the sheet of other channels still repeats some rows served by a feed of their own
        out["other"] = self.line_spend.filter(F.col("channel").isin("bing", "lsa")).select(*cols)
        return out

    # ---- campaign health ----------------------------------------------------------------
    @cached_property
    def campaigns(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            (key % 97).alias("customer_id"),
            key.alias("campaign_id"),
            F.concat_ws(" ", "p_name", "p_type").alias("campaign_name"),
            F.when(F.col("p_type") == "SMALL", F.lit("PAUSED")).otherwise(F.lit("ENABLED")).alias("campaign_status"),
            F.when(F.col("p_type") == "PROMO", F.lit("SUSPENDED")).otherwise(F.lit("SERVING"))
            .alias("campaign_serving_status"),
            F.when(F.col("p_brand") == "Brand#3", F.lit("LOCAL_SERVICES"))
            .when(F.col("p_brand") != "Brand#5", F.lit("SEARCH")).alias("campaign_advertising_channel_type"),
            F.when(F.col("p_size") > 45, F.date_sub(self.as_of, 1)).otherwise(self.as_of).alias("_DATA_DATE"),
            self.as_of.alias("_LATEST_DATE"),
        )

    @cached_property
    def ads(self) -> DataFrame:
        return self.table("lineitem").select(
            (F.col("l_partkey") % 97).alias("customer_id"),
            F.col("l_partkey").alias("campaign_id"),
            pick(F.col("l_returnflag"), {"R": "DISAPPROVED", "A": "APPROVED", "N": "APPROVED_LIMITED"})
            .alias("ad_group_ad_policy_summary_approval_status"),
            F.when(F.col("l_linestatus") == "O", self.as_of).otherwise(F.date_sub(self.as_of, 1)).alias("_DATA_DATE"),
            self.as_of.alias("_LATEST_DATE"),
        )

    @cached_property
    def ad_policy(self) -> DataFrame:
        key = F.col("l_partkey")
        return self.table("lineitem").select(
            F.when(F.col("l_linestatus") == "O", self.as_of).otherwise(F.date_sub(self.as_of, 1)).alias("snapshot_date"),
            (key % 97).cast("string").alias("customer_id"),
            key.cast("string").alias("campaign_id"),
            F.concat(F.lit("Campaign "), key.cast("string")).alias("campaign_name"),
            F.col("l_suppkey").cast("string").alias("ad_group_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ad_id"),
            pick(F.col("l_returnflag"), {"R": "DISAPPROVED", "A": "APPROVED_LIMITED", "N": "APPROVED"})
            .alias("approval_status"),
            F.lit("REVIEWED").alias("review_status"),
            pick(F.col("l_linenumber"), {
                1: "DESTINATION_NOT_WORKING", 2: "DESTINATION_NOT_ACCESSIBLE",
                3: "DESTINATION_NOT_WORKING,MISLEADING_CONTENT", 4: "TRADEMARKS",
                6: "DESTINATION_NOT_ACCESSIBLE,DESTINATION_NOT_WORKING", 7: "ALCOHOL",
            }).alias("policy_topics"),
        )

    @cached_property
    def call_assets(self) -> DataFrame:
        return self.table("orders").select(
            F.when(F.col("o_orderstatus") == "O", self.as_of).otherwise(F.date_sub(self.as_of, 1)).alias("snapshot_date"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("o_orderkey").cast("string").alias("asset_id"),
            F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("+1"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")))
            .alias("phone_number"),
            F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("DISAPPROVED")).otherwise(F.lit("APPROVED"))
            .alias("approval_status"),
        )

    @cached_property
    def billing(self) -> DataFrame:
        return self.table("customer").select(
            F.when(F.col("c_acctbal") >= 0, self.as_of).otherwise(F.date_sub(self.as_of, 1)).alias("snapshot_date"),
            F.col("c_custkey").cast("string").alias("customer_id"),
            pick(F.col("c_mktsegment"), {"BUILDING": "APPROVED", "MACHINERY": "CANCELLED", "FURNITURE": "UNKNOWN",
                                         "AUTOMOBILE": "APPROVED"}).alias("billing_setup_status"),
            F.when(F.col("c_nationkey") == 3, F.lit("PENDING")).when(F.col("c_nationkey") != 4, F.lit("APPROVED"))
            .alias("account_budget_status"),
        )

    @cached_property
    def pacing_calculations(self) -> DataFrame:
        ratio = F.col("o_totalprice") / 200000.0
        return self.table("orders").select(
            F.col("o_custkey").cast("string").alias("customer_id"),
            client_name("o_custkey").alias("account_name"),
            pick(F.col("o_orderpriority"), CHANNEL_OF_PRIORITY).alias("platform"),
            ratio.alias("pacing_ratio"),
            F.col("o_totalprice").alias("forecast_eom"),
            F.lit(200000.0).alias("budget"),
            F.when(ratio >= 1.10, F.lit("Overpacing")).when(ratio < 0.9, F.lit("Underpacing"))
            .otherwise(F.lit("On track")).alias("status"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        from adloom.operators import alerts as A

        m, now = self.mapping, self.now
        return A.alerts_active(
            A.campaign_suspended(self.campaigns, m, now),
            A.ads_disapproved(self.campaigns, self.ads, m, now),
            A.overspend(self.pacing_calculations, m, now),
            A.no_spend(self.spend_combined, m, self.as_of, now),
            A.url_disapproved(self.ad_policy, m, now),
            A.phone_disapproved(self.call_assets, m, now),
            A.billing_problem(self.billing, m, now),
        )

    # ---- registries ----------------------------------------------------------------------
    @cached_property
    def standards_log(self) -> DataFrame:
        o = self.order_cells.join(self._customer_of_order, "order_key")
        cust = F.col("cust")
        return o.select(
            F.concat(F.lit("std."), cust.cast("string")).alias("item_id"),
            pick(F.col("channel"), {"google_ads": "Data Connections", "meta": "Targeting", "bing": "Ad Copy",
                                    "nextdoor": "Landing Pages", "lsa": "House rules"}).alias("category"),
            pick(F.col("o_orderstatus"), {"O": "Account", "P": "Campaign", "F": "Widget"}).alias("level"),
            F.concat(F.lit("Item "), (cust % 50).cast("string")).alias("item"),
            F.col("note").alias("position"),
            F.when(F.col("amount") < 250000, F.concat(F.lit("Except "), F.col("channel"))).alias("exception"),
            F.when(F.col("o_orderstatus") == "F", F.lit("pending")).otherwise(F.lit("confirmed")).alias("status"),
            (F.col("order_key") % 10).cast("int").alias("sort_order"),
            (F.col("amount") > 50000).alias("active"),
            F.col("changed_by").alias("edited_by"),
            F.col("changed_at").alias("created_at"),
            "order_key",
        )

    @cached_property
    def _customer_of_order(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust"))

    @cached_property
    def cards_log(self) -> DataFrame:
        return self.standards_log.select(
            F.col("item_id").alias("card_id"),
            pick(F.col("category"), {"Data Connections": "Ad copy", "Targeting": "Geo / scheduling"}).alias("pillar"),
            F.col("exception").alias("topic"),
            F.col("item").alias("title"),
            F.col("position").alias("body"),
            "status",
            F.when(F.col("level") == "Account", F.lit("general")).otherwise(F.lit("brand")).alias("applies_to"),
            "active",
            "created_at",
            "order_key",
        )

    @cached_property
    def rules(self) -> DataFrame:
        cust = F.col("o_custkey")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            pick(F.col("o_orderstatus"), {"O": "account", "P": "campaign", "F": "ad_group"}).alias("level"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("status_id"),
            F.concat(F.lit("Rule "), cust.cast("string")).alias("condition_text"),
            F.when(cust % 3 == 0, F.lit("unless new")).alias("exception_text"),
            F.when(cust % 2 == 0, F.lit("all")).otherwise(F.lit("any")).alias("match"),
            pick(F.col("o_orderpriority"), {"1-URGENT": "brand", "2-HIGH": "service"}).alias("campaign_type"),
        )

    @cached_property
    def conditions(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("rule_id"),
            F.col("l_linenumber").alias("position"),
            (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("id"),
            pick(F.col("l_returnflag"), {"R": "ctr", "A": "cvr", "N": "spend"}).alias("metric"),
            pick(F.col("l_linenumber"), {1: "gt", 2: "gte", 3: "lt", 4: "lte", 5: "eq", 6: "neq", 7: "between"})
            .alias("operator"),
            F.col("l_quantity").alias("threshold"),
            F.when(F.col("l_linestatus") == "O", F.col("l_quantity") + 10).alias("threshold_high"),
            F.lit("%").alias("unit"),
            F.lit(30).alias("window_days"),
        )

    @cached_property
    def statuses(self) -> DataFrame:
        return self.table("region").select(
            (F.col("r_regionkey") + 1).alias("id"), F.col("r_name").alias("label"),
            F.concat(F.lit("#00000"), F.col("r_regionkey").cast("string")).alias("color"), F.col("r_regionkey").alias("rank"),
        )

    # ---- access --------------------------------------------------------------------------
    @cached_property
    def users_log(self) -> DataFrame:
        o = self.order_cells.join(self._customer_of_order, "order_key")
        cust = F.col("cust")
        return o.select(
            F.concat(F.when(F.col("o_orderstatus") == "O", F.lit("USER")).otherwise(F.lit("User")), cust.cast("string"),
                     F.lit("@example.com")).alias("email"),
            F.concat(F.lit("User "), cust.cast("string")).alias("display_name"),
            F.lit("Analyst").alias("job_title"),
            F.lit("Agency").alias("agency"),
            pick(F.col("channel"), {"google_ads": "admin", "meta": "executive", "bing": "account_manager",
                                    "nextdoor": "analyst", "lsa": "contractor"}).alias("role"),
            (F.col("o_orderstatus") != "F").alias("active"),
            F.when(cust % 3 == 0, F.array(F.lit("budgets.history"), F.lit("kpi.view")))
            .when(cust % 3 == 2, F.array(F.lit("budgets.edit"))).alias("extra_capabilities"),
            F.when(cust % 4 == 0, F.array(F.lit("budgets.view"))).alias("revoked_capabilities"),
            F.col("changed_at").alias("updated_at"),
        )

    @cached_property
    def users(self) -> DataFrame:
        from adloom.operators.access import current_users

        return current_users(self.users_log)

    @cached_property
    def roles(self) -> DataFrame:
        rows = [
            ("admin", ["*"]),
            ("executive", ["budgets.view", "budgets.history", "kpi.view"]),
            ("account_manager", ["budgets.view", "budgets.edit"]),
            ("analyst", ["budgets.view"]),
            ("developer", ["admin.console"]),
            ("client", []),
        ]
        return self.spark.createDataFrame(rows, "role string, capabilities array<string>")

    @cached_property
    def audit_events(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").cast("string").alias("event_id"),
            F.col("event_type").alias("action"),
            F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("target_email"),
            F.col("props").alias("detail"),
            F.lit("admin@example.com").alias("changed_by"),
            F.unix_timestamp(F.col("ts").cast("timestamp")).alias("changed_at"),
        )

    # ---- work items ----------------------------------------------------------------------
    @cached_property
    def tasks(self) -> DataFrame:
        key, price, start = F.col("o_orderkey"), F.col("o_totalprice"), F.to_date("o_orderdate")
        return self.table("orders").select(
            F.concat(F.lit("T"), key.cast("string")).alias("task_id"),
            F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1)).alias("stage"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("stage_order"),
            F.concat(F.when(price > 400000, F.lit("Acceptance ")).otherwise(F.lit("Build ")), key.cast("string")).alias("title"),
            pick((F.col("o_custkey") % 3).cast("int"), {0: "ana", 1: "ben", 2: "team"}).alias("owner"),
            F.when(F.col("o_orderstatus") == "F", F.lit("done")).when(F.col("o_orderstatus") == "O", F.lit("in_progress"))
            .when(price < 100000, F.lit("blocked")).when(price < 150000, F.lit("dropped")).otherwise(F.lit("todo")).alias("status"),
            start.alias("planned_start"),
            F.date_add(start, 14).alias("planned_end"),
            ((price > 300000) & (F.col("o_orderstatus") != "F")).alias("late"),
        )

    @cached_property
    def ticket_items(self) -> DataFrame:
        turn, conv = F.col("turn"), F.col("conv_id")
        none = F.lit(None).cast("string")
        links = lambda *ids: F.array(*[F.struct(i.cast("string").alias("id"), F.lit("c").alias("name")) for i in ids])
        no_links = F.array().cast("array<struct<id:string,name:string>>")

        def value(id, text=none, label=none, index=none, is_done=F.lit(None).cast("boolean"), color=none, date=none, linked=no_links):
            return F.struct(id.alias("id"), text.alias("text"), label.alias("label"), index.alias("index"), is_done.alias("is_done"),
                            color.alias("color"), date.alias("date"), linked.alias("linked_items"))

        label = pick((turn % 4).cast("int"), {0: "Open", 1: "Working", 3: "Done"})
        return self.table("conversations").select(
            (conv * 1000 + turn).alias("id"),
            F.concat(F.lit("Ticket "), conv.cast("string")).alias("name"),
            F.col("role").alias("board_id"),
            F.array(
                value(F.concat(F.lit("client_"), F.col("role")), linked=links(conv % 50, conv % 7)),
                value(F.concat(F.lit("status_"), F.col("role")), text=F.lit("Stuck"), label=label,
                      index=turn.cast("string"), is_done=(turn % 4 == 3), color=F.when(turn % 5 != 0, F.lit("#00ff00"))),
                value(F.lit("date4"), date=F.when(turn % 3 != 0, F.concat(F.lit("2024-02-0"), (turn % 9 + 1).cast("string")))),
            ).alias("column_values"),
        )

    @cached_property
    def boards(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(r, f"Board {r}", f"client_{r}", f"status_{r}", f"https://tickets.example.com/{r}/") for r in ("user", "assistant", "system")],
            "board_id string, board_name string, client_col string, status_col string, url_prefix string",
        )

    @cached_property
    def done_statuses(self) -> DataFrame:
        return self.spark.createDataFrame([("user", "4"), ("assistant", "1"), ("assistant", "5"), ("system", "0")],
                                          "board_id string, status_index string")

    @cached_property
    def campaign_weeks(self) -> DataFrame:
        """Weekly campaign statistics with the previous available week's conversions."""
        from pyspark.sql import Window

        weekly = self.line_spend.groupBy(
            F.col("customer_id").cast("bigint").alias("campaign"), F.trunc("date", "week").alias("week")
        ).agg(
            (F.sum("spend").cast("double") / 100).alias("cost"),
            F.count_if(F.col("channel") == "google_ads").alias("conv"),
            F.sum("conversions").cast("bigint").alias("clicks"),
        )
        w = Window.partitionBy("campaign").orderBy("week")
        return weekly.select(
            "*", pick((F.col("campaign") % 3).cast("int"), {0: 200.0, 1: 500.0, 2: 800.0}).alias("bench"),
            F.lag("conv").over(w).alias("prev_conv"),
        )

    # ---- landed responses ----------------------------------------------------------------
    @cached_property
    def social_accounts(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").cast("string").alias("account_id"), F.col("s_name").alias("name"),
            F.when(F.col("s_acctbal") > 0, F.lit(1)).otherwise(F.lit(2)).alias("account_status"),
        )

    @cached_property
    def insights(self) -> DataFrame:
        """Campaign-day records as parsed from landed JSON text."""
        from adloom.sources.landed import INSIGHT_SCHEMA

        raw = self.line_spend.filter("channel = 'meta'").select(F.to_json(F.struct(
            F.col("customer_id").alias("account_id"),
            F.concat(F.lit("Campaign "), F.col("campaign_id").cast("string")).alias("campaign_name"),
            F.col("date").cast("string").alias("date_start"),
            F.when(F.col("conversions") > 3, F.col("spend").cast("decimal(12,2)").cast("string")).alias("spend"),
        )).alias("value"))
        return raw.select(F.from_json("value", INSIGHT_SCHEMA).alias("r")).select("r.*")

    @cached_property
    def advertisers(self) -> DataFrame:
        zone = pick(F.col("s_nationkey"), {1: "America/Chicago", 2: "America/Los_Angeles", 3: "Asia/Tokyo", 4: "Mars/Base"})
        return self.table("supplier").select(
            F.col("s_suppkey").cast("string").alias("advertiser_id"), F.col("s_name").alias("name"), F.lit("USD").alias("currency"),
            F.when(F.col("s_acctbal") < 0, F.lit("NO_ACCESS")).when(F.col("s_acctbal") < 5000, F.lit("ADMIN")).alias("role"),
            zone.alias("timezone"),
        )

    @cached_property
    def zones(self) -> DataFrame:
        names = ["America/New_York", "America/Chicago", "America/Los_Angeles", "Asia/Tokyo", "UTC"]
        return self.spark.createDataFrame([(z,) for z in names], "zone string")

    @cached_property
    def advertiser_stats(self) -> DataFrame:
        """Account-day statistics with money as text, as landed."""
        from adloom.sources.landed import STATS_SCHEMA

        daily = self.line_spend.filter("channel = 'nextdoor'").groupBy("customer_id", "date").agg(
            F.sum("spend").alias("spend"), F.sum("conversions").cast("bigint").alias("q"), F.count(F.lit(1)).alias("n"))
        usd = lambda c: F.concat(F.lit("USD "), c.cast("string"))
        raw = daily.select(
            F.col("customer_id").alias("advertiser_id"), F.col("date").cast("string").alias("report_date"),
            F.to_json(F.struct(
                F.when(F.col("q") < 5, F.lit("n/a")).otherwise(usd(F.col("spend"))).alias("billable_spend"),
                F.when(F.col("q") > 10, F.col("q") * 10).alias("impressions"),
                F.when(F.col("q") > 3, F.col("q")).alias("clicks"),
                usd(F.col("n")).alias("cpc"), F.lit("").alias("cpm"), F.col("n").alias("total_conversions"),
            )).alias("value"))
        return raw.select("advertiser_id", "report_date", F.from_json("value", STATS_SCHEMA).alias("r")).select(
            "advertiser_id", "report_date", "r.*")

    @cached_property
    def policy_records(self) -> DataFrame:
        topics = F.when(F.col("l_linenumber") == 1, F.array(F.lit("DESTINATION_NOT_WORKING"), F.lit(None).cast("string"), F.lit("ALCOHOL"))) \
            .when(F.col("l_linenumber") == 2, F.array().cast("array<string>")).when(F.col("l_linenumber") < 6, F.array(F.lit("TRADEMARKS")))
        return self.table("lineitem").select(
            (F.col("l_partkey") % 97).alias("customer_id"), F.col("l_partkey").alias("campaign_id"),
            F.concat(F.lit("Campaign "), F.col("l_partkey").cast("string")).alias("campaign_name"),
            F.col("l_suppkey").alias("ad_group_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ad_id"),
            pick(F.col("l_returnflag"), {"R": "DISAPPROVED", "A": "APPROVED_LIMITED", "N": "APPROVED"}).alias("approval_status"),
            F.lit("REVIEWED").alias("review_status"),
            F.when(F.col("l_linestatus") == "O", F.lit("ENABLED")).otherwise(F.lit("PAUSED")).alias("campaign_status"),
            topics.alias("topics"),
        )

    # ---- diagnosis -----------------------------------------------------------------------
    @cached_property
    def campaign_stats(self) -> DataFrame:
        s = self.line_spend
        kind = F.when((F.col("channel") == "lsa"), F.lit("LOCAL_SERVICES")).otherwise(F.lit("SEARCH"))
        brand = F.when(F.col("channel").isin("google_ads", "meta"), F.lit("Brand ")).otherwise(F.lit("Service "))
        return s.select(
            F.col("date").alias("segments_date"), "customer_id",
            kind.alias("campaign_advertising_channel_type"),
            F.concat(brand, F.col("campaign_id").cast("string")).alias("campaign_name"),
            (F.col("spend") * 1000000).cast("bigint").alias("metrics_cost_micros"),
            F.col("conversions").cast("bigint").alias("metrics_clicks"),
            (F.col("conversions") * 20 + F.col("campaign_id") % 50).cast("bigint").alias("metrics_impressions"),
            F.when(F.col("conversions") > 25, 2).when(F.col("conversions") > 10, 1).otherwise(0).cast("bigint")
            .alias("metrics_conversions"),
        )

    @cached_property
    def account_daily(self) -> DataFrame:
        from adloom.operators.diagnosis import account_type_daily

        return account_type_daily(self.campaign_stats)

    @cached_property
    def account_30d(self) -> DataFrame:
        from adloom.operators.diagnosis import account_type_window

        return account_type_window(self.account_daily, self.as_of, 30)

    @cached_property
    def search_terms(self) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("term"))
        li = self.table("lineitem").join(part, "l_partkey")
        return li.select(
            F.col("l_suppkey").cast("string").alias("account_id"),
            F.when(F.col("l_linestatus") == "O", F.lit("brand")).otherwise(F.lit("service")).alias("campaign_type"),
            F.date_add(F.to_date("l_shipdate"), SHIFT_DAYS).alias("spend_date"),
            "term",
            (F.col("l_linenumber") != 4).alias("term_visible"),
            pick(F.col("l_returnflag"), {"R": "irrelevant", "A": "relevant", "N": "review"}).alias("relevance_class"),
            F.when(F.col("l_tax") < 0.035, F.lit("relevant")).otherwise(F.lit("irrelevant")).alias("audited_class"),
            F.when(F.col("l_discount") > 0.08, F.lit("nonconverting_pooled")).alias("geo_flag"),
            F.when(F.col("l_tax") > 0.06, F.lit("nonconverting_pooled")).alias("hour_flag"),
            (money("l_extendedprice") * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)"))).alias("spend"),
            F.col("l_quantity").cast("bigint").alias("clicks"),
            (F.col("l_quantity") * 30).cast("bigint").alias("impressions"),
            F.when(F.col("l_quantity") > 40, 1).otherwise(0).cast("bigint").alias("conversions"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ad_id"),
            pick(F.col("l_linenumber"), {1: "EXCELLENT", 2: "GOOD", 3: "AVERAGE", 4: "POOR", 5: "PENDING"}).alias("ad_strength"),
            F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("quality_score"),
        )

    @cached_property
    def negatives(self) -> DataFrame:
        """Every account blocks the same few phrases as its nation's accounts."""
        words = pick((F.col("s_nationkey") % 5).cast("int"), {0: "Ring", 1: "red widget", 2: "widget  promo", 3: "in"})
        return self.table("supplier").select(
            F.col("s_suppkey").cast("string").alias("account_id"), F.coalesce(words, F.lit("blue bolt small")).alias("keyword"))

    @cached_property
    def phone_log(self) -> DataFrame:
        return self.table("events").select(
            (F.col("user_id")).alias("account_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("unix_time"),
            F.floor("value").cast("int").alias("duration_seconds"), (F.col("event_type") != "view").alias("answered"))

    @cached_property
    def diagnosis_rules(self) -> DataFrame:
        """One rule per nation row, spread over the stages."""
        return self.table("nation").select(
            F.col("n_nationkey").alias("rule_id"),
            pick(F.col("n_regionkey"), {0: "eligible", 1: "visible", 2: "compelling", 3: "relevant", 4: "converting"}).alias("stage"),
            F.when(F.col("n_nationkey") % 2 == 0, F.lit("all")).otherwise(F.lit("any")).alias("match"),
            F.lit(0.1).alias("warn_pct"),
            F.when(F.col("n_nationkey") % 3 == 0, F.lit("impressions")).alias("floor_metric"),
            F.lit(1200.0).alias("floor_value"))

    @cached_property
    def diagnosis_conditions(self) -> DataFrame:
        key = F.col("n_nationkey")
        one = lambda m, o, lo, hi: F.struct(F.lit(m).alias("metric"), F.lit(o).alias("operator"), lo.alias("threshold"), hi.alias("threshold_high"))
        both = F.array(
            one("ctr", "lt", key * 0.0005 + 0.04, F.lit(None).cast("double")),
            F.when(key % 2 == 0, one("cvr", "lte", key * 0.002 + 0.02, F.lit(None).cast("double")))
            .otherwise(one("platform_cpa", "between", key * 1000.0, key * 1000.0 + 4000)),
        )
        return self.table("nation").select(key.alias("rule_id"), F.inline(both))

    @cached_property
    def verdicts(self) -> DataFrame:
        from adloom.operators import verdicts as V

        metrics = V.long_metrics(self.account_30d, ["ctr", "cvr", "platform_cpa", "impressions"])
        own = self.table("supplier").filter("s_acctbal > 8000").select(
            F.col("s_suppkey").cast("string").alias("account_id"), F.lit(0).alias("rule_id"), F.lit("ctr").alias("metric"),
            F.lit(0.2).alias("threshold"))
        return V.evaluate_rules(metrics, self.diagnosis_rules, self.diagnosis_conditions, own)

    @cached_property
    def changes(self) -> DataFrame:
        """Change windows: one per order of the account, two weeks long."""
        day = F.date_add(F.to_date("o_orderdate"), SHIFT_DAYS)
        return self.table("orders").select(
            F.col("o_orderkey").alias("change_id"),
            (F.col("o_custkey") % 100).cast("string").alias("account_id"),
            F.when(F.col("o_orderstatus") == "O", F.lit("ctr")).otherwise(F.lit("spend")).alias("target_metric"),
            F.concat(F.lit("user"), (F.col("o_custkey") % 20).cast("string")).alias("changed_by"),
            day.alias("change_date"), day.alias("window_opens"), F.date_add(day, 13).alias("window_closes"))
