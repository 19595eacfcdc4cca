"""Declared schemas: the given input tables and the maintained domain tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

# given tables; timestamps carry no zone there
INPUT = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# maintained tables
DOMAIN = {
    "social_spend_daily": "account_name string, customer_id string, campaign string, date date, "
                          "cost decimal(38,9), channel string",
    "advertiser_spend_daily": "report_date date not null, advertiser_id string not null, advertiser_name string, "
                              "currency_code string, billable_spend decimal(38,9), impressions bigint, clicks bigint, "
                              "ctr double, cpc decimal(38,9), cpm decimal(38,9), total_conversions bigint, "
                              "lead_conversions bigint, load_timestamp timestamp",
    "ad_policy": "snapshot_date date not null, customer_id string not null, campaign_id string, campaign_name string, "
                 "ad_group_id string, ad_id string not null, approval_status string, review_status string, "
                 "policy_topics string",
    "call_assets": "snapshot_date date not null, customer_id string not null, asset_id string not null, "
                   "phone_number string, approval_status string",
    "billing": "snapshot_date date not null, customer_id string not null, billing_setup_status string, "
               "account_budget_status string",
    "budget_events": "event_id string, client string, channel string, year int, month int, amount decimal(38,9), "
                     "alloc_type string, event_type string, changed_by string, changed_at timestamp, note string",
    "event_tombstones": "event_id string, deleted_by string, deleted_at timestamp",
    "audit_events": "event_id string, action string, target_email string, detail string, changed_by string, "
                    "changed_at timestamp",
}

REQUIRED = {
    "advertiser_spend_daily": ["report_date", "advertiser_id"],
    "ad_policy": ["snapshot_date", "customer_id", "ad_id"],
    "call_assets": ["snapshot_date", "customer_id", "asset_id"],
    "billing": ["snapshot_date", "customer_id"],
}


def input_schema(name: str) -> StructType:
    return StructType.fromDDL(INPUT[name])


def domain_schema(name: str) -> StructType:
    return StructType.fromDDL(DOMAIN[name])
