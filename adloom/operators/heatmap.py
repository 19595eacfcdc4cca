"""Client x ZIP map with account-level spend, conversions and cost per acquisition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adloom.functions import scalars as S
from adloom.operators.spend import conversions_trailing, spend_trailing


def client_zips(mapping: DataFrame) -> DataFrame:
    """One row per listed ZIP; anything that is not exactly five digits is prose and drops out."""
    return (
        mapping.filter(F.col("main_locations_zips").isNotNull())
        .select(
            "client_name",
            "vertical",
            F.col("state").alias("primary_state"),
            S.normalize_id(F.col("google_ads_customer_id")).alias("cid"),
            F.explode(F.split("main_locations_zips", ",")).alias("zip"),
        )
        .withColumn("zip", F.trim("zip"))
        .filter(F.col("zip").rlike(r"^\d{5}$"))
    )


def zip_footprint(geo: DataFrame) -> DataFrame:
    return geo.groupBy("cid").agg(F.count_distinct("zip").alias("zip_count"))


def client_heatmap(
    mapping: DataFrame, spend: DataFrame, conversions: DataFrame, zips: DataFrame, as_of: Column, now: Column
) -> DataFrame:
    """Left joins throughout: a NULL account id matches nothing but keeps its rows."""
    geo = client_zips(mapping)
    spent = spend_trailing(spend, as_of, 90).filter(F.col("cid").isNotNull())
    won = conversions_trailing(conversions, as_of, 90).filter(F.col("cid").isNotNull())
    points = zips.select(
        F.col("zip_code").alias("zip"),
        F.col("internal_point_lat").alias("lat"),
        F.col("internal_point_lon").alias("lng"),
    )
    return (
        geo.join(zip_footprint(geo), "cid", "left")
        .join(spent, "cid", "left")
        .join(won, "cid", "left")
        .join(points, "zip", "left")
        .select(
            "client_name",
            F.col("cid").alias("google_ads_customer_id"),
            "zip",
            "vertical",
            "primary_state",
            "lat",
            "lng",
            F.col("spend_90d").cast("double").alias("spend_90d"),
            F.col("conversions_90d").cast("double").alias("conversions_90d"),
            S.ratio(F.col("spend_90d"), F.col("conversions_90d")).alias("cpa_90d"),
            "zip_count",
            now.alias("view_refreshed_at"),
        )
    )


def heatmap_row_count(heatmap: DataFrame) -> DataFrame:
    return heatmap.agg(F.count(F.lit(1)).alias("row_count"))


def ungeocoded(heatmap: DataFrame) -> DataFrame:
    return heatmap.filter(F.col("lat").isNull()).select("client_name", "zip").orderBy("client_name")


def without_metrics(heatmap: DataFrame) -> DataFrame:
    return (
        heatmap.filter(F.col("spend_90d").isNull())
        .select("client_name", "google_ads_customer_id")
        .distinct()
        .orderBy("client_name")
    )


def cpa_by_client(heatmap: DataFrame) -> DataFrame:
    """A client's rows share one account, so any of them carries its metrics."""
    return (
        heatmap.groupBy("client_name")
        .agg(
            F.max("spend_90d").alias("spend_90d"),
            F.max("conversions_90d").alias("conv_90d"),
            F.max("cpa_90d").alias("cpa_90d"),
        )
        .orderBy(F.desc_nulls_last("cpa_90d"))
    )
