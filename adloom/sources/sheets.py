"""Spreadsheet exports: typed reading and materialization to a native table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from adloom.sinks.tables import publish


def read_sheet(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV export with a declared schema; a row that does not fit stops the refresh."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_committed_sheet(df: DataFrame) -> DataFrame:
    """Text year and month to numbers, amounts as exact as the table declares them. Rows whose month
    cannot be read are in `unreadable_sheet_rows`."""
    typed = df.select(
        "client",
        "channel",
        F.trim("year").try_cast("int").alias("year"),
        F.trim("month").try_cast("int").alias("month"),
        F.col("amount").try_cast("decimal(38,9)").alias("amount"),
    )
    return typed.filter(F.col("year").isNotNull() & F.col("month").isNotNull())


def unreadable_sheet_rows(df: DataFrame) -> DataFrame:
    """The rows that `read_committed_sheet` cannot place in a month, as they are."""
    return df.filter(F.trim("year").try_cast("int").isNull() | F.trim("month").try_cast("int").isNull())


def materialize_sheet(df: DataFrame, base_path: str) -> str:
    """Full replace; readers keep the last complete copy when a refresh fails."""
    return publish(df, base_path)
