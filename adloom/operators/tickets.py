"""Open tickets per linked client, from boards with different column ids."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from adloom.functions import labels as L


def union_boards(boards: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("board_id", F.lit(b)) for b, df in boards.items()])


def _column(id_col: Column | str) -> Column:
    """The nested column value with the given id (the last one, should an id repeat)."""
    wanted = F.filter("column_values", lambda c: c["id"] == id_col)
    return F.try_element_at(wanted, F.lit(-1))


def ticket_board(items: DataFrame, boards: DataFrame, done: DataFrame) -> DataFrame:
    """One row per (open ticket, linked client).

    items: id, name, board_id, column_values array<struct<id,text,label,index,is_done,color,date,linked_items>>
    boards: board_id, board_name, client_col, status_col, url_prefix
    done: board_id, status_index - statuses that count as done on that board
    """
    shaped = (
        items.join(boards, "board_id")
        .withColumn("_client", _column(F.col("client_col")))
        .withColumn("_status", _column(F.col("status_col")))
        .withColumn("_due", _column(F.lit(L.DUE_DATE_COLUMN)))
        .filter(~F.coalesce(F.col("_status.is_done"), F.lit(False)))
        .withColumn("status_index", F.col("_status.index").cast("string"))
        .join(done.select("board_id", "status_index"), ["board_id", "status_index"], "left_anti")
    )
    linked = F.array_distinct(F.transform("_client.linked_items", lambda x: x["id"].cast("string")))
    return shaped.select(
        F.explode(linked).alias("client_id"),
        F.col("id").cast("string").alias("id"),
        "name",
        F.coalesce("_status.label", "_status.text", F.lit("")).alias("status"),
        F.coalesce("_status.color", F.lit(L.DEFAULT_STATUS_COLOR)).alias("status_color"),
        F.col("board_name").alias("board"),
        "board_id",
        F.concat(F.col("url_prefix"), F.col("id").cast("string")).alias("url"),
        F.col("_due.date").alias("due_date"),
    )
