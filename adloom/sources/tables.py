"""Table scans with explicit columns, so only what a plan uses is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(
    spark: SparkSession,
    directory: str,
    name: str,
    schema: StructType | str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Scan one table; a given schema skips the footer read on the driver."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    return df if columns is None else df.select(*columns)


#: Folder name Spark gives the partition of null values.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def newest_partition(spark: SparkSession, path: str, column: str, schema: StructType | None = None) -> DataFrame:
    """Rows of the newest partition of a history partitioned by `column`, found from the folder names alone.

    The driver lists the partition folders (one name per snapshot, no file is opened) and reads only the
    newest; no scan computes the maximum. Values compare as text, which orders ISO dates and zero-padded
    numbers; the folder of null values is not a snapshot. An empty or missing history gives no rows (it needs
    `schema` then, since there is nothing to read it from).
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    values = [n.split("=", 1)[1] for n in names if n.startswith(f"{column}=")]
    values = [v for v in values if v != NULL_PARTITION]
    if not values:
        if schema is None:
            raise ValueError(f"no snapshot in {path} and no schema to give an empty result")
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", path) if schema is None else spark.read.schema(schema).option("basePath", path)
    return reader.parquet(f"{path}/{column}={max(values)}")
