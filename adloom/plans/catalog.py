"""Registry of the runnable queries: how to build each one and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adloom.plans.frames import Frames
from adloom.session import tune


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Frames], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a builder under a name with the inventory ids it covers."""

    def add(build: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), build, sql)
        return build

    return add


def plain(df: DataFrame) -> DataFrame:
    """Types that compare alike in any client: dates and timestamps as text, decimals as double,
    arrays of text joined by '|'."""

    def cell(name: str, kind: str) -> Column:
        col = F.col(f"`{name}`")
        if kind == "date":
            out = F.date_format(col, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            out = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind.startswith("decimal"):
            out = col.cast("double")
        elif kind == "array<string>":
            out = F.array_join(col, "|")
        else:
            return col
        return out.alias(name)

    return df.select(*[cell(name, kind) for name, kind in df.dtypes])


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(q.build(Frames(tune(spark), sf_dir)))

    return run


def load_all() -> dict[str, Query]:
    from adloom.plans import queries_access, queries_alerts, queries_calls, queries_diagnosis  # noqa: F401
    from adloom.plans import queries_money, queries_registry, queries_tables  # noqa: F401

    return REGISTRY


def stack(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
