"""Named queries and the fixture they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import bars_of
from ..sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PANELS: dict[str, tuple[list[str], int]] = {}  # columns and digits of panels that have an oracle


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: five symbols, prices over 100."""
    return read_table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", (F.lit(100.0) + F.col("value")).alias("price"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(ticks(spark, sf_dir), "1 hour")


def hourly_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of all events as one series, 'ALL'."""
    return bars_of(ticks(spark, sf_dir).withColumn("symbol", F.lit("ALL")), "1 hour")


def rounded(df: DataFrame, columns: list[str] | None = None, digits: int = 6, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Keys and the chosen columns as rounded doubles without negative zeros, the form both sides of a comparison take."""
    columns = columns if columns is not None else [c for c in df.columns if c not in keys]
    return df.select(*keys, *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in columns])


def panel(name: str, op: Callable[[DataFrame], DataFrame], columns: list[str], oracle: str | None = None, digits: int = 6) -> None:
    """Register op(hourly bars) reduced to some columns."""
    if oracle is not None:
        PANELS[name] = (columns, digits)
    query(name, oracle)(lambda spark, sf_dir: rounded(op(hourly(spark, sf_dir)), columns, digits))
