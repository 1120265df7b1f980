"""The flagship query: ticks to hourly bars to a trend view of the newest ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import mean, row_id, std
from ..operators.bars import returns
from ..operators.trend import slope
from .registry import hourly


def flagship(spark: SparkSession, sf_dir: str, last: int = 100) -> DataFrame:
    rows = returns(hourly(spark, sf_dir)).withColumn("rn", row_id())
    rows = rows.withColumns({"SMA_20": mean("close", 20), "Vol_20": std("ret", 20), "RegSlope_20": slope("close", 20, "rn")}).drop("rn")
    return rows.withColumn("trend", F.signum("RegSlope_20")).orderBy(F.desc("ts"), "symbol").limit(last)
