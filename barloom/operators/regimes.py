"""Regimes: volatility and trend classes, their code, run lengths, shifts, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import EPS, before, by_symbol, flag, row_id, run_start, running, trailing, whole
from .trend import slope


def vol_regime(rows: DataFrame, vol: str = "EWMA_94") -> DataFrame:
    """0..3 by the series' own quartiles (whole sample), strictly above; needs the volatility column."""
    q = [F.percentile(vol, F.lit(p)).over(whole()) for p in (0.25, 0.5, 0.75)]
    v = F.col(vol)
    return rows.withColumn("VolRegClass_4", F.when(v > q[2], 3).when(v > q[1], 2).when(v > q[0], 1).otherwise(0))


def trend_regime(bars: DataFrame, w: int = 50, cut: float = 0.5) -> DataFrame:
    """-1, 0, 1 by the z-score of the regression slope (whole sample)."""
    rows = bars.withColumn("__rn", row_id()).withColumn("__s", slope("close", w))
    z = (F.col("__s") - F.avg("__s").over(whole())) / (F.stddev_samp("__s").over(whole()) + EPS)
    return rows.withColumn("TrendRegClass_3", F.when(z > cut, 1).when(z < -cut, -1).otherwise(0)).drop("__rn", "__s")


def combined(rows: DataFrame) -> DataFrame:
    return rows.withColumn("Regime_Combo", F.col("TrendRegClass_3") * 10 + F.col("VolRegClass_4"))


def run_lengths(rows: DataFrame, regime: str, name: str, first_run_short: bool = False) -> DataFrame:
    """Bars since the regime began, this one included. ``first_run_short``: the first run counts 1, 1, 2, ... as the count starts at 0."""
    rows = rows.withColumn("__start", run_start(regime)).withColumn("__run", F.sum("__start").over(running()))
    place = F.row_number().over(Window.partitionBy("symbol", "__run").orderBy("ts"))
    if first_run_short:
        place = place - F.when((F.col("__run") == 1) & (place > 1), 1).otherwise(0)
    return rows.withColumn(name, place).drop("__start", "__run")


def persistence(rows: DataFrame, regime: str = "Regime_Combo") -> DataFrame:
    return run_lengths(rows, regime, "RegimePersistence", True)


def shifts(rows: DataFrame, regime: str = "Regime_Combo") -> DataFrame:
    return rows.withColumn("RegimeShift", F.coalesce(F.signum(F.col(regime) - before(regime)).cast("int"), F.lit(0)))


def transition_matrix(rows: DataFrame, label: str) -> DataFrame:
    """(symbol, from, to, n, p): how often each state follows each; rows without a successor have no p."""
    steps = rows.select("symbol", before(label).alias("from_state"), F.col(label).alias("to_state")).where("from_state is not null and to_state is not null")
    pairs = steps.groupBy("symbol", "from_state", "to_state").agg(F.count("*").alias("n"))
    return pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "from_state")))


def drift(rows: DataFrame, label: str, w: int = 20, name: str = "ClusterDrift") -> DataFrame:
    """Share of label changes among the w bars before this one (w - 1 steps over w); 0 before that."""
    rows = rows.withColumns({"__c": flag(F.col(label) != before(label)), "__rn": row_id()})
    changes = F.sum("__c").over(by_symbol().rowsBetween(-(w - 1), -1))
    return rows.withColumn(name, F.when(F.col("__rn") >= w, changes / w).otherwise(0.0)).drop("__c", "__rn")


def fingerprints(rows: DataFrame, label: str, w: int = 20) -> DataFrame:
    """Of each label's rows, taken one after the other: mean rolling volatility, mean return and mean range."""
    order = Window.partitionBy("symbol", label).orderBy("ts")
    frame = order.rowsBetween(-(w - 1), 0)
    rows = rows.withColumn("__r", F.try_divide(F.col("close"), F.lag("close").over(order)) - 1)
    rows = rows.withColumn("__v", F.when(F.count("__r").over(frame) == w, F.stddev_samp("__r").over(frame)))
    return rows.groupBy("symbol", label).agg(F.avg("__v").alias("Volatility"), F.avg("__r").alias("Slope"), F.avg(F.col("high") - F.col("low")).alias("Range"), F.avg("__r").alias("Return"))


def switch_risk(rows: DataFrame, label: str, w: int = 20) -> DataFrame:
    """Mean of the change flag over a full window."""
    rows = rows.withColumn("__c", flag(F.col(label) != before(label)))
    return rows.withColumn("SwitchRisk", F.when(F.count("__c").over(trailing(w)) == w, F.avg("__c").over(trailing(w)))).drop("__c")


def add_regimes(rows: DataFrame) -> DataFrame:
    """Needs EWMA_94."""
    for step in (vol_regime, trend_regime, combined, persistence, shifts):
        rows = rows.transform(step)
    return rows
