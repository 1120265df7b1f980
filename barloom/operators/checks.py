"""Validation of data, predictions, samples and regimes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import scores


def probability_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.match(r"prob_class_|p_(bear|neutral|bull)$|.*_prob_(bull|bear)$", c)]


def feature_groups(columns: list[str]) -> dict[str, list[str]]:
    """Columns by what their names begin with."""
    groups = {"trend": r"SMA|EMA|WMA|HMA|KAMA|TEMA|RSI|Reg|ROC", "volatility": r"Vol|ATR|Parkinson|GK|RS_|YZ|EWMA", "structure": r"Swing|Support|Resistance|Break|Fractal", "regime": r"Regime|HMM|KM|GMM", "label": r"LBL_|label|fwd_|dir_"}
    return {g: [c for c in columns if re.match(p, c)] for g, p in groups.items()}


def validate(df: DataFrame, label: str | None = None, least_share: float = 0.1, tolerance: float = 1e-3) -> DataFrame:
    """(check, value, ok): null cells, repeated keys, rows whose probabilities don't sum to 1, share of the rarest class. One pass for all but the classes."""
    probs = [c for c in ("p_bear", "p_neutral", "p_bull") if c in df.columns]
    off = F.count_if(F.abs(sum((F.col(c) for c in probs), F.lit(0.0)) - 1) > tolerance) if probs else F.lit(0)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    keys = [c for c in ("symbol", "ts") if c in df.columns]
    row = df.agg(nulls.alias("null_cells"), (F.count("*") - F.count_distinct(*keys) if keys else F.lit(0)).alias("repeated_keys"), off.alias("bad_probability_sums"))
    out = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value"), (F.col(c) == 0).alias("ok")) for c in row.columns])).alias("x")).select("x.*")
    if label:
        shares = class_balance(df, label).agg(F.min("share").alias("v"))
        out = out.union(shares.select(F.lit("rarest_class_share"), "v", F.col("v") >= least_share))
    return out


def class_balance(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(label, "n", (F.col("n") / F.col("total")).alias("share"))


def index_difference(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Keys in one table only, and which."""
    left, right = (d.select(*keys).distinct() for d in (a, b))
    return left.join(right, list(keys), "left_anti").withColumn("side", F.lit("first")).union(right.join(left, list(keys), "left_anti").withColumn("side", F.lit("second")))


def compare_samples(preds: DataFrame, sample: str, limit: float = 0.05) -> DataFrame:
    """Scores of each sample, their spread, and whether it stays under the limit."""
    each = scores(preds, (sample,))
    spread = each.agg(F.max("accuracy") - F.min("accuracy"))
    return each.crossJoin(F.broadcast(spread.toDF("spread"))).withColumn("stable", F.col("spread") < limit)


def pattern_stability(preds: DataFrame, sample: str, a: str, b: str) -> DataFrame:
    """L1 distance between two samples' shares of predicted classes."""
    shares = preds.where(F.col(sample).isin(a, b)).groupBy("pred").agg(F.count_if(F.col(sample) == a).alias("na"), F.count_if(F.col(sample) == b).alias("nb"))
    totals = shares.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    each = shares.crossJoin(F.broadcast(totals)).select(F.abs(F.try_divide("na", "ta") - F.try_divide("nb", "tb")).alias("d"))
    return each.agg(F.sum("d").alias("distance"))


def by_regime(preds: DataFrame, regime: str, least: int = 30) -> DataFrame:
    """Of regimes with enough rows: accuracy, commonest prediction and its share, mean and deviation of the largest probability."""
    top = F.greatest("p_bear", "p_neutral", "p_bull")
    return preds.groupBy(regime).agg(
        F.count("*").alias("n"), F.avg((F.col("pred") == F.col("true")).cast("double")).alias("accuracy"), F.mode("pred", True).alias("common_pred"), F.avg(top).alias("mean_prob"), F.stddev_samp(top).alias("std_prob"),
        F.greatest(*[F.count_if(F.col("pred") == c) for c in (-1, 0, 1)]).alias("n_common"),
    ).where(F.col("n") >= least).withColumn("common_share", F.col("n_common") / F.col("n")).drop("n_common")


def compare_runs(runs: DataFrame, metrics: list[str], run: str = "run_id", limit: float = 0.05) -> DataFrame:
    """(metric, latest, before, change, stable): the newest run's mean of each metric against the run before it."""
    order = runs.select(run).distinct().orderBy(F.desc(run)).limit(2)
    means = runs.join(F.broadcast(order), run).groupBy(run).agg(*[F.avg(m).alias(m) for m in metrics])
    both = means.agg(*[x for m in metrics for x in (F.max_by(m, run).alias(f"l_{m}"), F.min_by(m, run).alias(f"b_{m}"))])
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"l_{m}").cast("double").alias("latest"), F.col(f"b_{m}").cast("double").alias("before")) for m in metrics])).alias("x")).select("x.*")
    return rows.withColumn("change", F.col("latest") - F.col("before")).withColumn("stable", F.abs("change") < limit)
