"""Feature diagnostics: constants, drift, autocorrelation, signal to noise, VIF, leakage; feature names and their meaning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import EPS, after, before, by_symbol, full, row_id, trailing, whole


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct, constant)."""
    sums = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct")) for c in columns]))
    return sums.select(pairs.alias("x")).select("x.*").withColumn("constant", F.col("n_distinct") <= 1)


def feature_drift(rows: DataFrame, x: str, w: int = 200) -> DataFrame:
    frame = trailing(w)
    return rows.withColumns({
        f"{x}_drift": full(F.avg(x).over(frame), x, frame, w) - F.avg(x).over(whole()),
        f"{x}_vardrift": full(F.stddev_samp(x).over(frame), x, frame, w) - F.stddev_samp(x).over(whole()),
    })


def autocorrelation(rows: DataFrame, x: str, lag: int = 1) -> DataFrame:
    pairs = rows.select("symbol", F.col(x).alias("a"), before(x, lag).alias("b"))
    return pairs.groupBy("symbol").agg(F.corr("a", "b").alias("autocorr"))


def rolling_autocorr(rows: DataFrame, x: str, w: int = 200, lag: int = 1) -> DataFrame:
    """Of the w bars before each bar, the lagged pairs inside them; 0 before there are w."""
    rows = rows.withColumns({"__b": before(x, lag), "__rn": row_id()})
    frame = by_symbol().rowsBetween(-(w - lag), -1)
    return rows.withColumn(f"{x}_autocorr", F.when(F.col("__rn") >= w, F.corr(x, "__b").over(frame)).otherwise(0.0)).drop("__b", "__rn")


def signal_to_noise(rows: DataFrame, x: str) -> DataFrame:
    return rows.groupBy("symbol").agg((F.abs(F.avg(x)) / (F.stddev_samp(x) + EPS)).alias("snr"))


def rolling_snr(rows: DataFrame, x: str, w: int = 200) -> DataFrame:
    frame = by_symbol().rowsBetween(-w, -1)
    return rows.withColumn("__rn", row_id()).withColumn(f"{x}_snr", F.when(F.col("__rn") >= w, F.abs(F.avg(x).over(frame)) / (F.stddev_samp(x).over(frame) + EPS)).otherwise(0.0)).drop("__rn")


def gram_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of all column pairs, nulls as 0: one aggregate whose size is the number of columns squared."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = df.agg(*[F.sum(x[i] * x[j]).alias(f"c{i}_{j}") for i, j in cells]).first()
    out = np.zeros((len(x), len(x)))
    for i, j in cells:
        out[i, j] = out[j, i] = row[f"c{i}_{j}"] or 0.0
    return out


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation without an intercept: the diagonal of G and of its inverse, multiplied."""
    g = gram_matrix(df, columns)
    try:
        inverse = np.linalg.inv(g)
    except np.linalg.LinAlgError:
        return dict.fromkeys(columns, float("inf"))
    return {c: float(g[i, i] * inverse[i, i]) for i, c in enumerate(columns)}


def leakage(rows: DataFrame, feature: str, target: str = "close", horizon: int = 1) -> DataFrame:
    """Correlation of a feature with the one-bar return ``horizon`` bars ahead."""
    rows = rows.withColumn("__r", F.try_divide(F.col(target), before(target)) - 1).withColumn("__f", after("__r", horizon))
    return rows.groupBy("symbol").agg(F.corr(feature, "__f").alias("leakage"))


def forward_change(rows: DataFrame, x: str, n: int = 5) -> DataFrame:
    return rows.withColumn(f"{x}_fwd", after(x, n) - F.col(x))


# ---- feature names

#: endings that tell how a feature was transformed
MODIFIERS = ("_zscore", "_robust", "_minmax", "_rank", "_winsor", "_vol_adjust", "_regime")


def base_name(name: Column) -> Column:
    """Feature name without its modifiers and window digits."""
    return F.regexp_replace(F.regexp_replace(name, f"({'|'.join(MODIFIERS)})+$", ""), r"(_\d+)+$", "")


def window_of(name: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(F.regexp_replace(name, f"({'|'.join(MODIFIERS)})+$", ""), r"_(\d+)$", 1), F.lit("")), F.lit("999")).cast("int")


def describe(names: DataFrame, descriptions: DataFrame, name: str = "feature") -> DataFrame:
    """Names joined to a small table (base, description); unknown ones describe themselves."""
    rows = names.withColumns({"base": base_name(F.col(name)), "window": window_of(F.col(name))})
    return rows.join(F.broadcast(descriptions), "base", "left").withColumn("description", F.coalesce("description", name))


def top_features(importance: DataFrame, descriptions: DataFrame, k: int = 20) -> DataFrame:
    return describe(importance, descriptions).orderBy(F.desc("importance"), "feature").limit(k)
