"""Normalisers over a whole series (two-phase: statistics, then rows) and the cleaning of feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import EPS, average_rank, col, std, whole


def zscore(x: Column | str) -> Column:
    return (col(x) - F.avg(col(x)).over(whole())) / (F.stddev_samp(col(x)).over(whole()) + EPS)


def minmax(x: Column | str) -> Column:
    low, high = F.min(col(x)).over(whole()), F.max(col(x)).over(whole())
    return (col(x) - low) / (high - low + EPS)


def winsorised(x: Column | str, lower: float = 0.01, upper: float = 0.99) -> Column:
    lo, hi = (F.percentile(col(x), F.lit(q)).over(whole()) for q in (lower, upper))
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), lo), hi))


def rank_scaled(x: str) -> Column:
    """Average rank over the count, NULL staying NULL."""
    by_value = Window.partitionBy("symbol").orderBy(F.col(x).asc_nulls_last())
    return F.when(F.col(x).isNotNull(), average_rank(F.col(x), by_value, Window.partitionBy("symbol", x)) / F.count(x).over(whole()))


def vol_adjusted(x: str, w: int = 20) -> Column:
    return F.col(x) / (std(x, w) + EPS)


def robust(rows: DataFrame, x: str, name: str) -> DataFrame:
    """(x - median) / MAD over the series; all NULL if any x is, as a plain median has it."""
    rows = rows.withColumn("__med", F.when(F.count(F.when(F.col(x).isNull(), 1)).over(whole()) == 0, F.percentile(x, F.lit(0.5)).over(whole())))
    rows = rows.withColumn("__dev", F.abs(F.col(x) - F.col("__med")))
    return rows.withColumn(name, (F.col(x) - F.col("__med")) / (F.percentile("__dev", F.lit(0.5)).over(whole()) + EPS)).drop("__med", "__dev")


def regime_aware(rows: DataFrame, x: str, regime: str, name: str) -> DataFrame:
    """By regime: 0 and 1 z-score, 2 robust, 3 winsorised then robust, else NULL. Statistics once a series, not once a row."""
    rows = rows.withColumn("__w", winsorised(x)).transform(robust, x, "__rob").transform(robust, "__w", "__wrob")
    r = F.col(regime)
    return rows.withColumn(name, F.when(r.isin(0, 1), zscore(x)).when(r == 2, F.col("__rob")).when(r == 3, F.col("__wrob"))).drop("__w", "__rob", "__wrob")


def normalize(rows: DataFrame, columns: list[str], method: str = "zscore", regime: str | None = None) -> DataFrame:
    """Add ``<column>_<method>`` for each column; the plain columns stay."""
    plain = {"zscore": zscore, "minmax": minmax, "rank": rank_scaled, "winsor": winsorised, "vol_adjust": vol_adjusted}
    if method in plain:
        return rows.withColumns({f"{c}_{method}": plain[method](c) for c in columns})
    for c in columns:
        if method == "robust":
            rows = robust(rows, c, f"{c}_robust")
        elif method == "regime" and regime:
            rows = regime_aware(rows, c, regime, f"{c}_regime")
        else:
            raise ValueError(f"unknown method {method}")
    return rows


# ---- feature tables


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ("symbol", "ts", "open", "high", "low", "close", "volume"), prefixes: tuple[str, ...] = ("LBL_", "label", "fwd_", "dir_")) -> list[str]:
    """Numeric columns that are no key, price or label."""
    return [c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") and c not in exclude and not c.startswith(prefixes)]


def no_infinities(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite and NaN values to NULL: inside the engine, missing is NULL."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in columns if kinds[c] in ("double", "float")})


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_null, share): one aggregate over the table, then turned."""
    sums = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns]))
    return sums.select("n", pairs.alias("x")).select("x.column", "n", "x.n_null", F.try_divide("x.n_null", "n").alias("share"))


def clean(df: DataFrame, columns: list[str], max_column_nulls: float = 0.60, min_row_share: float = 0.70, impute: str | None = "median") -> DataFrame:
    """Drop sparse columns, then sparse rows, then fill with the median, mean or last value (or drop what is left)."""
    df = no_infinities(df, columns)
    profile = {r["column"]: r["share"] for r in null_profile(df, columns).collect()}  # one row a column
    kept = [c for c in columns if profile[c] is not None and profile[c] < 1 and profile[c] <= max_column_nulls]
    df = df.drop(*[c for c in columns if c not in kept])
    if not kept:
        return df
    there = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in kept), F.lit(0))
    df = df.where(there / len(kept) >= min_row_share)
    if impute == "ffill":
        order = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.coalesce(c, F.last(c, True).over(order)) for c in kept})
    if impute in ("median", "mean"):
        fn = F.avg if impute == "mean" else lambda c: F.percentile(c, F.lit(0.5))
        fills = df.agg(*[fn(c).alias(f"__{c}") for c in kept])
        return df.crossJoin(F.broadcast(fills)).withColumns({c: F.coalesce(c, f"__{c}") for c in kept}).drop(*[f"__{c}" for c in kept])
    return df.na.drop(subset=kept)
