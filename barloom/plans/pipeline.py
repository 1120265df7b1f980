"""The feature pipeline: every group in order, normalisation, cleaning; fit and transform apart."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import EPS, row_id
from ..operators import backtest, calendar, complexity, evaluate, labels, models, normalize, regimes, splits, structure, trend, unsupervised, volatility


@dataclass(frozen=True)
class Settings:
    """Which groups run, and how the table is cleaned."""

    trend: bool = True
    volatility: bool = True
    structure: bool = True
    seasonality: bool = True
    regimes: bool = True
    hmm: bool = False
    clusters: bool = False
    chaos: bool = False
    method: str = "zscore"
    max_column_nulls: float = 0.60
    min_row_share: float = 0.70
    impute: str | None = "median"


def build_features(bars: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Feature groups one after the other; a group that fails, fails the build."""
    rows = trend.prelim(bars)
    rows = trend.add_trend(rows) if settings.trend else rows
    rows = volatility.add_volatility(rows) if settings.volatility else volatility.ewma(rows)
    rows = structure.add_structure(rows) if settings.structure else rows
    rows = calendar.add_calendar(rows) if settings.seasonality else rows
    rows = regimes.add_regimes(rows) if settings.regimes else rows
    if settings.hmm:
        rows = unsupervised.state_features(unsupervised.hidden_states(rows.drop(*[c for c in unsupervised.CLUSTER_FEATURES if c != "EWMA_94"])))
    if settings.clusters:
        found = unsupervised.ensemble(bars)
        added = [c for c in found.columns if c not in rows.columns and c not in ("GMM_Prob", "pca")]
        rows = rows.join(found.select("symbol", "ts", *added), ["symbol", "ts"], "left")
    return complexity.add_complexity(rows) if settings.chaos else rows


def feature_matrix(bars: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, list[str]]:
    """Raw and normalised columns, cleaned, and the names of the features."""
    rows = build_features(bars, settings)
    columns = normalize.feature_columns(rows)
    rows = normalize.normalize(rows, columns, settings.method)
    every = normalize.feature_columns(rows)
    rows = normalize.clean(rows, every, settings.max_column_nulls, settings.min_row_share, settings.impute)
    return rows, [c for c in every if c in rows.columns]


@dataclass(frozen=True)
class Scaler:
    """Means and deviations of training rows, for rows that come later."""

    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    @staticmethod
    def fit(rows: DataFrame, columns: list[str]) -> Scaler:
        row = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
        return Scaler({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in columns})

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"{c}_zscore": (F.col(c) - m) / (s + EPS) for c, (m, s) in self.stats.items()})


def split_groups(rows: DataFrame, by: str = "time", n: int = 5) -> DataFrame:
    """Add ``group``: stretches of time, or the regime, hidden state or cluster."""
    columns = {"regime": "Regime_Combo", "hmm": "HMM_State", "cluster": "KM_Cluster"}
    if by in columns:
        return rows.withColumn("group", F.col(columns[by]))
    return rows.withColumn("group", F.ntile(n).over(Window.partitionBy("symbol").orderBy("ts")) - 1)


@dataclass(frozen=True)
class Run:
    """What a research run leaves: predictions, their scores, the backtest and its figures, all lazy tables."""

    predictions: DataFrame
    scores: DataFrame
    trades: DataFrame
    risk: DataFrame
    audit: DataFrame


def research_run(bars: DataFrame, columns: list[str], features: DataFrame, horizon: int = 5, folds: int = 5, embargo: int = 5, estimator: Estimator | None = None) -> Run:
    """Labels, purged folds, out-of-fold predictions, signals, backtest and audit of one series.

    features: (symbol, ts, columns...). Folds are purged by the labels' horizon, so no
    training label reaches into a test fold.
    """
    rows = labels.trend_label(bars, horizon, "label").withColumn("row_id", row_id().cast("long"))
    spans = rows.select("symbol", "ts", "row_id", F.col("ts").alias("t0"), F.coalesce(F.lead("ts", horizon).over(Window.partitionBy("symbol").orderBy("ts")), F.col("ts")).alias("t1"))
    ready = models.balanced(models.assembled(rows.join(features.select("symbol", "ts", *columns), ["symbol", "ts"]), columns, "label"))
    ready = ready.select("row_id", "symbol", "ts", "features", "y", "weight").persist()
    table = splits.purged_kfold(spans.select("row_id", "t0", "t1"), folds, embargo)
    preds = models.out_of_fold(ready, table, estimator or models.forest(50, 5), ("symbol", "ts", "row_id")).persist()
    traded = backtest.backtest(backtest.with_market(backtest.signals(preds), bars), "signal_net", "net")
    return Run(preds, evaluate.scores(preds, ("split_id",)), traded, backtest.risk_metrics(traded, "net"), splits.audit(table, spans.select("row_id", "t0", "t1"), strict=True))
