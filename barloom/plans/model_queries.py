"""Queries that fit models or keep state: rows only, checked by invariants in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import row_id
from ..operators import complexity as Z
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import models as M
from ..operators import splits as C
from ..operators import trend as T
from ..operators import unsupervised as U
from ..operators import volatility as V
from ..operators.boosting import SoftmaxBoosting
from .config import timeframe
from .pipeline import Settings, build_features, research_run
from .registry import ORACLES, hourly, hourly_all, query, rounded

FEATURES = ["Return", "ATR_14", "VolRet", "RegSlope_20", "ROC_10", "Vol_20"]


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = T.roc(T.reg_slope(T.prelim(hourly_all(spark, d)), (20,)), (10,))
    rows = L.trend_label(V.basic(rows, (20,)), 5, "label").withColumn("row_id", row_id().cast("long"))
    rows = M.balanced(M.assembled(rows, FEATURES, "label")).select("row_id", "ts", "symbol", "features", "y", "weight", *FEATURES)
    return rows.persist()  # every fit reads it several times; lost parts are recomputed


def _splits(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    one = hourly_all(spark, d)
    rows = C.numbered(one.withColumn("t1", F.lead("ts", 5).over(T.by_symbol())), "ts", "t1").drop("symbol")
    return C.purged_kfold(rows, k, 5).persist()


_parts = [f"({ORACLES[n]})" for n in ("hurst", "fractal_dimension", "detrended_fluctuation", "entropies")]
query("complexity", f'SELECT symbol, a."Hurst", b."FracDim", c."DFA", e."ApEn", e."SampEn", e."Lyap" FROM {_parts[0]} a FULL JOIN {_parts[1]} b USING (symbol) FULL JOIN {_parts[2]} c USING (symbol) FULL JOIN {_parts[3]} e USING (symbol)')(
    lambda spark, d: rounded(Z.scalars(hourly(spark, d)).withColumn("DFA", F.round("DFA", 5)), keys=("symbol",)))
query("cluster_regimes")(lambda spark, d: rounded(U.ensemble(hourly(spark, d)), ["KM_Cluster", "KM_Dist", "GMM_Cluster", "GMM_NLL", "AnomalyScore", "ClusterConsistency", "ClusterStability", "ClusterDrift"], 4))
query("pca")(lambda spark, d: U.components(U.features(hourly(spark, d))).select("symbol", "ts", "pca"))
query("hmm_regimes")(lambda spark, d: rounded(U.state_features(U.hidden_states(hourly(spark, d))), ["HMM_State", "HMM_Duration", "HMM_Persistence", "HMM_SwitchRisk", "HMM_Shock", "HMM_Uncertainty"], 4))
query("rf_purged_cv")(lambda spark, d: rounded(M.cross_validated(model_rows(spark, d), _splits(spark, d), M.forest(20, 4))[1], keys=("split_id",)))


def _stack(spark: SparkSession, d: str) -> DataFrame:
    rows, splits = model_rows(spark, d), _splits(spark, d)
    parts = {"rf": M.out_of_fold(rows, splits, M.forest(20, 4)), "logit": M.out_of_fold(rows, splits, M.logistic()), "boosted": M.out_of_fold(rows, splits, SoftmaxBoosting(5, 2, classes=3))}
    parts = {name: preds.persist() for name, preds in parts.items()}
    return E.scores(M.stacked(parts))


query("stacking")(lambda spark, d: rounded(_stack(spark, d), keys=()))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    rows, splits = model_rows(spark, d), _splits(spark, d)
    wide = M.blend({"rf": M.out_of_fold(rows, splits, M.forest(20, 4)), "logit": M.out_of_fold(rows, splits, M.logistic()), "mlp": M.out_of_fold(rows, splits, M.perceptron(len(FEATURES), (8,)))})
    return E.mean_probability(E.vote(wide, ["rf_pred", "logit_pred", "mlp_pred"]), ["rf", "logit", "mlp"]).select("row_id", "true", "vote", "ensemble_p_bear", "ensemble_p_neutral", "ensemble_p_bull")


query("model_votes")(lambda spark, d: rounded(_votes(spark, d), keys=("row_id", "true", "vote")))
query("walk_forward_scores")(lambda spark, d: rounded(E.scores(M.out_of_fold(
    model_rows(spark, d), C.walk_forward(C.numbered(hourly_all(spark, d)).drop("symbol"), 300, 100), M.logistic()), ("split_id",)), keys=("split_id",)))


def _importance(spark: SparkSession, d: str) -> DataFrame:
    rows = model_rows(spark, d)
    return M.permutation_importance(M.forest(20, 4).fit(rows), rows, FEATURES)


query("permutation_importance")(_importance)


def _contributions(spark: SparkSession, d: str) -> DataFrame:
    rows = model_rows(spark, d)
    return M.path_contributions(M.forest(10, 4).fit(rows), rows, len(FEATURES), 2).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


query("path_contributions")(_contributions)
query("feature_table")(lambda spark, d: build_features(hourly(spark, d), Settings()))


def _regime_walks(spark: SparkSession, d: str) -> DataFrame:
    spans = C.numbered(hourly_all(spark, d)).drop("symbol")
    return M.regime_scores(M.walk_forward_regimes(model_rows(spark, d), timeframe("1H"), M.logistic(), spans).persist())


query("walk_forward_regimes")(lambda spark, d: rounded(_regime_walks(spark, d), keys=("regime",)))


def _research(spark: SparkSession, d: str) -> DataFrame:
    bars = hourly_all(spark, d)
    table = V.basic(T.roc(T.reg_slope(T.prelim(bars), (20,)), (10,)), (20,))
    return research_run(bars, FEATURES, table, folds=3, estimator=M.logistic()).risk


query("research_run")(lambda spark, d: rounded(_research(spark, d), keys=("symbol",)))


def _meta(spark: SparkSession, d: str) -> DataFrame:
    from .research_queries import preds

    return M.meta_model(E.meta_features(preds(spark, d))).groupBy("kept").agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("true")).cast("double")).alias("hit_rate"))


query("meta_model")(lambda spark, d: rounded(_meta(spark, d), keys=("kept",)))
