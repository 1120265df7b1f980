"""Clusters and hidden states of bars: feature matrix, scaling, PCA, k-means, Gaussian mixture, hidden Markov model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rolling import EPS, before, by_symbol, full, median, row_id, std, trailing
from . import regimes
from .long_chain import CHUNK, GaussianChain, _log_density, hidden_states_long
from .trend import slope
from .volatility import ewma, with_ret

CLUSTER_FEATURES = ("EWMA_94", "abs_ret", "slope_20", "range", "median_dev")
HMM_FEATURES = CLUSTER_FEATURES[:3]


def features(bars: DataFrame) -> DataFrame:
    """EWMA volatility, |return| (0 at first), slope over 20 (0 before), range, deviation from the rolling median of 50 (NULL before)."""
    rows = ewma(with_ret(bars)).withColumn("__rn", row_id())
    return rows.withColumns({
        "abs_ret": F.coalesce(F.abs("ret"), F.lit(0.0)), "slope_20": F.coalesce(slope("close", 20), F.lit(0.0)), "range": F.col("high") - F.col("low"),
        "median_dev": (F.col("close") - median("close", 50)) / (std("close", 50) + EPS),
    }).drop("__rn")


def scaled(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """z_<column> by mean and population deviation over all rows: one aggregate, sent back as one row."""
    stats = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    out = rows.crossJoin(F.broadcast(stats)).withColumns({f"z_{c}": (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + EPS) for c in columns})
    return out.drop(*[f"__{k}_{c}" for c in columns for k in "ms"])


def components(rows: DataFrame, columns: tuple[str, ...] = CLUSTER_FEATURES, k: int = 3) -> DataFrame:
    """Add ``pca`` (array of k). Rows with a missing feature are left out. Signs are free."""
    ready = scaled(rows.na.drop(subset=list(columns)), columns)
    vector = VectorAssembler(inputCols=[f"z_{c}" for c in columns], outputCol="__x").transform(ready)
    model = PCA(k=k, inputCol="__x", outputCol="__p").fit(vector)
    return model.transform(vector).withColumn("pca", vector_to_array("__p")).drop("__x", *[f"z_{c}" for c in columns])


def kmeans(rows: DataFrame, k: int = 4, seed: int = 42, vector: str = "__p") -> DataFrame:
    """Add KM_Cluster (numbered by rising mean volatility) and KM_Dist, the distance to the own centre."""
    model = KMeans(k=k, seed=seed, featuresCol=vector, predictionCol="__k").fit(rows)
    out = model.transform(rows)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    own = F.element_at(centres, F.col("__k") + 1)
    distance = F.sqrt(F.aggregate(F.zip_with(vector_to_array(vector), own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return _by_volatility(out.withColumn("KM_Dist", distance), "__k", "KM_Cluster")


def _by_volatility(rows: DataFrame, label: str, name: str) -> DataFrame:
    """Rename labels 0.. by rising mean EWMA volatility, so that runs and libraries agree; returns the labels' table joined."""
    means = rows.groupBy(label).agg(F.avg("EWMA_94").alias("__v"))
    order = means.agg(F.array_sort(F.collect_list(F.struct("__v", label))).alias("__o"))  # one small row
    place = F.array_position(F.transform("__o", lambda s: s[label]), F.col(label)) - 1
    return rows.crossJoin(F.broadcast(order)).withColumn(name, place.cast("int")).drop("__o", label)


def mixture(rows: DataFrame, k: int = 4, seed: int = 42, vector: str = "__p") -> DataFrame:
    """Add GMM_Cluster, GMM_Prob (array) and GMM_NLL (negative log likelihood of the row)."""
    model = GaussianMixture(k=k, seed=seed, featuresCol=vector, predictionCol="__g", probabilityCol="__gp", maxIter=100).fit(rows)
    out = model.transform(rows).withColumn("GMM_Prob", vector_to_array("__gp"))
    parts = []
    for weight, g in zip(model.weights, model.gaussians, strict=True):
        cov, mu = np.asarray(g.cov.toArray()), np.asarray(g.mean.toArray())
        inverse, (_, log_det) = np.linalg.pinv(cov), np.linalg.slogdet(cov)
        x = vector_to_array(vector)
        d = [F.element_at(x, i + 1) - float(m) for i, m in enumerate(mu)]
        q = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(len(mu)) for j in range(len(mu))), F.lit(0.0))
        parts.append(F.lit(float(np.log(weight + 1e-300) - 0.5 * (len(mu) * np.log(2 * np.pi) + log_det))) - 0.5 * q)
    top = F.greatest(*parts)
    nll = -(top + F.log(sum((F.exp(p - top) for p in parts), F.lit(0.0))))
    return _by_volatility(out.withColumn("GMM_NLL", nll).drop("__gp"), "__g", "GMM_Cluster")


def ensemble(bars: DataFrame, k: int = 4, alpha: float = 0.5) -> DataFrame:
    """PCA, both clusterings, hybrid anomaly score, agreement, stability and drift."""
    rows = mixture(kmeans(components(features(bars)).persist(), k), k).drop("__p").persist()
    stats = rows.agg(F.avg("KM_Dist").alias("__a"), F.stddev_pop("KM_Dist").alias("__b"), F.avg("GMM_NLL").alias("__c"), F.stddev_pop("GMM_NLL").alias("__d"))
    rows = rows.crossJoin(F.broadcast(stats))
    score = alpha * (F.col("KM_Dist") - F.col("__a")) / (F.col("__b") + EPS) + (1 - alpha) * (F.col("GMM_NLL") - F.col("__c")) / (F.col("__d") + EPS)
    rows = rows.withColumns({"AnomalyScore": score, "ClusterConsistency": (F.col("KM_Cluster") == F.col("GMM_Cluster")).cast("int")}).drop("__a", "__b", "__c", "__d")
    rows = regimes.run_lengths(rows, "KM_Cluster", "ClusterStability")
    return regimes.drift(rows, "KM_Cluster").withColumns({f"GMM_Prob_{i}": F.element_at("GMM_Prob", i + 1) for i in range(k)})


# ---- hidden Markov model


def _forward_backward(log_b: np.ndarray, model: GaussianChain) -> tuple[np.ndarray, np.ndarray, float]:
    n, k = log_b.shape
    shift = log_b.max(axis=1, keepdims=True)
    b = np.exp(log_b - shift)
    alpha, scale, beta = np.empty((n, k)), np.empty(n), np.ones((n, k))
    for t in range(n):
        alpha[t] = (model.start if t == 0 else alpha[t - 1] @ model.move) * b[t]
        scale[t] = alpha[t].sum() or 1e-300
        alpha[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = model.move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    pairs = model.move * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
    return gamma, pairs, float(np.log(scale).sum() + shift.sum())


def fit_chain(x: np.ndarray, k: int = 3, rounds: int = 200, tolerance: float = 1e-4, floor: float = 1e-3) -> GaussianChain:
    """Baum-Welch from quantile slices of the first column; deterministic."""
    n, f = x.shape
    part = np.searchsorted(np.quantile(x[:, 0], np.arange(1, k) / k), x[:, 0], side="right")
    model = GaussianChain(
        np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)),
        np.array([x[part == i].mean(axis=0) if (part == i).any() else x.mean(axis=0) for i in range(k)]), np.array([np.cov(x.T, bias=True).reshape(f, f) + floor * np.eye(f)] * k),
    )
    before_ = -np.inf
    for _ in range(rounds):
        gamma, pairs, likelihood = _forward_backward(_log_density(x, model), model)
        weight = gamma.sum(axis=0) + 1e-12
        model.start = gamma[0] / gamma[0].sum()
        model.move = (pairs + 1e-12) / (pairs + 1e-12).sum(axis=1, keepdims=True)
        model.means = gamma.T @ x / weight[:, None]
        for i in range(k):
            d = x - model.means[i]
            model.covs[i] = (gamma[:, i, None] * d).T @ d / weight[i] + floor * np.eye(f)
        if abs(likelihood - before_) < tolerance:
            break
        before_ = likelihood
    order = np.argsort(model.means[:, 0])
    return GaussianChain(model.start[order], model.move[np.ix_(order, order)], model.means[order], model.covs[order])


def viterbi(log_b: np.ndarray, model: GaussianChain) -> np.ndarray:
    n, k = log_b.shape
    with np.errstate(divide="ignore"):
        move, score = np.log(model.move), np.log(model.start) + log_b[0]
    back = np.zeros((n, k), np.int64)
    for t in range(1, n):
        step = score[:, None] + move
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + log_b[t]
    path = np.empty(n, np.int64)
    path[-1] = int(score.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def hidden_states(bars: DataFrame, k: int = 3, columns: tuple[str, ...] = HMM_FEATURES, rounds: int = 200, chunk: int = CHUNK) -> DataFrame:
    """Add HMM_State (by rising volatility), HMM_Post (array), HMM_Trans (array of rows) and HMM_Duration of the state; a model a symbol.

    Series of up to ``chunk`` bars are one task's work each; longer ones are cut into chunks and
    fitted over all of them, with the same result.
    """
    rows = features(bars)
    sizes = bars.groupBy("symbol").agg(F.count("*").alias("__n"))
    if sizes.where(F.col("__n") > chunk).limit(1).count():
        marked = rows.join(sizes, "symbol")
        long = hidden_states_long(marked.where(F.col("__n") > chunk).drop("__n"), columns, k, rounds, chunk)
        return long.unionByName(_states_by_symbol(marked.where(F.col("__n") <= chunk).drop("__n"), k, columns, rounds))
    return _states_by_symbol(rows, k, columns, rounds)


def _states_by_symbol(rows: DataFrame, k: int, columns: tuple[str, ...], rounds: int) -> DataFrame:
    extra = [T.StructField("HMM_State", T.IntegerType()), T.StructField("HMM_Post", T.ArrayType(T.DoubleType())), T.StructField("HMM_Trans", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("HMM_Duration", T.DoubleType())]
    schema = T.StructType(rows.schema.fields + extra)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts").reset_index(drop=True)
        x = np.nan_to_num(frame[list(columns)].to_numpy(float))
        x = (x - x.mean(axis=0)) / (x.std(axis=0) + EPS)
        model = fit_chain(x, k, rounds)
        log_b = _log_density(x, model)
        gamma, _, _ = _forward_backward(log_b, model)
        states = viterbi(log_b, model)
        stay = 1 / np.maximum(1 - np.diag(model.move), 1e-12)
        matrix = [list(map(float, r)) for r in model.move]
        return frame.assign(HMM_State=states.astype("int32"), HMM_Post=[list(map(float, g)) for g in gamma], HMM_Trans=[matrix] * len(frame), HMM_Duration=stay[states])

    return rows.groupBy("symbol").applyInPandas(run, schema)


def state_features(rows: DataFrame, w: int = 20, drop: float = 0.3) -> DataFrame:
    """HMM_Persistence (0 on the first bar), HMM_SwitchRisk, HMM_Shock and HMM_Uncertainty (mean entropy); needs ``hidden_states``."""
    rows = regimes.run_lengths(rows, "HMM_State", "HMM_Persistence")
    first = F.row_number().over(by_symbol()) == 1
    top = F.array_max("HMM_Post")
    rows = rows.withColumns({
        "HMM_Persistence": F.when(first, 0).otherwise(F.col("HMM_Persistence")), "HMM_SwitchRisk": F.coalesce((F.col("HMM_State") != before("HMM_State")).cast("int"), F.lit(0)), "__top": top,
        "__e": -F.aggregate("HMM_Post", F.lit(0.0), lambda s, p: s + p * F.log(p + 1e-10)),
    })
    rows = rows.withColumn("HMM_Shock", F.coalesce((F.col("__top") - before("__top") < -drop).cast("int"), F.lit(0)))
    return rows.withColumn("HMM_Uncertainty", full(F.avg("__e").over(trailing(w)), "__e", trailing(w), w)).drop("__top", "__e")
