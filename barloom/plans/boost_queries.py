"""Queries over softmax boosting and exact tree contributions."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import contributions as S
from ..operators import evaluate as E
from ..operators import models as M
from ..operators import regimes as G
from ..operators import trend as T
from ..operators import unsupervised as U
from .model_queries import FEATURES, _splits, model_rows
from .oracle import FIXTURE_ALL, lead
from .registry import hourly_all, query, rounded

PLAIN = ["move", "span", "volume"]


def _plain_rows(spark: SparkSession, d: str) -> DataFrame:
    """Three features of a bar, and whether the close five bars on is lower (0), equal (1) or higher (2)."""
    ahead = F.lead("close", 5).over(T.by_symbol())
    rows = hourly_all(spark, d).withColumns({"move": F.col("close") - F.col("open"), "span": F.col("high") - F.col("low"), "label": F.signum(ahead - F.col("close"))})
    return M.assembled(rows, PLAIN, "label").withColumn("weight", F.lit(1.0))


def _root_histograms(spark: SparkSession, d: str) -> DataFrame:
    plain = _plain_rows(spark, d).select(vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"), "weight")
    edges = B.cut_points(plain, [F.get("x", i) for i in range(len(PLAIN))], 8)
    root = tuple(np.array([v], kind) for v, kind in ((0, np.int64), (0, np.int64), (False, bool), (-1, np.int64), (-1, np.int64), (np.nan, float), (0.0, float)))
    return B.histograms(B.binned(plain, edges, 3), len(PLAIN), 3, [], [root] * 3)


_hist = f"""WITH {FIXTURE_ALL}, r AS (SELECT close - open AS move, high - low AS span, CAST(volume AS DOUBLE) AS volume, CAST(sign({lead('close', 5)} - close) + 1 AS INT) AS y FROM s0),
 x AS (SELECT row_number() OVER () AS i, unnest([0, 1, 2]) AS feature, unnest([move, span, volume]) AS v, y FROM r WHERE y IS NOT NULL),
 o AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS k, count(*) OVER (PARTITION BY feature) AS n FROM x),
 e AS (SELECT DISTINCT o.feature, o.v FROM o, (SELECT unnest(range(1, 8)) AS q) WHERE o.k = ceil(q * o.n / 8.0)),
 b AS (SELECT x.i, x.feature, x.y, 1 + count(e.v) AS bin FROM x LEFT JOIN e ON e.feature = x.feature AND e.v < x.v GROUP BY x.i, x.feature, x.y, x.v),
 h AS (SELECT CAST(c AS INT) AS class, feature, CAST(bin AS INT) AS bin, sum(1 / 3.0 - CASE WHEN y = c THEN 1 ELSE 0 END) AS g, count(*) * 2 / 9.0 AS h, count(*) AS n FROM b, (SELECT unnest([0, 1, 2]) AS c) GROUP BY 1, 2, 3)"""
query("boost_histogram", _hist + " SELECT class, feature, bin, round(CAST(g AS DOUBLE), 6) + 0.0 AS g, round(CAST(h AS DOUBLE), 6) + 0.0 AS h, CAST(n AS DOUBLE) AS n FROM h")(
    lambda spark, d: rounded(_root_histograms(spark, d).drop("node"), keys=("class", "feature", "bin")))
query("boost_root_split", _hist + """, t AS (SELECT class, feature, sum(g) AS gt, sum(h) AS ht, sum(n) AS nt FROM h GROUP BY 1, 2),
 c AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl FROM h JOIN t USING (class, feature) WINDOW w AS (PARTITION BY class, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM c WHERE nl < nt),
 f AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY gain DESC, feature, bin) AS k FROM s)
 SELECT class, feature, bin, round(CAST(gain AS DOUBLE), 5) + 0.0 AS gain, CAST(nl AS DOUBLE) AS nl FROM f WHERE k = 1""")(
    lambda spark, d: rounded(B.best_splits(B.split_gains(_root_histograms(spark, d))), ["gain", "nl"], 5, keys=("class", "feature", "bin")))


def _boosted(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold class probabilities of purged folds."""
    return M.out_of_fold(model_rows(spark, d), _splits(spark, d), B.SoftmaxBoosting(trees=6, depth=3, least=3, classes=3))


query("boosted_probabilities")(lambda spark, d: rounded(_boosted(spark, d), ["p_bear", "p_neutral", "p_bull"], keys=("split_id", "row_id", "true", "pred")))
query("boosting_scores")(lambda spark, d: rounded((p := _boosted(spark, d).persist()).transform(lambda x: E.scores(x, ("split_id",)).join(B.log_loss(p, ("split_id",)).drop("n"), "split_id")), keys=("split_id",)))


def _shap(spark: SparkSession, d: str) -> DataFrame:
    """Contributions to the rise class over a forest, with each row's regime."""
    rows = model_rows(spark, d)
    regimes = G.add_regimes(U.ewma(U.with_ret(hourly_all(spark, d)))).select("ts", "Regime_Combo")
    trees = S.forest_trees(M.forest(10, 4).fit(rows), 2)
    return S.tree_shap(trees, rows.join(regimes, "ts"), len(FEATURES), ("row_id", "Regime_Combo"))


query("tree_shap")(lambda spark, d: rounded(S.by_feature(_shap(spark, d), FEATURES), keys=("feature",)))
query("regime_shap")(lambda spark, d: rounded(S.by_regime(_shap(spark, d).persist(), FEATURES, "Regime_Combo"), keys=("Regime_Combo", "feature")))
