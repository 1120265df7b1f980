"""Queries over the clusters' inputs: scaled features, principal components free of signs, groups of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import unsupervised as U
from .oracle import FIXTURE, fr, roll, slope
from .pipeline import split_groups
from .registry import hourly, query, rounded

SCALED = [f"z_{c}" for c in U.CLUSTER_FEATURES]
COMPONENTS = 3
SQUARINGS = 14  # of a covariance, which leave its first direction alone

_eps = "1e-10::DOUBLE"
_features = f"""WITH RECURSIVE {FIXTURE},
 src AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0) AS r FROM s0),
 e AS (SELECT symbol, ts, rn, r * r AS v FROM src WHERE rn = 0 UNION ALL SELECT src.symbol, src.ts, src.rn, 0.94::DOUBLE * e.v + 0.06::DOUBLE * src.r * src.r FROM e JOIN src ON src.symbol = e.symbol AND src.rn = e.rn + 1),
 w AS (SELECT symbol, ts, abs(r) AS x2, coalesce({slope('close', 20)}, 0) AS x3, high - low AS x4,
   CASE WHEN count(close) OVER {fr(50)} = 50 THEN close - quantile_cont(close, 0.5) OVER {fr(50)} END / ({roll('stddev_samp(close)', 'close', 50)} + {_eps}) AS x5 FROM src),
 x AS (SELECT symbol, ts, sqrt(e.v) AS x1, x2, x3, x4, x5 FROM w JOIN e USING (symbol, ts) WHERE x5 IS NOT NULL),
 m AS (SELECT {', '.join(f'avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}' for i in range(1, 6))} FROM x),
 z AS (SELECT symbol, ts, {', '.join(f'(x{i} - m{i}) / (s{i} + {_eps}) AS z{i}' for i in range(1, 6))} FROM x, m)"""

query("scaled_features", _features + " SELECT symbol, ts, " + ", ".join(f'round(z{i}, 4) + 0.0 AS "{c}"' for i, c in enumerate(SCALED, 1)) + " FROM z")(
    lambda spark, d: rounded(U.scaled(U.features(hourly(spark, d)).na.drop(subset=list(U.CLUSTER_FEATURES)), U.CLUSTER_FEATURES), SCALED, 4))


def _directions() -> str:
    """For each component the projector on its direction: squares of the covariance, which what came before is taken out of."""
    trace = " + ".join(f"m[{i}][{i}]" for i in range(1, 6))
    out = " g1 AS (SELECT [" + ", ".join("[" + ", ".join(f"covar_pop(z{i}, z{j})" for j in range(1, 6)) + "]" for i in range(1, 6)) + "] AS m FROM z)"
    for k in range(1, COMPONENTS + 1):
        out += f""",
 i{k} AS (SELECT 0 AS step, m FROM g{k} UNION ALL SELECT step + 1, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / pow({trace}, 2))) FROM i{k} WHERE step < {SQUARINGS}),
 p{k} AS (SELECT list_transform(m, lambda a: list_transform(a, lambda v: v / ({trace}))) AS p FROM i{k} WHERE step = {SQUARINGS}),
 g{k + 1} AS (SELECT [{', '.join('[' + ', '.join(f'm[{i}][{j}] - v * p[{i}][{j}]' for j in range(1, 6)) + ']' for i in range(1, 6))}] AS m
   FROM (SELECT m, p, {' + '.join(f'list_dot_product(m[{i}], p[{i}])' for i in range(1, 6))} AS v FROM g{k}, p{k}))"""
    return out


def _square(k: int) -> str:
    row = "[" + ", ".join(f"z{i}" for i in range(1, 6)) + "]"
    return " + ".join(f"z{i} * list_dot_product({row}, p{k}.p[{i}])" for i in range(1, 6))


def _component_squares(spark: SparkSession, d: str) -> DataFrame:
    rows = U.components(U.features(hourly(spark, d)), k=COMPONENTS)
    return rounded(rows.select("symbol", "ts", *[F.pow(F.get("pca", k), 2).alias(f"pc{k + 1}_squared") for k in range(COMPONENTS)]), digits=4)


query("pca_squares", _features + "," + _directions() + " SELECT symbol, ts, " + ", ".join(f"round({_square(k)}, 4) + 0.0 AS pc{k}_squared" for k in range(1, COMPONENTS + 1)) + f" FROM z, {', '.join(f'p{k}' for k in range(1, COMPONENTS + 1))}")(_component_squares)


# ---- groups that a model is fitted or scored by
query("split_groups", f'WITH {FIXTURE} SELECT symbol, ts, CAST(ntile(5) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS INT) AS "group" FROM s0')(
    lambda spark, d: split_groups(hourly(spark, d)).select("symbol", "ts", F.col("group").cast("int").alias("group")))
