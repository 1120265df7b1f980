"""Queries over pair interactions, correlation reports, purged blocks, chunked deviations, multi-target models and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import interactions as I
from ..operators import labels as L
from ..operators import models as M
from ..operators import splits as C
from ..operators import trend as T
from ..sources.tables import scratch_dir
from ..streaming import live_bars as R
from .model_queries import FEATURES
from .oracle import RET, sql
from .registry import ORACLES, hourly, hourly_all, panel, query, rounded
from .research_queries import _dirs, _rows, _rw, _split, ppanel, preds, psql

# ---- interactions: contributions are stood in for by the fixture's probabilities
NAMES = ["high", "low", "close"]
VALUES = {"high": "p_bull", "low": "p_bear", "close": "p_neutral"}
EFFECTS = ["n", "beta", "beta_std", "r2", "diff", "cohens_d", "diff_abs", "cohens_d_abs", "mean_low", "mean_high"]


def _d(s: str) -> str:
    lo, hi = "FILTER (x <= q1)", "FILTER (x >= q3)"
    pooled = f"sqrt(((count(*) {lo} - 1) * var_samp({s}) {lo} + (count(*) {hi} - 1) * var_samp({s}) {hi}) / (count(*) {lo} + count(*) {hi} - 2))"
    return f"(avg({s}) {hi} - avg({s}) {lo}) / {pooled}"


def _effects(group: str) -> str:
    """All pairs' effects by SQL, over the columns of the fixture's last step."""
    over = f"OVER (PARTITION BY {group}, a, given)"
    pairs = " UNION ALL ".join(f"SELECT {group} AS g, '{a}' AS a, '{b}' AS given, {VALUES[a]} AS s, CAST({b} AS DOUBLE) AS x FROM s4" for a in NAMES for b in NAMES if a != b)
    return f"""(SELECT g, a AS x, given, count(*) AS n, regr_slope(s, x) * (stddev_pop(x) + 1e-10) AS beta, regr_slope(s, x) * (stddev_pop(x) + 1e-10) / (stddev_pop(s) + 1e-10) AS beta_std, regr_r2(s, x) AS r2,
      avg(s) FILTER (x >= q3) - avg(s) FILTER (x <= q1) AS diff, {_d('s')} AS cohens_d, avg(abs(s)) FILTER (x >= q3) - avg(abs(s)) FILTER (x <= q1) AS diff_abs, {_d('abs(s)')} AS cohens_d_abs, avg(s) FILTER (x <= q1) AS mean_low, avg(s) FILTER (x >= q3) AS mean_high
      FROM (SELECT *, quantile_cont(x, 0.25) {over.replace(group, 'g')} AS q1, quantile_cont(x, 0.75) {over.replace(group, 'g')} AS q3 FROM ({pairs})) GROUP BY g, a, given)"""


query("interaction_pairs", psql(out={n: n for n in EFFECTS} | {"abs_cohens_d": "abs(cohens_d)"}, keys=("x", "given", "CASE WHEN diff > 0 THEN 'MORE' ELSE 'LESS' END AS direction", "CASE WHEN abs(cohens_d) > 0.5 THEN 'strong' WHEN abs(cohens_d) > 0.2 THEN 'moderate' ELSE 'weak' END AS strength"), source=_effects("1")))(
    lambda spark, d: rounded(I.combined(preds(spark, d), NAMES, VALUES), [*EFFECTS, "abs_cohens_d"], keys=("x", "given", "direction", "strength")))
query("interaction_consistency", psql(out={"mean_d": "m", "std_d": "s", "mean_r2": "r", "same_sign": "k", "n_splits": "n"}, keys=("x", "given"), digits=5,
    source=f"(SELECT x, given, any_value(m) AS m, stddev_samp(cohens_d) AS s, avg(r2) AS r, avg(CASE WHEN sign(cohens_d) = sign(m) THEN 1.0 ELSE 0 END) AS k, count(*) AS n FROM (SELECT *, avg(cohens_d) OVER (PARTITION BY x, given) AS m FROM {_effects('fold')}) GROUP BY 1, 2)"))(
    lambda spark, d: rounded(I.consistency(preds(spark, d), NAMES, VALUES, "fold"), ["mean_d", "std_d", "mean_r2", "same_sign", "n_splits"], 5, ("x", "given")))

# ---- correlation reports
_BARS = ["high", "low", "volume", "Return"]
_LABELS = ["dir_1", "dir_5", "dir_20"]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return L.horizon_matrix(hourly(spark, d)).withColumn("Return", F.try_divide(F.col("close"), F.lag("close").over(T.by_symbol())) - 1)


def _corrs(y: str) -> str:
    return f"SELECT unnest(['high', 'low', 'volume', 'Return']) AS feature, 'dir_{y}' AS label, unnest([corr(high, d{y}), corr(low, d{y}), corr(volume, d{y}), corr(r, d{y})]) AS c FROM s1"


_all = " UNION ALL ".join(map(_corrs, ("1", "5", "20")))
_steps = _dirs | {"r": RET["r"]}
query("label_feature_correlation", sql(_steps, out={"corr": "c"}, keys=("feature", "label"), source=f"({_all})"))(
    lambda spark, d: rounded(E.label_correlations(_labelled(spark, d), _BARS, _LABELS), ["corr"], keys=("feature", "label")))
query("consensus_features", sql(_steps, out={"mean_abs_corr": "avg(abs(c))", "std_corr": "stddev_samp(c)", "n_labels": "count(*)"}, keys=("feature",), where="GROUP BY feature", source=f"({_all})"))(
    lambda spark, d: rounded(E.consensus_features(E.label_correlations(_labelled(spark, d), _BARS, _LABELS)), keys=("feature",)))
query("group_correlation", sql(_steps, out={"n_features": "count(*)", "mean_corr": "avg(c)", "std_corr": "stddev_samp(c)", "mean_abs_corr": "avg(abs(c))"}, keys=('g AS "group"',), where="GROUP BY g",
    source=f"(SELECT *, CASE feature WHEN 'volume' THEN 'VOL' WHEN 'Return' THEN 'RET' ELSE 'OTHER' END AS g FROM ({_corrs('5')}))"))(
    lambda spark, d: rounded(E.group_correlations(E.target_correlations(_labelled(spark, d), _BARS, "dir_5")), keys=("group",)))
query("weak_features", sql(_steps, out={"corr": "c", "share": "k / n"}, keys=("feature",), where="WHERE abs(c) < 0.1",
    source=f"(SELECT *, count(*) FILTER (abs(c) < 0.1) OVER () * 1.0 AS k, count(*) OVER () AS n FROM ({_corrs('5')}))"))(
    lambda spark, d: rounded(E.weak_features(E.target_correlations(_labelled(spark, d), _BARS, "dir_5"), 0.1), keys=("feature",)))
ppanel("rolling_error_by_class", lambda p: E.rolling_error(p, per_class=True), ["rolling_error"], psql(
    {"m": "CASE WHEN t <> pred THEN 1.0 ELSE 0 END"}, out={"rolling_error": "avg(m) OVER (PARTITION BY symbol, t ORDER BY ts ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)"}))

# ---- scale forms of splits and deviations
panel("ewm_vol_chunked", lambda b: L.label_vols(b, chunk=64), ["vol_ewma"], ORACLES["ewm_vol"])


def _many_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Three splits whose test rows are every ninth bar, each a block of its own."""
    rows = _rows(spark, d)
    tests = rows.withColumn("split_id", F.explode(F.array(*[F.lit(s) for s in range(3)]))).where((F.col("row_id") + F.col("split_id")) % 9 == 0)
    return _split(spark, C.purged(rows.withColumn("t1", F.col("t0")), tests.withColumn("t1", F.col("t0")), 1, False))


query("purge_by_block", _rw + """, s AS (SELECT CAST(unnest(range(3)) AS INT) AS split_id)
 SELECT split_id, row_id, CASE WHEN (row_id + split_id) % 9 = 0 THEN 'test' ELSE 'train' END AS role FROM r, s WHERE NOT ((row_id + split_id) % 9 = 1 AND row_id > 0)""")(_many_blocks)


# ---- several targets
def _targets(spark: SparkSession, d: str) -> DataFrame:
    rows = T.roc(T.reg_slope(T.prelim(hourly_all(spark, d)), (20,)), (10,))
    return L.horizon_matrix(rows).withColumn("Vol_20", F.stddev_samp("Return").over(T.trailing(20))).na.drop(subset=FEATURES)


query("multi_target")(lambda spark, d: rounded(M.target_scores(_targets(spark, d), FEATURES, ["dir_1", "dir_5", "dir_20"], M.forest(10, 4), "dir_5", ["dir_1", "dir_10", "dir_20"]), keys=("target",)))
panel("agreement_weights", lambda b: M.agreement_weight(M.agreement(L.horizon_matrix(b), "dir_5", ["dir_1", "dir_10", "dir_20"]), "agreement"), ["agreement", "weight"], sql(
    _dirs, {"k": "((CASE WHEN d1 = d5 THEN 1 ELSE 0 END) + (CASE WHEN d10 = d5 THEN 1 ELSE 0 END) + (CASE WHEN d20 = d5 THEN 1 ELSE 0 END)) / 3.0"}, out={"agreement": "k", "weight": "0.5 + 0.5 * k"}))


# ---- streams
def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars written in four steps of time, a file for some symbols each, and replayed as a stream."""
    folder = f"{scratch_dir(spark)}/replay-{uuid.uuid4().hex}"
    bars = hourly(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close")
    edges = bars.agg(F.percentile(F.unix_seconds("ts"), [0.25, 0.5, 0.75]).alias("e")).first()["e"] or []
    for lo, hi in zip([None, *edges], [*edges, None], strict=True):
        at = F.unix_seconds("ts")
        part = bars.where((at > lo) if lo is not None else F.lit(True)).where((at <= hi) if hi is not None else F.lit(True))
        part.repartition("symbol").write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    return R.run_to_files(R.stream_indicators(stream), folder)


query("stream_indicators", f"""SELECT e.symbol, CAST(e.ts AS TIMESTAMP) AS ts, e."EMA_20" AS ema, r."RSI_14" AS rsi FROM ({ORACLES['ema']}) e JOIN ({ORACLES['rsi']}) r ON r.symbol = e.symbol AND r.ts = e.ts""")(
    lambda spark, d: rounded(_streamed(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["ema", "rsi"]))
