"""Queries over labels, splits, simulation, evaluation, diagnostics and checks, with the SQL that checks each."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import row_id
from ..operators import backtest as P
from ..operators import bars as B
from ..operators import checks as H
from ..operators import diagnostics as D
from ..operators import evaluate as E
from ..operators import extensions as X
from ..operators import labels as L
from ..operators import normalize as N
from ..operators import regimes as G
from ..operators import splits as C
from ..operators import structure as ST
from ..operators import trend as T
from ..operators import volatility as V
from ..sources.tables import read_table
from .oracle import FIXTURE, FIXTURE_ALL, ALL, RET, RUN, W, avg, flag, fr, lag, lead, roll, slope, sql, std, top
from .registry import hourly, hourly_all, panel, query, rounded

# ---- labels
HS = (1, 5, 10, 20)


def _fwd(h: int, x: str = "close") -> str:
    return f"({lead(x, h)} / {x} - 1)"


panel("forward_returns", lambda b: L.forward_returns(L.forward_returns(b), log=True), [f"fwd_ret_{h}" for h in HS] + [f"fwd_ret_log_{h}" for h in HS], sql(out={f"fwd_ret_{h}": _fwd(h) for h in HS} | {f"fwd_ret_log_{h}": f"ln({lead('close', h)} / close)" for h in HS}))
panel("forward_rolling", lambda b: L.trim(L.rolling_forward(b, 12), (12,)), [f"fwd_{h}" for h in range(1, 13)], sql({f"f{h}": _fwd(h) for h in range(1, 13)} | {"n": f"count(*) OVER {ALL}"}, out={f"fwd_{h}": f"f{h}" for h in range(1, 13)}, where="WHERE n - rn - 1 >= 12"))
panel("excess_return", lambda b: L.excess_return(b, 5, "open"), ["excess_ret_5"], sql(out={"excess_ret_5": f"{_fwd(5)} - {_fwd(5, 'open')}"}))
_dirs = {f"d{h}": f"coalesce(sign({_fwd(h)}), 0)" for h in HS}
panel("horizon_matrix", L.horizon_matrix, [f"ret_{h}" for h in HS] + [f"dir_{h}" for h in HS], sql(_dirs, out={f"ret_{h}": _fwd(h) for h in HS} | {f"dir_{h}": f"d{h}" for h in HS}))
_most = "greatest(" + ", ".join("(" + " + ".join(f"(CASE WHEN d{h} = {v} THEN 1 ELSE 0 END)" for h in HS) + ")" for v in (-1, 0, 1)) + ") / 4.0"
panel("horizon_consensus", lambda b: L.consensus(L.horizon_matrix(b), [f"dir_{h}" for h in HS]), ["horizon_consensus", "horizon_agreement"], sql(_dirs, out={"horizon_consensus": "sign(" + " + ".join(f"d{h}" for h in HS) + ")", "horizon_agreement": _most}))
_va = {"r": RET["r"], "f": _fwd(20)}, {"vn": f"f / (({std('r', 20)}) + 1e-12)", "dd": f"(max(close) OVER {RUN} - close) / close"}
panel("vol_adjusted_labels", L.vol_adjusted, ["vol_norm_ret", "zscore_ret", "risk_adj_dir", "svr_target", "dd_adj_ret"], sql(
    *_va, out={"vol_norm_ret": "vn", "zscore_ret": f"(f - ({avg('f', 100)})) / (({std('f', 100)}) + 1e-12)", "risk_adj_dir": "CASE WHEN vn > 0.5 THEN 1 WHEN vn < -0.5 THEN -1 ELSE 0 END", "svr_target": "vn", "dd_adj_ret": f"f - ({top('dd', 20)})"}))
_reg = {"s": slope("close", 50)}, {"z": f"(s - avg(s) OVER {ALL}) / (stddev_samp(s) OVER {ALL} + 1e-10)"}, {"c": "CASE WHEN z > 0.5 THEN 1 WHEN z < -0.5 THEN -1 ELSE 0 END"}
panel("trend_labels", lambda b: L.regime_label(L.vol_trend_label(L.trend_label(G.trend_regime(b)))), ["trend_label", "vol_trend_label", "regime_label"], sql(
    *_reg, RET, out={"trend_label": f"sign({_fwd(20)})", "vol_trend_label": f"sign({_fwd(20)} / (({std('r', 20)}) + 1e-10))", "regime_label": f"sign({_fwd(20)}) * CASE WHEN c = 0 THEN 1 ELSE c END"}))
panel("ensemble_labels", lambda b: L.ensemble_sources(L.ensemble(L.horizon_matrix(b), {"dir_1": 2.0, "dir_5": 1.0, "dir_10": 1.5, "dir_20": 1.0}), [f"dir_{h}" for h in HS]), ["ensemble_label", "ensemble_conf", "ensemble_vote", "ensemble_strength", "ensemble_agreement"], sql(
    _dirs, {"t": "d1 + d5 + d10 + d20"}, out={"ensemble_label": "sign(2 * d1 + d5 + 1.5 * d10 + d20)", "ensemble_conf": "(" + " + ".join(f"(CASE WHEN d{h} = sign(t) THEN 1 ELSE 0 END)" for h in HS) + ") / 4.0", "ensemble_vote": "sign(t)", "ensemble_strength": "t", "ensemble_agreement": _most}))
query("vertical_barrier", f"""{sql(out=['close']).rsplit(' SELECT symbol', 1)[0]}
  SELECT a.symbol, a.ts, (SELECT min(b.ts) FROM s0 b WHERE b.symbol = a.symbol AND b.ts >= a.ts + INTERVAL 5 HOUR) AS t1 FROM s0 a""")(
    lambda spark, d: L.vertical_barrier(hourly(spark, d), 5 * 3600).select("symbol", "ts", "t1"))


def _fixed_events(spark: SparkSession, d: str) -> DataFrame:
    rows = L.vertical_barrier(hourly(spark, d), 12 * 3600).withColumn("vol", F.lit(0.02))
    return L.event_table(rows, "vol", 1.0, 1.0)


_ev = f"""WITH {sql(out=['close']).split('WITH RECURSIVE ', 1)[1].rsplit(' SELECT symbol', 1)[0]},
 v AS (SELECT a.symbol, a.ts AS t0, a.close AS p0, (SELECT min(b.ts) FROM s0 b WHERE b.symbol = a.symbol AND b.ts >= a.ts + INTERVAL 12 HOUR) AS t1 FROM s0 a),
 m AS (SELECT v.symbol, v.t0, v.t1, s0.ts, s0.close / v.p0 - 1 AS r FROM v JOIN s0 ON s0.symbol = v.symbol AND s0.ts BETWEEN v.t0 AND v.t1),
 g AS (SELECT symbol, t0, t1, min(ts) FILTER (r >= 0.02) AS tp, min(ts) FILTER (r <= -0.02) AS tn, max(ts) AS tl, arg_min(r, ts) FILTER (r >= 0.02) AS rp, arg_min(r, ts) FILTER (r <= -0.02) AS rn_, arg_max(r, ts) AS rl FROM m GROUP BY 1, 2, 3)"""
for _name, _touch, _win in (("triple_barrier", False, "tp IS NOT NULL"), ("triple_barrier_first_touch", True, "tp IS NOT NULL AND (tn IS NULL OR tp <= tn)")):
    query(_name, _ev + f""" SELECT symbol, t0, t1, CASE WHEN {_win} THEN tp WHEN tn IS NOT NULL THEN tn ELSE tl END AS t_end, CAST(CASE WHEN {_win} THEN 1 WHEN tn IS NOT NULL THEN -1 ELSE sign(rl) END AS DOUBLE) AS label,
      round(CASE WHEN {_win} THEN rp WHEN tn IS NOT NULL THEN rn_ ELSE rl END, 6) AS ret FROM g""")(
        lambda spark, d, touch=_touch: L.barrier_outcomes(_fixed_events(spark, d), hourly(spark, d), touch).select("symbol", "t0", "t1", "t_end", "label", F.round("ret", 6).alias("ret")))
#: the debiased deviation under weights that fall by 2 / 101 a row, from the sums of all weights so far
_EWM = "CASE WHEN n > 1 THEN sqrt(greatest((s2 / w - pow(s1 / w, 2)) * w * w / (w * w - w2), 0)) END"


def _ewm(source: str) -> str:
    weight = f"pow({99 / 101}, a.rn - b.rn)"
    return f"(SELECT a.symbol, a.ts, count(*) AS n, sum({weight}) AS w, sum(pow({weight}, 2)) AS w2, sum({weight} * b.r) AS s1, sum({weight} * b.r * b.r) AS s2 FROM {source} a LEFT JOIN {source} b ON b.symbol = a.symbol AND b.rn <= a.rn AND b.r IS NOT NULL GROUP BY 1, 2)"


panel("triple_barrier_workflow", lambda b: L.triple_barrier(b, 12 * 3600), ["label", "event_ret"], _ev.split(" m AS", 1)[0] + f""" s1 AS (SELECT *, {RET['r']} AS r FROM s0),
 e AS (SELECT symbol, ts AS t0, {_EWM} AS vol FROM {_ewm("s1")}),
 x AS (SELECT v.*, e.vol FROM v JOIN e ON e.symbol = v.symbol AND e.t0 = v.t0 WHERE v.t1 IS NOT NULL AND e.vol > 0),
 m AS (SELECT x.symbol, x.t0, x.vol, s0.ts, s0.close / x.p0 - 1 AS r FROM x JOIN s0 ON s0.symbol = x.symbol AND s0.ts BETWEEN x.t0 AND x.t1),
 g AS (SELECT symbol, t0, min(ts) FILTER (r >= vol) AS tp, min(ts) FILTER (r <= -vol) AS tn, arg_min(r, ts) FILTER (r >= vol) AS rp, arg_min(r, ts) FILTER (r <= -vol) AS rs, arg_max(r, ts) AS rl FROM m GROUP BY 1, 2)
 SELECT s0.symbol, s0.ts, CAST(coalesce(CASE WHEN tp IS NOT NULL THEN 1 WHEN tn IS NOT NULL THEN -1 ELSE sign(rl) END, 0) AS DOUBLE) AS label,
   round(CASE WHEN tp IS NOT NULL THEN rp WHEN tn IS NOT NULL THEN rs ELSE rl END, 6) + 0.0 AS event_ret FROM s0 LEFT JOIN g ON g.symbol = s0.symbol AND g.t0 = s0.ts""")


def _sided(b: DataFrame) -> DataFrame:
    return L.trend_label(b, 5, "label").withColumn("label", F.coalesce("label", F.lit(0.0))).withColumns({"rn": row_id()}).withColumn("side", F.col("rn") % 3 - 1)


_sd = {"label": f"coalesce(sign({_fwd(5)}), 0)", "side": "rn % 3 - 1"}
panel("meta_label", lambda b: L.meta_by_equality(_sided(b)), ["meta_label"], sql(_sd, out={"meta_label": "CASE WHEN side = 0 THEN 0 WHEN label = side THEN 1 ELSE -1 END"}))
panel("meta_label_product", lambda b: L.meta_by_product(_sided(b)), ["meta_label"], sql(_sd, out={"meta_label": "sign(label * side)"}))
panel("label_streak", lambda b: L.label_features(_sided(b)), ["LBL_prev", "LBL_flip", "LBL_streak", "LBL_momentum_5", "LBL_consistency_5"], sql(
    _sd, {"l": lag("label"), "p": lag("label", 2)}, {"fl": flag("l IS NULL OR p IS NULL OR l <> p")}, {"run": f"sum(fl) OVER {RUN}"},
    out={"LBL_prev": "l", "LBL_flip": "fl", "LBL_streak": "row_number() OVER (PARTITION BY symbol, run ORDER BY ts)", "LBL_momentum_5": avg("l", 5),
         "LBL_consistency_5": f"CASE WHEN count(l) OVER {fr(5)} = 5 THEN greatest(" + ", ".join(f"sum(CASE WHEN l = {v} THEN 1 ELSE 0 END) OVER {fr(5)}" for v in (-1, 0, 1)) + ") / 5.0 END"}))
panel("label_vols", L.label_vols, ["vol_parkinson", "vol_garman_klass", "vol_rogers_satchell", "vol_yang_zhang", "vol_return"], sql(
    {"r": RET["r"], "pk": f"pow(ln(high / low), 2) / {4 * math.log(2)}", "gk": f"0.5 * pow(ln(high / low), 2) - {2 * math.log(2) - 1} * pow(ln(close / open), 2)", "rs": "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)", "o": f"ln(open / {lag('close')})", "oc": "ln(close / open)"},
    {"mpk": avg("pk", 30), "mgk": avg("gk", 30), "mrs": avg("rs", 30), "yz": f"({roll('var_samp(o)', 'o', 30)}) + ({roll('var_samp(oc)', 'oc', 30)}) + ({avg('rs', 30)})", "sr": std("r", 30)},
    out={"vol_parkinson": "CASE WHEN mpk >= 0 THEN sqrt(mpk) END", "vol_garman_klass": "CASE WHEN mgk >= 0 THEN sqrt(mgk) END", "vol_rogers_satchell": "CASE WHEN mrs >= 0 THEN sqrt(mrs) END", "vol_yang_zhang": "CASE WHEN yz >= 0 THEN sqrt(yz) END", "vol_return": "sr"}, digits=5), 5)
panel("ewm_vol", L.label_vols, ["vol_ewma"], sql(RET, more="", out={"vol_ewma": _EWM}, source=_ewm("s1")))
panel("quantile_regime", lambda b: L.quantile_regime(V.basic(b), "Vol_20"), ["vol_regime"], sql(RET, {"v": std("r", 20)}, out={"vol_regime": "CASE WHEN v IS NOT NULL THEN " + " + ".join(f"(CASE WHEN v > quantile_cont(v, {q}) OVER {ALL} THEN 1 ELSE 0 END)" for q in (0.25, 0.5, 0.75)) + " END"}))
query("label_correlation", sql(_dirs, out={"corr": "corr"}, keys=("a", "b"), source="(SELECT unnest(['dir_1', 'dir_1', 'dir_5']) AS a, unnest(['dir_5', 'dir_10', 'dir_10']) AS b, unnest([corr(d1, d5), corr(d1, d10), corr(d5, d10)]) AS corr FROM s1)"))(
    lambda spark, d: rounded(L.correlations(L.horizon_matrix(hourly(spark, d)), ["dir_1", "dir_5", "dir_10"]), ["corr"], keys=("a", "b")))
_fe = """, ev AS (SELECT symbol, t0, t1 FROM v WHERE t1 IS NOT NULL), first AS (SELECT symbol, min(t0) AS t0 FROM ev GROUP BY 1)"""


def _kept(later: str) -> str:
    """Greedy selection: the first event, then always the first later one for which ``later`` holds."""
    return _ev.split(" m AS", 1)[0].rstrip().rstrip(",").replace("WITH ", "WITH RECURSIVE ", 1) + _fe + f""", nx AS (SELECT a.symbol, a.t0, min(b.t0) AS t2 FROM ev a JOIN ev b ON b.symbol = a.symbol AND b.t0 > a.t0 AND {later} GROUP BY 1, 2),
 z AS (SELECT symbol, t0 FROM first UNION ALL SELECT z.symbol, nx.t2 FROM z JOIN nx ON nx.symbol = z.symbol AND nx.t0 = z.t0)
 SELECT ev.symbol, ev.t0, ev.t1, 0.02::DOUBLE AS vol, 0.02::DOUBLE AS pt, -0.02::DOUBLE AS sl FROM z JOIN ev ON ev.symbol = z.symbol AND ev.t0 = z.t0"""


query("events_spaced", _kept("CAST(epoch(b.t0 - a.t0) AS BIGINT) % 86400 >= 21600"))(lambda spark, d: L.spaced(_fixed_events(spark, d), 6 * 3600))
query("events_without_overlap", _kept("b.t0 >= a.t1"))(lambda spark, d: L.without_overlap(_fixed_events(spark, d)))


# ---- splits: rows are the hourly bars of all events, spans reach 5 bars ahead
def _rows(spark: SparkSession, d: str) -> DataFrame:
    return _spans(hourly_all(spark, d))


def _spans(one: DataFrame) -> DataFrame:
    return C.numbered(one.withColumn("t1", F.lead("ts", 5).over(T.by_symbol())), "ts", "t1").drop("symbol")


_rw = f"""WITH {FIXTURE_ALL},
 r AS (SELECT CAST(rn AS INT) AS row_id, ts AS t0, coalesce(lead(ts, 5) OVER (ORDER BY ts), ts) AS t1 FROM s0), n AS (SELECT count(*) AS n FROM r),
 f AS (SELECT *, CAST(ntile(6) OVER (ORDER BY row_id) - 1 AS INT) AS fold FROM r)"""


def _split(spark: SparkSession, splits: DataFrame) -> DataFrame:
    return splits.select(F.col("split_id").cast("int").alias("split_id"), F.col("row_id").cast("int").alias("row_id"), "role")


query("kfold_purged", _rw + """, b AS (SELECT fold AS split_id, min(t0) AS a, max(t1) AS z, max(row_id) AS l FROM f GROUP BY 1)
 SELECT b.split_id, f.row_id, CASE WHEN f.fold = b.split_id THEN 'test' ELSE 'train' END AS role FROM f, b WHERE f.fold = b.split_id OR NOT ((f.t0 <= b.z AND f.t1 >= b.a) OR (f.row_id > b.l AND f.row_id <= b.l + 10))""")(
    lambda spark, d: _split(spark, C.purged_kfold(_rows(spark, d), 6, 10)))
query("cpcv", _rw + """, c AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS split_id, x, y FROM (SELECT unnest(range(6)) AS x), (SELECT unnest(range(6)) AS y) WHERE x < y),
 b AS (SELECT split_id, x, y, min(t0) AS a, max(t1) AS z FROM c JOIN f ON fold IN (x, y) GROUP BY 1, 2, 3), e AS (SELECT fold, max(row_id) AS l FROM f GROUP BY 1)
 SELECT CAST(b.split_id AS INT) AS split_id, f.row_id, CASE WHEN f.fold IN (x, y) THEN 'test' ELSE 'train' END AS role FROM f, b WHERE f.fold IN (x, y) OR NOT ((f.t0 <= b.z AND f.t1 >= b.a)
   OR EXISTS (SELECT 1 FROM e WHERE e.fold IN (x, y) AND NOT (e.fold = x AND y = x + 1) AND f.row_id > e.l AND f.row_id <= e.l + 5))""")(lambda spark, d: _split(spark, C.combinatorial(_rows(spark, d), 6, 2, 5)))
query("walk_forward", _rw + """, w AS (SELECT i AS split_id, i * 40 AS a FROM (SELECT unnest(range(1000)) AS i), n WHERE i * 40 + 240 <= n.n)
 SELECT CAST(split_id AS INT) AS split_id, row_id, CASE WHEN row_id >= a + 200 THEN 'test' ELSE 'train' END AS role FROM r, w WHERE row_id >= a AND row_id < a + 240""")(lambda spark, d: _split(spark, C.walk_forward(_rows(spark, d), 200, 40)))
query("walk_forward_expanding_purged", _rw + """, w AS (SELECT i AS split_id, i * 40 AS a FROM (SELECT unnest(range(1000)) AS i), n WHERE i * 40 + 240 <= n.n), b AS (SELECT split_id, a, min(t0) AS x, max(t1) AS z FROM w JOIN r ON row_id >= a + 200 AND row_id < a + 240 GROUP BY 1, 2)
 SELECT CAST(split_id AS INT) AS split_id, row_id, CASE WHEN row_id >= a + 200 THEN 'test' ELSE 'train' END AS role FROM r, b WHERE row_id < a + 240 AND (row_id >= a + 200 OR NOT (t0 <= z AND t1 >= x))""")(
    lambda spark, d: _split(spark, C.walk_forward(_rows(spark, d), 200, 40, expanding=True, purge=True)))
query("grouped_time", _rw + """, p AS (SELECT d, ntile(5) OVER (ORDER BY d) - 1 AS own FROM (SELECT DISTINCT CAST(t0 AS DATE) AS d FROM r))
 SELECT CAST(s AS INT) AS split_id, row_id, CASE WHEN own = s THEN 'test' ELSE 'train' END AS role FROM r JOIN p ON p.d = CAST(t0 AS DATE), (SELECT unnest(range(5)) AS s)""")(lambda spark, d: _split(spark, C.grouped_time(_rows(spark, d), 5)))
query("clustered_blocks")(lambda spark, d: _split(spark, C.clustered(_spans(hourly_all(spark, d)).withColumn("k", F.col("row_id") % 7 % 3), "k", 5, embargo=3)))
query("leakage_audit", _rw + """, b AS (SELECT fold AS split_id, min(t0) AS a, max(t0) AS z, count(*) AS n_test FROM f GROUP BY 1)
 SELECT b.split_id, b.n_test, count(*) AS n_train, sum(CASE WHEN f.t0 <= b.z AND f.t1 >= b.a THEN 1 ELSE 0 END)::BIGINT AS n_overlap FROM f, b WHERE f.fold <> b.split_id GROUP BY 1, 2""")(
    lambda spark, d: C.audit(C.purged_kfold(_rows(spark, d), 6, 0, purge=False), _rows(spark, d)).select("split_id", "n_test", "n_train", "n_overlap"))
query("split_summary", _rw + " SELECT fold AS split_id, (SELECT n FROM n) - count(*) AS n_train, count(*) AS n_test, min(row_id) AS test_from, max(row_id) AS test_to FROM f GROUP BY 1")(lambda spark, d: C.summary(_split(spark, C.purged_kfold(_rows(spark, d), 6, 0, purge=False))))


def _vol_rows(spark: SparkSession, d: str) -> DataFrame:
    return V.basic(hourly_all(spark, d)).withColumn("row_id", row_id()).select("row_id", F.col("Vol_20").alias("vol"), F.col("ts").alias("t0"))


query("adaptive_embargo", f"""WITH {sql(RET, {'v': std('r', 20)}, out=['v']).split('WITH RECURSIVE ', 1)[1].rsplit(' SELECT symbol', 1)[0].replace(FIXTURE, FIXTURE_ALL)},
 q AS (SELECT CAST(rn AS INT) AS row_id, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM s2),
 z AS (SELECT row_id, ceil(2.0 * v / quantile_cont(v, 0.5) OVER (ORDER BY row_id ROWS 49 PRECEDING)) AS len, ntile(6) OVER (ORDER BY row_id) - 1 AS fold FROM q),
 b AS (SELECT fold AS split_id, min(row_id) AS a, max(row_id) AS e, max(len) AS len FROM z GROUP BY 1)
 SELECT CAST(split_id AS INT) AS split_id, row_id FROM z, b WHERE fold <> split_id AND row_id >= a - b.len AND row_id <= e + b.len""")(
    lambda spark, d: C.adaptive_embargo(_vol_rows(spark, d), C.folds(_vol_rows(spark, d).withColumn("t1", F.col("t0")), 6).withColumnRenamed("fold", "split_id")).select(F.col("split_id").cast("int").alias("split_id"), F.col("row_id").cast("int").alias("row_id")))


# ---- simulation on deterministic pseudo-predictions
def preds(spark: SparkSession, d: str) -> DataFrame:
    rows = L.trend_label(hourly(spark, d), 5, "t").withColumn("rn", row_id())
    a, b = ((F.col("rn") * m + F.length("symbol") * k) % 1000 / 1000 + 0.1 for m, k in ((7919, 13), (104729, 7)))
    rows = rows.withColumns({"__a": a, "__b": b}).withColumn("__s", F.col("__a") + F.col("__b") + 0.6)
    rows = rows.withColumns({"p_bull": F.col("__a") / F.col("__s"), "p_bear": F.col("__b") / F.col("__s"), "p_neutral": 0.6 / F.col("__s")})
    best = F.greatest("p_bear", "p_neutral", "p_bull")
    pred = F.when(F.col("p_bear") == best, -1).when(F.col("p_neutral") == best, 0).otherwise(1)
    return rows.select("symbol", "ts", "rn", "close", "high", "low", F.coalesce("t", F.lit(0.0)).cast("int").alias("true"), pred.alias("pred"), "p_bear", "p_neutral", "p_bull", (F.col("rn") % 5).cast("int").alias("fold"))


_pp = (
    {"t": f"coalesce(sign({_fwd(5)}), 0)", "wa": "(rn * 7919 + length(symbol) * 13) % 1000 / 1000.0 + 0.1::DOUBLE", "wb": "(rn * 104729 + length(symbol) * 7) % 1000 / 1000.0 + 0.1::DOUBLE"},
    {"p_bull": "wa / (wa + wb + 0.6::DOUBLE)", "p_bear": "wb / (wa + wb + 0.6::DOUBLE)", "p_neutral": "0.6::DOUBLE / (wa + wb + 0.6::DOUBLE)"},
    {"best": "greatest(p_bear, p_neutral, p_bull)"},
    {"pred": "CASE WHEN p_bear = best THEN -1 WHEN p_neutral = best THEN 0 ELSE 1 END", "fold": "rn % 5"},
)


def psql(*steps: dict[str, str], **kw) -> str:
    return sql(*_pp, *steps, **kw)


def ppanel(name: str, op, columns: list[str], oracle: str | None = None, digits: int = 6) -> None:
    query(name, oracle)(lambda spark, d: rounded(op(preds(spark, d)), columns, digits))


_sig = {"signal_direct": "pred", "signal_thresh": "CASE WHEN best > 0.5 AND pred <> 0 THEN pred ELSE 0 END", "net": "p_bull - p_bear"}, {"signal_net": "CASE WHEN net > 0.25 THEN 1 WHEN net < -0.25 THEN -1 ELSE 0 END"}
ppanel("signals", P.signals, ["signal_direct", "signal_thresh", "signal_net", "net_prob"], psql(*_sig, out={"signal_direct": "signal_direct", "signal_thresh": "signal_thresh", "signal_net": "signal_net", "net_prob": "net"}))


def _bt(spark: SparkSession, d: str, strategies: tuple[str, ...] = ("net",)) -> DataFrame:
    rows = P.with_market(P.signals(preds(spark, d)), hourly(spark, d))
    for s in strategies:
        rows = P.backtest(rows, f"signal_{s}", s)
    return rows


_bs = (*_sig, {"returns": f"coalesce({RET['r']}, 0)", "ex": f"coalesce({lag('signal_net')}, 0)"}, {"tr": f"abs(coalesce(ex - {lag('ex')}, 0))"}, {"pn": "ex * returns * close * 20 - tr * 27.5"}, {"eq": f"sum(pn) OVER {RUN}"}, {"dd": f"eq - max(eq) OVER {RUN}", "day": "CAST(ts AS DATE)"})
query("backtest", psql(*_bs, out={"net_exec": "ex", "net_trade": "tr", "net_pnl_net": "pn", "net_equity": "eq", "net_drawdown": "dd"}, digits=4))(lambda spark, d: rounded(_bt(spark, d), ["net_exec", "net_trade", "net_pnl_net", "net_equity", "net_drawdown"], 4))
_daily = "(SELECT k.symbol, k.day, coalesce(sum(pn), 0) AS pn FROM (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s{n} GROUP BY symbol) k LEFT JOIN s{n} ON s{n}.symbol = k.symbol AND s{n}.day = k.day GROUP BY 1, 2)"
_nb = len(_pp) + len(_bs)
query("daily_pnl", psql(*_bs, out={"net_pnl_net": "pn"}, keys=("symbol", "day"), source=_daily.format(n=_nb), digits=4))(lambda spark, d: rounded(P.daily_pnl(_bt(spark, d), "net_pnl_net"), ["net_pnl_net"], 4, ("symbol", "day")))
query("risk_metrics", psql(
    *_bs, out={"total_pnl": "total", "max_drawdown": "mdd", "win_rate": "wr", "n_trades": "nt", "sharpe": "sh", "sortino": "so"}, keys=("symbol",), digits=4,
    source=f"(SELECT symbol, sum(pn) AS total, min(dd) AS mdd, avg(CASE WHEN pn > 0 THEN 1.0 ELSE 0 END) AS wr, sum(tr) AS nt FROM s{_nb} GROUP BY 1) JOIN (SELECT symbol, sqrt(252) * avg(pn) / stddev_samp(pn) AS sh, sqrt(252) * avg(pn) / (stddev_samp(pn) FILTER (pn < 0)) AS so FROM {_daily.format(n=_nb)} GROUP BY 1) USING (symbol)"))(
    lambda spark, d: rounded(P.risk_metrics(_bt(spark, d), "net"), ["total_pnl", "max_drawdown", "win_rate", "n_trades", "sharpe", "sortino"], 4, ("symbol",)))
query("rolling_sharpe", psql(*_bs, out={"rolling_sharpe": "CASE WHEN count(pn) OVER w >= 5 THEN sqrt(252) * avg(pn) OVER w / (stddev_samp(pn) OVER w + 1e-9) END"}, keys=("symbol", "day"), source=_daily.format(n=_nb), where="WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING)", digits=4))(
    lambda spark, d: rounded(P.rolling_sharpe(P.daily_pnl(_bt(spark, d), "net_pnl_net"), "net_pnl_net"), ["rolling_sharpe"], 4, ("symbol", "day")))
query("period_pnl", psql(*_bs, out={"net_pnl_net": "pn"}, keys=("symbol", "period_end"), digits=4, source=f"(SELECT symbol, CAST(date_trunc('week', day) + INTERVAL 6 DAY AS DATE) AS period_end, sum(pn) AS pn FROM s{_nb} GROUP BY 1, 2)"))(
    lambda spark, d: rounded(P.period_pnl(P.daily_pnl(_bt(spark, d), "net_pnl_net"), "net_pnl_net"), ["net_pnl_net"], 4, ("symbol", "period_end")))
query("regime_pnl", psql(
    *_bs, out={"total_pnl": "sum(p)", "n_days": "count(*)", "win_rate": "avg(CASE WHEN p > 0 THEN 1.0 ELSE 0 END)", "profit_factor": "avg(p) FILTER (p > 0) / abs(avg(p) FILTER (p < 0))", "sharpe": "sqrt(252) * avg(p) / (stddev_samp(p) + 1e-9)", "max_drawdown": "min(dd)"}, keys=("symbol", "fold"), digits=4,
    source=f"(SELECT *, e - max(e) OVER w AS dd FROM (SELECT *, sum(p) OVER w AS e FROM (SELECT symbol, CAST(fold AS INT) AS fold, day, sum(pn) AS p FROM s{_nb} GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY symbol, fold ORDER BY day)) WINDOW w AS (PARTITION BY symbol, fold ORDER BY day))", where="GROUP BY symbol, fold"))(
    lambda spark, d: rounded(P.regime_pnl(_bt(spark, d), "net_pnl_net", "fold"), ["total_pnl", "n_days", "win_rate", "profit_factor", "sharpe", "max_drawdown"], 4, ("symbol", "fold")))
query("exposure", psql(*_bs, out={"mean_exposure": "avg(abs(ex))", "share_long": "avg(CASE WHEN ex > 0 THEN 1.0 ELSE 0 END)", "share_short": "avg(CASE WHEN ex < 0 THEN 1.0 ELSE 0 END)", "share_flat": "avg(CASE WHEN ex = 0 THEN 1.0 ELSE 0 END)", "turnover": "sum(tr) / (epoch(max(ts) - min(ts)) / 86400 / 365)"}, keys=("symbol",), where="GROUP BY symbol"))(
    lambda spark, d: rounded(P.exposure(_bt(spark, d), "net"), ["mean_exposure", "share_long", "share_short", "share_flat", "turnover"], keys=("symbol",)))
query("pnl_distribution", psql(*_bs, out={"mean": "avg(pn)", "std": "stddev_samp(pn)", "skew": "skewness(pn)", "kurtosis": "kurtosis(pn)"}, keys=("symbol",), digits=4, source=_daily.format(n=_nb), where="GROUP BY symbol"))(
    lambda spark, d: rounded(P.distribution(P.daily_pnl(_bt(spark, d), "net_pnl_net"), "net_pnl_net"), ["mean", "std", "skew", "kurtosis"], 4, ("symbol",)))
query("vol_target", psql(*_bs, out={"net_pnl_net_scaled": f"pn * 0.1 / (stddev_samp(pn) OVER {ALL} * sqrt(252) + 1e-9)"}, keys=("symbol", "day"), source=_daily.format(n=_nb)))(
    lambda spark, d: rounded(P.vol_target(P.daily_pnl(_bt(spark, d), "net_pnl_net"), "net_pnl_net"), ["net_pnl_net_scaled"], 6, ("symbol", "day")))


def _strategies(spark: SparkSession, d: str) -> DataFrame:
    names = ("direct", "thresh", "net")
    rows = _bt(spark, d, names)
    return reduce(DataFrame.union, [P.risk_metrics(rows, s).withColumn("strategy", F.lit(s)) for s in names])


_three = ("direct", "thresh", "net")
_rank_steps = (
    *_sig, {"returns": f"coalesce({RET['r']}, 0)", "day": "CAST(ts AS DATE)"} | {f"ex_{s}": f"coalesce({lag(f'signal_{s}')}, 0)" for s in _three}, {f"tr_{s}": f"abs(coalesce(ex_{s} - {lag(f'ex_{s}')}, 0))" for s in _three},
    {f"pn_{s}": f"ex_{s} * returns * close * 20 - tr_{s} * 27.5" for s in _three}, {f"eq_{s}": f"sum(pn_{s}) OVER {RUN}" for s in _three}, {f"dd_{s}": f"eq_{s} - max(eq_{s}) OVER {RUN}" for s in _three},
)
_nr = len(_pp) + len(_rank_steps)
_one_strategy = (
    "SELECT symbol, '{s}' AS strategy, total_pnl, max_drawdown, win_rate, sharpe, sortino FROM (SELECT symbol, sum(pn_{s}) AS total_pnl, min(dd_{s}) AS max_drawdown, avg(CASE WHEN pn_{s} > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM s{n} GROUP BY 1)"
    " JOIN (SELECT symbol, sqrt(252) * avg(p) / nullif(stddev_samp(p), 0) AS sharpe, sqrt(252) * avg(p) / nullif(stddev_samp(p) FILTER (p < 0), 0) AS sortino FROM (SELECT k.symbol, k.day, coalesce(sum(pn_{s}), 0) AS p FROM"
    " (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s{n} GROUP BY symbol) k LEFT JOIN s{n} ON s{n}.symbol = k.symbol AND s{n}.day = k.day GROUP BY 1, 2) GROUP BY 1) USING (symbol)"
)
_shared_rank = "rank() OVER (PARTITION BY symbol ORDER BY {m} DESC NULLS LAST) + (count(*) OVER (PARTITION BY symbol, {m}) - 1) / 2.0"
query("strategy_rank", psql(
    *_rank_steps, out={"mean_rank": " + ".join(f"r_{m}" for m in ("total_pnl", "sharpe", "sortino", "max_drawdown", "win_rate")).join(("(", ") / 5")), "rank_sharpe": "r_sharpe", "total_pnl": "total_pnl"}, keys=("symbol", "strategy"),
    source="(SELECT *, " + ", ".join(f"{_shared_rank.format(m=m)} AS r_{m}" for m in ("total_pnl", "sharpe", "sortino", "max_drawdown", "win_rate")) + " FROM (" + " UNION ALL ".join(_one_strategy.format(s=s, n=_nr) for s in _three) + "))"))(lambda spark, d: rounded(P.rank_strategies(_strategies(spark, d)), ["mean_rank", "rank_sharpe", "total_pnl"], keys=("symbol", "strategy")))


def _series(spark: SparkSession, d: str) -> DataFrame:
    rows = P.signals(preds(spark, d)).withColumn("r", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(T.by_symbol())) - 1, F.lit(0.0)))
    rows = rows.withColumn("s", F.coalesce(F.lag("signal_net").over(T.by_symbol()), F.lit(0)) * F.col("r") * 0.1)
    return rows.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("s").alias("strategy"), (F.avg("r") * 0.1).alias("benchmark"))


query("comparison", psql(
    *_sig, {"r": f"coalesce({RET['r']}, 0)", "sg": f"coalesce({lag('signal_net')}, 0)"},
    out={"total_return": "exp(sum(ln(1 + s))) - 1", "benchmark_return": "exp(sum(ln(1 + b))) - 1", "sharpe": "sqrt(252) * avg(s) / stddev_samp(s)", "value_at_risk": "quantile_cont(s, 0.05)", "tracking_error": "sqrt(252) * stddev_samp(s - b)", "information_ratio": "sqrt(252) * avg(s - b) / stddev_samp(s - b)"},
    keys=("symbol",), source=f"(SELECT symbol, CAST(ts AS DATE) AS day, sum(sg * r * 0.1) AS s, avg(r) * 0.1 AS b FROM s{len(_pp) + 3} GROUP BY 1, 2)", where="GROUP BY symbol", digits=5))(
    lambda spark, d: rounded(P.comparison(_series(spark, d)), ["total_return", "benchmark_return", "sharpe", "value_at_risk", "tracking_error", "information_ratio"], 5, ("symbol",)))
panel("buy_and_hold", P.buy_and_hold, ["growth"], sql(out={"growth": f"close / first(close) OVER {RUN}"}))
query("inference", psql(out={"signal": "CASE WHEN p_bull >= 0.55 THEN 1 WHEN p_bull <= 0.45 THEN -1 ELSE 0 END", "confidence": "abs(p_bull - 0.5) * 2"}))(lambda spark, d: rounded(P.inference(preds(spark, d), "p_bull"), ["signal", "confidence"]))
query("drift_check", sql(RET, out={"z": "z"}, keys=("feature", "drifted"), source="(SELECT feature, z, coalesce(abs(z) > 3, false) AS drifted FROM (SELECT unnest(['close', 'high']) AS feature, unnest([(avg(close) FILTER (rn >= 100) - avg(close)) / (stddev_samp(close) + 1e-9), (avg(high) FILTER (rn >= 100) - avg(high)) / (stddev_samp(high) + 1e-9)]) AS z FROM s1))"))(
    lambda spark, d: rounded(P.drift_check(hourly(spark, d).withColumn("rn", row_id()).where("rn >= 100"), P.training_stats(hourly(spark, d), ["close", "high"]), ["close", "high"]), ["z"], keys=("feature", "drifted")))


# ---- extensions
def _ext(spark: SparkSession, d: str) -> DataFrame:
    rows = preds(spark, d).withColumns({"price": F.col("close"), X.BULL: F.col("p_bull"), X.BEAR: F.col("p_bear"), "rf_prob_bull": F.col("p_bull"), "rf_prob_bear": F.col("p_bear"), "mlp_prob_bull": F.col("p_neutral"), "mlp_prob_bear": F.col("p_bear"), "signal": F.col("pred")})
    return rows.withColumn("Regime_Combo", (F.col("fold") - 2).cast("int"))


def epanel(name: str, op, columns: list[str], oracle: str) -> None:
    query(name, oracle)(lambda spark, d: rounded(op(_ext(spark, d)), columns))


_pc = {"pc": f"close / {lag('close', 10)} - 1", "pr": f"close / {lag('close', 5)} - 1"}
epanel("reversion", lambda r: X.reversion(r, extreme=0.4), ["reversion_long", "reversion_short", "reversion_signal", "reversion_strength"], psql(
    _pc, {"rl": flag("p_bear > 0.4 AND pc > -0.005"), "rs": flag("p_bull > 0.4 AND pc < 0.005")}, out={"reversion_long": "rl", "reversion_short": "rs", "reversion_signal": "rl - rs", "reversion_strength": "CASE WHEN rl - rs = 1 THEN p_bear + pc WHEN rl - rs = -1 THEN p_bull - pc ELSE 0 END"}))
query("conviction", psql({"c": "p_bull - p_bear", "m": "p_neutral - p_bear"}, out={"ensemble_conviction": "c", "mlp_conviction": "m", "conviction_agreement": "greatest((CASE WHEN c > 0 THEN 1 ELSE 0 END) + (CASE WHEN m > 0 THEN 1 ELSE 0 END), (CASE WHEN c < 0 THEN 1 ELSE 0 END) + (CASE WHEN m < 0 THEN 1 ELSE 0 END)) / 2.0"},
    keys=("symbol", "ts", "CASE WHEN c <= -1 OR c > 1 THEN NULL WHEN c <= -0.3 THEN 'Strong Bear' WHEN c <= -0.1 THEN 'Moderate Bear' WHEN c <= 0.1 THEN 'Neutral' WHEN c <= 0.3 THEN 'Moderate Bull' ELSE 'Strong Bull' END AS conviction_zone")))(
    lambda spark, d: rounded(X.conviction(_ext(spark, d)), ["ensemble_conviction", "mlp_conviction", "conviction_agreement"], keys=("symbol", "ts", "conviction_zone")))
epanel("signal_divergence", lambda r: X.divergences(r, prob=0.4), ["bearish_divergence", "bullish_divergence", "divergence_intensity"], psql(
    _pc, {"bd": flag("p_bear > 0.4 AND pr > 0.003"), "ud": flag("p_bull > 0.4 AND pr < -0.003")}, out={"bearish_divergence": "bd", "bullish_divergence": "ud", "divergence_intensity": "CASE WHEN bd = 1 THEN p_bear * pr WHEN ud = 1 THEN -p_bull * pr ELSE 0 END"}))
epanel("risk_size", lambda r: X.risk_size(X.conviction(r)), ["position_size", "sized_signal"], psql(
    {"o": "CASE WHEN pred = 1 THEN p_bear WHEN pred = -1 THEN p_bull ELSE 0.5 END", "c": "abs(p_bull - p_bear)"}, {"sz": "least(greatest(1 - o * 0.5 + CASE WHEN c > 0.4 THEN (c - 0.4) * 0.3 ELSE 0 END, 0.1), 2)"}, out={"position_size": "sz", "sized_signal": "pred * sz"}))


def _ruled(r: DataFrame) -> DataFrame:
    rules = r.sparkSession.createDataFrame([(-1, False, True), (2, True, False)], "regime int, allow_longs boolean, allow_shorts boolean")
    return X.regime_filter(r, rules)


epanel("regime_filter", _ruled, ["filtered_signal", "was_filtered"], psql(
    {"f": "CASE WHEN pred = 1 AND p_bear < 0.4 AND fold <> 1 THEN 1 WHEN pred = -1 AND p_bull < 0.4 AND fold <> 4 THEN -1 ELSE 0 END"}, out={"filtered_signal": "f", "was_filtered": "CASE WHEN pred <> f THEN 1 ELSE 0 END"}))
query("extensions_summary", psql(
    {"c": "p_bull - p_bear", "sz": "least(greatest(1 - CASE WHEN pred = 1 THEN p_bear WHEN pred = -1 THEN p_bull ELSE 0.5 END * 0.5, 0.1), 2)"},
    {"zone": "CASE WHEN c <= -1 OR c > 1 THEN NULL WHEN c <= -0.3 THEN 'Strong Bear' WHEN c <= -0.1 THEN 'Moderate Bear' WHEN c <= 0.1 THEN 'Neutral' WHEN c <= 0.3 THEN 'Moderate Bull' ELSE 'Strong Bull' END"},
    out={"n": "count(*)", "mean_conviction": "avg(c)", "mean_size": "avg(sz)"}, keys=("zone AS conviction_zone",), where="GROUP BY zone"))(lambda spark, d: rounded(X.summary(X.run_all(_ext(spark, d)), "conviction_zone"), ["n", "mean_conviction", "mean_size"], keys=("conviction_zone",)))

# ---- evaluation
query("confusion", psql(out={"n": "count(*)"}, keys=('CAST(t AS INT) AS "true"', "pred"), where="GROUP BY t, pred"))(lambda spark, d: rounded(E.confusion(preds(spark, d)), ["n"], keys=("true", "pred")))
_cs = """(SELECT c, coalesce(h * 1.0 / nullif(k, 0), 0) AS pr, coalesce(h * 1.0 / nullif(s, 0), 0) AS rc, s FROM (SELECT c, count(*) FILTER (t = c) AS s, count(*) FILTER (pred = c) AS k, count(*) FILTER (t = c AND pred = c) AS h FROM s4, (SELECT unnest([-1, 0, 1]) AS c) GROUP BY 1))"""
query("class_scores", psql(out={"precision": "pr", "recall": "rc", "f1": "coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)", "support": "s"}, keys=('c AS "class"',), source=_cs))(lambda spark, d: rounded(E.class_scores(preds(spark, d)), ["precision", "recall", "f1", "support"], keys=("class",)))
query("fold_scores", psql(out={"accuracy": "avg(CASE WHEN t = pred THEN 1.0 ELSE 0 END)", "n": "count(*)"}, keys=("CAST(fold AS INT) AS fold",), where="GROUP BY fold"))(lambda spark, d: rounded(E.scores(preds(spark, d), ("fold",)), ["accuracy", "n"], keys=("fold",)))
query("auc_rank", psql({"k": "rank() OVER (ORDER BY p_bull) + (count(*) OVER (PARTITION BY p_bull) - 1) / 2.0", "y": "CASE WHEN t = 1 THEN 1 ELSE 0 END"}, out={"auc": "(sum(k * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))", "n_pos": "sum(y)", "n_neg": "sum(1 - y)"}, keys=(), source="s5"))(
    lambda spark, d: rounded(E.auc(preds(spark, d), "p_bull", F.col("true") == 1), keys=()))
query("auc_one_vs_rest", psql(
    out={"auc": "(sum(k * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))"}, keys=("CAST(fold AS INT) AS fold", 'c AS "class"'), where="GROUP BY fold, c",
    source="(SELECT fold, c, CASE WHEN t = c THEN 1 ELSE 0 END AS y, rank() OVER (PARTITION BY fold, c ORDER BY p) + (count(*) OVER (PARTITION BY fold, c, p) - 1) / 2.0 AS k FROM (SELECT fold, t, unnest([-1, 0, 1]) AS c, unnest([p_bear, p_neutral, p_bull]) AS p FROM s4))"))(lambda spark, d: rounded(E.auc_one_vs_rest(preds(spark, d), ("fold",)), ["auc"], keys=("fold", "class")))
query("roc_curve", psql({"y": "CASE WHEN t = 1 THEN 1.0 ELSE 0 END"}, out={"tpr": "sum(a) OVER w / sum(a) OVER ()", "fpr": "sum(b) OVER w / sum(b) OVER ()", "precision": "sum(a) OVER w / (sum(a) OVER w + sum(b) OVER w)"}, keys=("threshold",), source="(SELECT floor(p_bull * 1000) AS threshold, sum(y) AS a, sum(1 - y) AS b FROM s5 GROUP BY 1)", where="WINDOW w AS (ORDER BY threshold DESC)"))(
    lambda spark, d: rounded(E.roc_curve(preds(spark, d).withColumn("p", F.floor(F.col("p_bull") * 1000).cast("double")), "p", F.col("true") == 1), ["tpr", "fpr", "precision"], keys=("threshold",)))
query("calibration", psql(out={"mean_prob": "avg(p_bull)", "share": "avg(CASE WHEN t = 1 THEN 1.0 ELSE 0 END)", "n": "count(*)"}, keys=('CAST(least(floor(p_bull * 10), 9) AS INT) AS "bin"',), where="GROUP BY 1"))(
    lambda spark, d: rounded(E.calibration(preds(spark, d), "p_bull", F.col("true") == 1), keys=("bin",)))
query("brier", psql({"y": "CASE WHEN t = 1 THEN 1.0 ELSE 0 END", "k": "greatest(1, ceil(p_bull * 10))"}, out={"brier": "(SELECT avg(pow(p_bull - y, 2)) FROM s5)", "reliability": "sum(n * pow(m - s, 2)) / sum(n)", "resolution": "sum(n * pow(s - b, 2)) / sum(n)", "uncertainty": "any_value(b * (1 - b))"}, keys=(),
    source="(SELECT k, avg(p_bull) AS m, avg(y) AS s, count(*) AS n, (SELECT avg(y) FROM s5) AS b FROM s5 GROUP BY 1)"))(lambda spark, d: rounded(E.brier(preds(spark, d), "p_bull", F.col("true") == 1), keys=()))
query("probability_shape", psql(out={"entropy": "avg(-(p_bear * log2(p_bear + 1e-12) + p_neutral * log2(p_neutral + 1e-12) + p_bull * log2(p_bull + 1e-12)))", "sharpness": "avg(best)", "overconfidence": "avg(best) FILTER (t <> pred)", "confidence_gap": "avg(best) - avg(CASE WHEN t = pred THEN 1.0 ELSE 0 END)"}, keys=()))(
    lambda spark, d: rounded(E.probability_shape(preds(spark, d)), keys=()))
ppanel("rolling_error", E.rolling_error, ["rolling_error"], psql({"m": "CASE WHEN t <> pred THEN 1.0 ELSE 0 END"}, out={"rolling_error": f"CASE WHEN count(*) OVER {fr(50)} = 50 THEN avg(m) OVER {fr(50)} END"}))
query("error_by_fold", psql(out={"error": "avg(CASE WHEN t <> pred THEN 1.0 ELSE 0 END)", "n": "count(*)"}, keys=("CAST(fold AS INT) AS fold",), where="GROUP BY fold"))(lambda spark, d: rounded(E.error_by(preds(spark, d), "fold"), keys=("fold",)))
query("stability", psql(out={"mean_corr": "avg(c)", "std_corr": "stddev_samp(c)", "n_folds": "count(c)"}, keys=("feature",), where="GROUP BY feature", source="(SELECT fold, 'high' AS feature, corr(high, best) AS c FROM s4 GROUP BY 1 UNION ALL SELECT fold, 'low', corr(low, best) FROM s4 GROUP BY 1)"))(
    lambda spark, d: rounded(E.feature_stability(preds(spark, d).withColumn("top", F.greatest("p_bear", "p_neutral", "p_bull")), ["high", "low"], "top", "fold"), keys=("feature",)))
query("target_correlation", psql(out={"corr": "c"}, keys=("feature",), source="(SELECT unnest(['high', 'low', 'p_bull']) AS feature, unnest([corr(high, t), corr(low, t), corr(p_bull, t)]) AS c FROM s4)"))(lambda spark, d: rounded(E.target_correlations(preds(spark, d), ["high", "low", "p_bull"], "true"), keys=("feature",)))
query("dependence", psql(out={"beta": "regr_slope(high, p_bull) * stddev_pop(p_bull)", "r2": "regr_r2(high, p_bull)", "n": "count(*)"}, keys=()))(lambda spark, d: rounded(E.dependence(preds(spark, d), "p_bull", "high"), ["beta", "r2", "n"], keys=()))
query("cohens_d", psql({"q1": "quantile_cont(p_bull, 0.25) OVER ()", "q3": "quantile_cont(p_bull, 0.75) OVER ()"}, {"lo": "CASE WHEN p_bull <= q1 THEN high END", "hi": "CASE WHEN p_bull >= q3 THEN high END"},
    out={"mean_low": "avg(lo)", "mean_high": "avg(hi)", "cohens_d": "(avg(hi) - avg(lo)) / sqrt(((count(lo) - 1) * var_samp(lo) + (count(hi) - 1) * var_samp(hi)) / (count(lo) + count(hi) - 2))", "n_low": "count(lo)", "n_high": "count(hi)"}, keys=()))(lambda spark, d: rounded(E.quartile_effect(preds(spark, d), "p_bull", "high"), keys=()))
query("conditional_effects", psql({"mh": "median(high) OVER ()", "ml": "median(low) OVER ()"}, out={"effect_low": "l", "effect_high": "h", "strength": "abs(h - l)"}, keys=("x", "given"),
    source="(SELECT unnest(['high', 'low']) AS x, unnest(['low', 'high']) AS given, unnest([avg(p_bull) FILTER (low <= ml), avg(p_bear) FILTER (high <= mh)]) AS l, unnest([avg(p_bull) FILTER (low > ml), avg(p_bear) FILTER (high > mh)]) AS h FROM s5)"))(
    lambda spark, d: rounded(E.conditional_effects(preds(spark, d), ["high", "low"], {"high": "p_bull", "low": "p_bear"}), ["effect_low", "effect_high", "strength"], keys=("x", "given")))
ppanel("vote", lambda p: E.vote(p.withColumns({"m1": F.col("pred"), "m2": F.col("true"), "m3": (F.col("rn") % 3 - 1).cast("int")}), ["m1", "m2", "m3"]), ["vote"], psql(
    {"x": "[pred, CAST(t AS INT), CAST(rn % 3 - 1 AS INT)]"}, {f"c{i}": f"len(list_filter(x, lambda v: v = {v}))" for i, v in enumerate((-1, 0, 1))}, out={"vote": "CASE WHEN c0 >= c1 AND c0 >= c2 THEN -1 WHEN c1 >= c2 THEN 0 ELSE 1 END"}))
ppanel("meta_features", E.meta_features, ["confidence", "entropy", "pred_vol"], psql(out={"confidence": "best", "entropy": "-(p_bear * ln(p_bear + 1e-12) + p_neutral * ln(p_neutral + 1e-12) + p_bull * ln(p_bull + 1e-12))", "pred_vol": std("pred", 20)}))
query("best_by_regime", psql(
    {"m2": "rn % 3 - 1"}, {"a1": "avg(CASE WHEN pred = t THEN 1.0 ELSE 0 END) OVER (PARTITION BY fold)", "a2": "avg(CASE WHEN m2 = t THEN 1.0 ELSE 0 END) OVER (PARTITION BY fold)"}, {"best_model": "CASE WHEN a2 >= a1 THEN 'm2' ELSE 'pred' END"},
    out={"regime_pred": "CASE best_model WHEN 'm2' THEN m2 ELSE pred END"}, keys=("symbol", "ts", "best_model")))(lambda spark, d: rounded(E.best_by_regime(preds(spark, d).withColumn("m2", (F.col("rn") % 3 - 1).cast("int")), ["pred", "m2"], "fold"), ["regime_pred"], keys=("symbol", "ts", "best_model")))

# ---- checks and diagnostics
query("class_balance", psql(out={"n": "count(*)", "share": "count(*) / (SELECT count(*) FROM s4)"}, keys=('CAST(t AS INT) AS "true"',), where="GROUP BY t"))(lambda spark, d: rounded(H.class_balance(preds(spark, d), "true"), keys=("true",)))
query("validation", psql(out={"value": "v"}, keys=('"check"', "ok"), source=f"""(SELECT "check", v, v = 0 AS ok FROM (SELECT unnest(['null_cells', 'repeated_keys', 'bad_probability_sums']) AS "check", unnest([a, b, c]) AS v FROM (
  SELECT {' + '.join(f'count(*) FILTER ({x} IS NULL)' for x in ('symbol', 'ts', 'rn', 'close', 'high', 'low', 't', 'pred', 'p_bear', 'p_neutral', 'p_bull', 'fold'))} AS a, count(*) - count(DISTINCT symbol || CAST(ts AS VARCHAR)) AS b, count(*) FILTER (abs(p_bear + p_neutral + p_bull - 1) > 1e-3) AS c FROM s4)))"""))(lambda spark, d: rounded(H.validate(preds(spark, d)), ["value"], keys=("check", "ok")))
query("regime_validation", psql(out={"n": "count(*)", "accuracy": "avg(CASE WHEN t = pred THEN 1.0 ELSE 0 END)", "common_pred": "CASE WHEN count(*) FILTER (pred = -1) >= greatest(count(*) FILTER (pred = 0), count(*) FILTER (pred = 1)) THEN -1 WHEN count(*) FILTER (pred = 0) >= count(*) FILTER (pred = 1) THEN 0 ELSE 1 END", "mean_prob": "avg(best)", "std_prob": "stddev_samp(best)"}, keys=("CAST(fold AS INT) AS fold",), where="GROUP BY fold"))(
    lambda spark, d: rounded(H.by_regime(preds(spark, d), "fold"), ["n", "accuracy", "common_pred", "mean_prob", "std_prob"], keys=("fold",)))
query("pattern_stability", psql(out={"distance": "sum(abs(a * 1.0 / ta - b * 1.0 / tb))"}, keys=(), source="(SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM (SELECT pred, count(*) FILTER (fold = 0) AS a, count(*) FILTER (fold = 1) AS b FROM s4 WHERE fold IN (0, 1) GROUP BY 1))"))(
    lambda spark, d: rounded(H.pattern_stability(preds(spark, d).withColumn("fold", F.col("fold").cast("string")), "fold", "0", "1"), keys=()))
_f1w = "(SELECT fold, sum(f1 * s) / sum(s) AS f1_weighted FROM (SELECT fold, c, coalesce(2.0 * count(*) FILTER (t = c AND pred = c) / nullif(count(*) FILTER (t = c) + count(*) FILTER (pred = c), 0), 0) AS f1, count(*) FILTER (t = c) AS s FROM s4, (SELECT unnest([-1, 0, 1]) AS c) GROUP BY 1, 2) GROUP BY 1)"
query("sample_comparison", psql(
    out={"accuracy": "accuracy", "f1_weighted": "f1_weighted", "spread": "max(accuracy) OVER () - min(accuracy) OVER ()"}, keys=("CAST(fold AS INT) AS fold", "(max(accuracy) OVER () - min(accuracy) OVER ()) < 0.05 AS stable"),
    source=f"(SELECT fold, avg(CASE WHEN t = pred THEN 1.0 ELSE 0 END) AS accuracy FROM s4 GROUP BY 1) JOIN {_f1w} USING (fold)"))(lambda spark, d: rounded(H.compare_samples(preds(spark, d), "fold"), ["accuracy", "f1_weighted", "spread"], keys=("fold", "stable")))
query("index_difference", """SELECT DISTINCT event_type AS symbol, date_trunc('hour', ts) AS ts, 'first' AS side FROM events WHERE event_type IN ('click') AND hour(ts) < 2""")(
    lambda spark, d: H.index_difference(hourly(spark, d).where("symbol = 'click'"), hourly(spark, d).where("symbol = 'click' and hour(ts) >= 2")))
query("null_profile", sql({"s": slope("close", 50)}, RET, out={"n": "n", "n_null": "k", "share": "k / n"}, keys=('"column"',), source="(SELECT unnest(['RegSlope_50', 'Return']) AS \"column\", count(*) AS n, unnest([count(*) - count(s), count(*) - count(r)]) AS k FROM s2)"))(
    lambda spark, d: rounded(N.null_profile(T.reg_slope(T.prelim(hourly(spark, d))), ["RegSlope_50", "Return"]), keys=("column",)))
query("constant_columns", sql({"one": "1"}, out={"n_distinct": "k"}, keys=('"column"', "k <= 1 AS constant"), source="(SELECT unnest(['close', 'one']) AS \"column\", unnest([count(DISTINCT close), count(DISTINCT one)]) AS k FROM s1)"))(
    lambda spark, d: rounded(D.constant_columns(hourly(spark, d).withColumn("one", F.lit(1)), ["close", "one"]), ["n_distinct"], keys=("column", "constant")))
panel("feature_drift", lambda b: D.feature_drift(b, "close"), ["close_drift", "close_vardrift"], sql(out={"close_drift": f"({avg('close', 200)}) - avg(close) OVER {ALL}", "close_vardrift": f"({std('close', 200)}) - stddev_samp(close) OVER {ALL}"}))
panel("rolling_autocorr", lambda b: D.rolling_snr(D.rolling_autocorr(b, "close", 100), "close", 100), ["close_autocorr", "close_snr"], sql(
    {"p": lag("close")}, out={"close_autocorr": f"CASE WHEN rn >= 100 THEN corr(close, p) OVER ({W} ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING) ELSE 0 END", "close_snr": f"CASE WHEN rn >= 100 THEN abs(avg(close) OVER ({W} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) / (stddev_samp(close) OVER ({W} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) + 1e-10) ELSE 0 END"}, digits=5), 5)
query("autocorrelation", sql({"p": lag("close")}, out={"autocorr": "corr(close, p)"}, keys=("symbol",), where="GROUP BY symbol"))(lambda spark, d: rounded(D.autocorrelation(hourly(spark, d), "close"), keys=("symbol",)))
query("leakage_corr", sql(RET, {"f": lead("r")}, out={"leakage": "corr(close, f)"}, keys=("symbol",), where="GROUP BY symbol"))(lambda spark, d: rounded(D.leakage(hourly(spark, d), "close"), keys=("symbol",)))
query("snr", sql(out={"snr": "abs(avg(close)) / (stddev_samp(close) + 1e-10)"}, keys=("symbol",), where="GROUP BY symbol"))(lambda spark, d: rounded(D.signal_to_noise(hourly(spark, d), "close"), keys=("symbol",)))
_g = {f"g{a}{b}": f"sum(coalesce(x{a}, 0) * coalesce(x{b}, 0))" for a in (1, 2, 3) for b in (1, 2, 3) if a <= b}
_det = "(g11 * (g22 * g33 - g23 * g23) - g12 * (g12 * g33 - g23 * g13) + g13 * (g12 * g23 - g22 * g13))"
query("vif", sql(
    RET | {"tr": "greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY ts)), abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY ts)))"}, {"x1": "r", "x2": avg("tr", 14), "x3": slope("close", 20)},
    out={"vif": "v"}, keys=("feature",), digits=4, source=f"(SELECT unnest(['Return', 'ATR_14', 'RegSlope_20']) AS feature, unnest([g11 * (g22 * g33 - g23 * g23) / {_det}, g22 * (g11 * g33 - g13 * g13) / {_det}, g33 * (g11 * g22 - g12 * g12) / {_det}]) AS v FROM (SELECT {', '.join(f'{x} AS {n}' for n, x in _g.items())} FROM s2))"))(lambda spark, d: rounded(spark.createDataFrame(sorted(D.vif(T.reg_slope(T.prelim(hourly(spark, d))), ["Return", "ATR_14", "RegSlope_20"]).items()), "feature string, vif double"), ["vif"], 4, ("feature",)))
panel("normalise", lambda b: N.normalize(N.normalize(N.normalize(b, ["close"], "zscore"), ["close"], "minmax"), ["close"], "winsor"), ["close_zscore", "close_minmax", "close_winsor"], sql(
    out={"close_zscore": f"(close - avg(close) OVER {ALL}) / (stddev_samp(close) OVER {ALL} + 1e-10)", "close_minmax": f"(close - min(close) OVER {ALL}) / (max(close) OVER {ALL} - min(close) OVER {ALL} + 1e-10)", "close_winsor": f"least(greatest(close, quantile_cont(close, 0.01) OVER {ALL}), quantile_cont(close, 0.99) OVER {ALL})"}))
panel("normalise_rank", lambda b: N.normalize(N.normalize(b, ["close"], "rank"), ["close"], "vol_adjust"), ["close_rank", "close_vol_adjust"], sql(
    out={"close_rank": f"(rank() OVER (PARTITION BY symbol ORDER BY close) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2.0) / count(*) OVER {ALL}", "close_vol_adjust": f"close / (({std('close', 20)}) + 1e-10)"}))
panel("normalise_robust", lambda b: N.normalize(b, ["close"], "robust"), ["close_robust"], sql({"m": f"quantile_cont(close, 0.5) OVER {ALL}"}, {"dv": "abs(close - m)"}, out={"close_robust": f"(close - m) / (quantile_cont(dv, 0.5) OVER {ALL} + 1e-10)"}))
panel("normalise_regime", lambda b: N.normalize(b.withColumn("k", row_id() % 5), ["close"], "regime", "k"), ["close_regime"], sql(
    {"m": f"quantile_cont(close, 0.5) OVER {ALL}", "w": f"least(greatest(close, quantile_cont(close, 0.01) OVER {ALL}), quantile_cont(close, 0.99) OVER {ALL})"}, {"dv": "abs(close - m)", "wm": f"quantile_cont(w, 0.5) OVER {ALL}"}, {"wd": "abs(w - wm)"},
    out={"close_regime": f"CASE rn % 5 WHEN 0 THEN (close - avg(close) OVER {ALL}) / (stddev_samp(close) OVER {ALL} + 1e-10) WHEN 1 THEN (close - avg(close) OVER {ALL}) / (stddev_samp(close) OVER {ALL} + 1e-10) WHEN 2 THEN (close - m) / (quantile_cont(dv, 0.5) OVER {ALL} + 1e-10) WHEN 3 THEN (w - wm) / (quantile_cont(wd, 0.5) OVER {ALL} + 1e-10) END"}))
_cf = {"Return": "r", "ATR_14": "a14", "VolRet": "v20", "RegSlope_20": "g20", "RegSlope_100": "g100"}
_cf_there = " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END)" for x in _cf.values())
# no column lacks over 60 % of its rows, so rows are what goes; what is left is filled with the median
query("clean_features", sql(
    RET | {"tr": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"}, {"a14": avg("tr", 14), "v20": std("r", 20), "g20": slope("close", 20), "g100": slope("close", 100)},
    out={n: f"coalesce({x}, quantile_cont({x}, 0.5) OVER ())" for n, x in _cf.items()}, source=f"(SELECT * FROM s2 WHERE ({_cf_there}) >= 0.7 * 5)"))(
    lambda spark, d: rounded(N.clean(T.reg_slope(T.prelim(hourly(spark, d))), list(_cf)), list(_cf)))


def _names(spark: SparkSession, d: str) -> DataFrame:
    """The columns of a panel with their base, window and how many values they have."""
    panel_ = T.sma(T.roc(hourly(spark, d), (5, 20)), (5, 20, 200)).withColumn("SMA_20_zscore", F.col("SMA_20") - F.avg("SMA_20").over(T.whole()))
    names = [c for c in panel_.columns if c not in hourly(spark, d).columns]
    counts = panel_.agg(*[F.count(c).alias(c) for c in names])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_values")) for c in names])).alias("x")).select("x.*")
    return D.describe(long, spark.createDataFrame([("SMA", "mean close"), ("ROC", "rate of change")], "base string, description string")).select("feature", "base", "window", "description", "n_values")


query("feature_names", f"""WITH {FIXTURE}, c AS (SELECT symbol, count(*) AS n FROM s0 GROUP BY 1), f AS (SELECT * FROM (VALUES ('SMA_5', 'SMA', 5, 4, 'mean close'), ('SMA_20', 'SMA', 20, 19, 'mean close'), ('SMA_200', 'SMA', 200, 199, 'mean close'), ('SMA_20_zscore', 'SMA', 20, 19, 'mean close'),
 ('ROC_5', 'ROC', 5, 5, 'rate of change'), ('ROC_20', 'ROC', 20, 20, 'rate of change')) t(feature, base, "window", lost, description)) SELECT feature, base, "window", description, CAST(sum(greatest(n - lost, 0)) AS BIGINT) AS n_values FROM f, c GROUP BY ALL""")(_names)

# ---- contracts: events dealt over four quarterly contracts
_CODES = "FGHJKMNQUVXZ"


def _minutes(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("ts", "event_id", (100.0 + F.col("value")).alias("close"), F.col("user_id"))
    rows = rows.withColumn("symbol", F.concat(F.lit("NQ"), F.expr(f"substring('{_CODES}', int(pmod(user_id, 4)) * 3 + 3, 1)"), F.lit("4")))
    return rows.groupBy("symbol", F.window("ts", "1 hour")["start"].alias("ts")).agg(F.min_by("close", F.struct("ts", "event_id")).alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", F.struct("ts", "event_id")).alias("close"), F.count("*").alias("volume"))


_mi = f"""WITH m AS (SELECT 'NQ' || substring('{_CODES}', CAST(user_id % 4 AS INT) * 3 + 3, 1) || '4' AS symbol, date_trunc('hour', ts) AS ts, arg_max(100.0 + value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
 v AS (SELECT CAST(ts AS DATE) AS day, symbol, sum(volume) AS v, 202400 + instr('{_CODES}', substring(symbol, 3, 1)) AS expiry FROM m GROUP BY 1, 2),
 t AS (SELECT day, symbol, expiry FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY v DESC, symbol) AS k FROM v) WHERE k = 1),
 fm AS (SELECT day, max({{'e': expiry, 's': symbol}}) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS h FROM t),
 front AS (SELECT day, h.s AS symbol, CAST(h.e AS INT) AS expiry FROM fm)"""
query("roll_front_contract", _mi + " SELECT 'NQ' AS root, * FROM front")(lambda spark, d: B.front_contracts(_minutes(spark, d), B.parse_code("symbol")))
query("back_adjust", _mi + """, p AS (SELECT *, lag(symbol) OVER (ORDER BY day) AS old, lag(day) OVER (ORDER BY day) AS old_day FROM front),
 j AS (SELECT p.day, arg_max(b.close / a.close, {'x': CAST(a.ts AS DATE) = p.old_day, 'y': a.ts}) AS ratio FROM p JOIN m a ON a.symbol = p.old AND CAST(a.ts AS DATE) IN (p.day, p.old_day) JOIN m b ON b.symbol = p.symbol AND b.ts = a.ts WHERE p.old <> p.symbol GROUP BY 1),
 k AS (SELECT front.day, front.symbol, coalesce(exp(sum(ln(coalesce(ratio, 1))) OVER (ORDER BY front.day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS f FROM front LEFT JOIN j USING (day))
 SELECT m.symbol, m.ts, round(m.close * f, 6) AS close, round(f, 6) AS factor FROM m JOIN k ON k.day = CAST(m.ts AS DATE) AND k.symbol = m.symbol""")(
    lambda spark, d: rounded(B.back_adjust(_minutes(spark, d), B.roll_factors(_minutes(spark, d), B.front_contracts(_minutes(spark, d), B.parse_code("symbol")))), ["close", "factor"]))
query("structure_full")(lambda spark, d: ST.add_structure(hourly(spark, d)))
