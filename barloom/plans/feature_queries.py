"""Feature queries over hourly bars, with the SQL that checks each."""

from __future__ import annotations

import math

from ..operators import bars as B
from ..operators import calendar as K
from ..operators import regimes as G
from ..operators import scan as S
from ..operators import structure as X
from ..operators import trend as T
from ..operators import volatility as V
from .oracle import ALL, RET, RUN, TR, W, avg, bottom, flag, fr, lag, lead, roll, slope, sql, std, top, total
from .registry import panel, query, rounded, hourly

LN2 = math.log(2)

# ---- trend
panel("sma_panel", T.sma, [f"SMA_{w}" for w in T.MA_WINDOWS], sql(out={f"SMA_{w}": avg("close", w) for w in T.MA_WINDOWS}))


def _weighted(x: str, w: int) -> str:
    terms = " + ".join(f"{w - k} * coalesce(lag({x}, {k}) OVER ({W}), 0)" if k else f"{w} * {x}" for k in range(w))
    return f"CASE WHEN count({x}) OVER {fr(w)} = {w} THEN ({terms}) / {w * (w + 1) / 2} END"


panel("wma_panel", lambda b: T.wma(b, (5, 10, 20)), ["WMA_5", "WMA_10", "WMA_20"], sql(out={f"WMA_{w}": _weighted("close", w) for w in (5, 10, 20)}))
panel("hma", lambda b: T.hma(b, (8, 20)), ["HMA_8", "HMA_20"], sql({f"h{w}": f"2 * ({_weighted('close', w // 2)}) - ({_weighted('close', w)})" for w in (8, 20)}, out={f"HMA_{w}": _weighted(f"h{w}", math.isqrt(w)) for w in (8, 20)}))
panel("stochastic", T.stochastic, ["StochK_14", "StochD_14", "StochK_21", "StochD_21"], sql(
    {f"k{w}": f"100 * (close - {bottom('low', w)}) / ({top('high', w)} - {bottom('low', w)} + 1e-10)" for w in (14, 21)}, out={f"StochK_{w}": f"k{w}" for w in (14, 21)} | {f"StochD_{w}": avg(f"k{w}", 3) for w in (14, 21)}, digits=5), 5)
panel("roc", T.roc, ["ROC_5", "ROC_10", "ROC_20"], sql(out={f"ROC_{w}": f"100 * (close / {lag('close', w)} - 1)" for w in (5, 10, 20)}))
panel("williams_r", T.williams_r, ["WilliamsR_14", "WilliamsR_28"], sql(out={f"WilliamsR_{w}": f"-100 * ({top('high', w)} - close) / ({top('high', w)} - {bottom('low', w)} + 1e-10)" for w in (14, 28)}))
panel("cmo", T.cmo, ["CMO_14", "CMO_21"], sql({"d": f"close - {lag('close')}"}, {"u": "greatest(d, 0) + 0 * d", "v": "greatest(-d, 0) + 0 * d"}, out={f"CMO_{w}": f"100 * ({total('u', w)} - {total('v', w)}) / ({total('u', w)} + {total('v', w)} + 1e-10)" for w in (14, 21)}))
panel("ultimate", T.ultimate, ["UltimateOsc"], sql(
    {"pc": lag("close")}, {"bp": "close - least(low, pc)", "rg": "greatest(high, pc) - least(low, pc)"},
    out={"UltimateOsc": "100 * (" + " + ".join(f"{k} * ({total('bp', w)}) / ({total('rg', w)} + 1e-10)" for k, w in ((4, 7), (2, 14), (1, 28))) + ") / 7"}))
panel("awesome", T.awesome, ["AO"], sql({"m": "(high + low) / 2"}, out={"AO": f"({avg('m', 5)}) - ({avg('m', 34)})"}))
panel("reg_slope", T.reg_slope, [f"RegSlope_{w}" for w in (10, 20, 50, 100)], sql(out={f"RegSlope_{w}": slope("close", w) for w in (10, 20, 50, 100)}))
panel("reg_r2", T.reg_r2, [f"RegR2_{w}" for w in (20, 50, 100)], sql(out={f"RegR2_{w}": roll("regr_r2(close, rn)", "close", w) for w in (20, 50, 100)}))
panel("reg_deviation", T.reg_deviation, ["RegDev_20", "RegDev_50"], sql(out={f"RegDev_{w}": f"close - ({roll('regr_intercept(close, rn)', 'close', w)} + ({slope('close', w)}) * rn)" for w in (20, 50)}, digits=4), 4)
panel("curvature", T.curvature, ["Curv_10", "Curv_20", "Curv_50"], sql({f"s{w}": avg("close", w) for w in (10, 20, 50)}, out={f"Curv_{w}": f"s{w} - 2 * {lag(f's{w}')} + {lag(f's{w}', 2)}" for w in (10, 20, 50)}))
panel("acceleration", T.acceleration, ["Accel_10", "Accel_20", "Accel_50"], sql({f"s{w}": slope("close", w) for w in (10, 20, 50)}, out={f"Accel_{w}": f"s{w} - {lag(f's{w}')}" for w in (10, 20, 50)}))
panel("slope_flip", T.slope_flip, ["SlopeFlip_10", "SlopeFlip_20", "SlopeFlip_50"], sql(
    {f"s{w}": slope("close", w) for w in (10, 20, 50)}, {f"p{w}": lag(f"s{w}") for w in (10, 20, 50)}, out={f"SlopeFlip_{w}": f"CASE WHEN p{w} < 0 AND s{w} > 0 THEN 1 WHEN p{w} > 0 AND s{w} < 0 THEN -1 ELSE 0 END" for w in (10, 20, 50)}))
panel("dpo", T.dpo, ["DPO_10", "DPO_20", "DPO_30"], sql({f"s{w}": avg("close", w) for w in (10, 20, 30)}, out={f"DPO_{w}": f"close - {lag(f's{w}', w // 2 + 1)}" for w in (10, 20, 30)}))
panel("persistence", T.persistence, ["TrendPersist_10", "TrendPersist_20", "TrendPersist_50"], sql({"d": f"close - {lag('close')}"}, {"g": "CASE WHEN d > 0 THEN 1.0 WHEN d IS NOT NULL THEN -1.0 END"}, out={f"TrendPersist_{w}": f"({total('g', w)}) / {w}" for w in (10, 20, 50)}))
panel("noise_ratio", T.noise_ratio, ["NSR_10", "NSR_20", "NSR_50"], sql(
    {"a": f"abs(close - {lag('close')})"},
    out={f"NSR_{w}": f"CASE WHEN rn >= {w} THEN sum(a) OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND 1 PRECEDING) / (abs({lag('close')} - {lag('close', w)}) + 1e-10) END" for w in (10, 20, 50)}, digits=3), 3)
panel("vol_adjusted_slope", T.vol_adjusted_slope, ["VASlope_20", "VASlope_50", "VASlope_100"], sql(RET, out={f"VASlope_{w}": f"({slope('close', w)}) / (({std('r', w)}) * sqrt(252) + 1e-10)" for w in (20, 50, 100)}))
panel("trend_strength", T.trend_strength, ["TSI2_20", "TSI2_50"], sql(
    {"d": f"close - {lag('close')}", "n": f"count(*) OVER {ALL}"}, {f"e{w}": f"stddev_pop(CASE WHEN rn > n - {w} AND n > {w} THEN d END) OVER {ALL}" for w in (20, 50)}, out={f"TSI2_{w}": f"({slope('close', w)}) / (e{w} + 1e-10)" for w in (20, 50)}))


def _centre(k: int) -> str:
    return f"({W} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"


panel("local_extrema", T.local_extrema, [f"Local{m}_{k}" for k in (3, 5, 10) for m in ("Max", "Min")], sql(
    out={f"Local{m.title()}_{k}": flag(f"count(close) OVER {_centre(k)} = {2 * k + 1} AND close = {m}(close) OVER {_centre(k)}") for k in (3, 5, 10) for m in ("max", "min")}))
panel("extension", T.extension, ["Extension_10", "Extension_20", "Extension_50"], sql(out={f"Extension_{w}": f"(close - {avg('close', w)}) / ({avg('close', w)} + 1e-10)" for w in (10, 20, 50)}))
panel("bb_width", T.band_width, ["BBWidth_20", "ATRCompress_14"], sql(TR, out={"BBWidth_20": f"4 * ({std('close', 20)}) / ({avg('close', 20)} + 1e-10)", "ATRCompress_14": f"({avg('tr', 14)}) / ({top('high', 14)} - {bottom('low', 14)} + 1e-10)"}))
panel("trend_consistency", T.trend_consistency, ["TCI_20", "TCI_50"], sql(TR, out={f"TCI_{w}": f"({std('close', w)}) / ({avg('tr', 20)} + 1e-10)" for w in (20, 50)}))
panel("prelim", T.prelim, ["Return", "LogRet", "TrueRange", "ATR_14", "VolRet"], sql(RET | TR, out={"Return": "r", "LogRet": f"ln(close / {lag('close')})", "TrueRange": "tr", "ATR_14": avg("tr", 14), "VolRet": std("r", 20)}))


def _recursive(update: str, first: str, columns: str = "e") -> str:
    """One value a row, each from the one before; ``x`` is the row's input."""
    return f", z AS (SELECT symbol, ts, rn, {first} AS {columns} FROM src WHERE rn = 0 UNION ALL SELECT src.symbol, src.ts, src.rn, {update} FROM z JOIN src ON src.symbol = z.symbol AND src.rn = z.rn + 1)"


_src = ", src AS (SELECT symbol, ts, rn, {x} AS x FROM s0)"
panel("ema", lambda b: S.ema_panel(b, (20,)), ["EMA_20"], sql(more=_src.format(x="close") + _recursive("(2.0 / 21) * src.x + (1 - 2.0 / 21) * z.e", "x"), out={"EMA_20": "e"}, source="z"))
panel("ema_long", lambda b: S.ema_chunked(b, 20, 64), ["EMA_20"], sql(more=_src.format(x="close") + _recursive("(2.0 / 21) * src.x + (1 - 2.0 / 21) * z.e", "x"), out={"EMA_20": "e"}, source="z"))
panel("ewma_vol", V.ewma, ["EWMA_94"], sql(
    more=f", src AS (SELECT symbol, ts, rn, coalesce(pow(close / {lag('close')} - 1, 2), 0) AS x FROM s0)" + _recursive("0.94 * z.e + (1 - 0.94) * src.x", "x"), out={"EWMA_94": "sqrt(e)"}, source="z"))


def _chain(name: str, first: str, start: str, **states: tuple[str, str]) -> str:
    """A recursive CTE over d0: each state's value at the row where ``start`` holds, and its update from z."""
    head, body = (", ".join(f"{e[i]} AS {n}" for n, e in states.items()) for i in (0, 1))
    return f", {name} AS (SELECT d0.symbol, d0.rn, {head} FROM {first} WHERE {start} UNION ALL SELECT d0.symbol, d0.rn, {body} FROM {name} z JOIN d0 ON d0.symbol = z.symbol AND d0.rn = z.rn + 1)"


def _rsi(w: int) -> str:
    return _chain(f"rsi{w}", "d0", f"rn = {w}", g=(f"u{w}", f"(z.g * {w - 1} + greatest(d, 0)) / {w}"), l=(f"v{w}", f"(z.l * {w - 1} + greatest(-d, 0)) / {w}"))


def _triple(w: int) -> str:
    a = f"(2.0 / {w + 1})"
    one = f"({a} * close + (1 - {a}) * z.e1)"
    two = f"({a} * {one} + (1 - {a}) * z.e2)"
    return _chain(f"triple{w}", "d0", "rn = 0", e1=("close", one), e2=("close", two), e3=("close", f"{a} * {two} + (1 - {a}) * z.e3"))


def _kama(w: int) -> str:
    return _chain(f"kama{w}", "d0", f"rn = {w}", k=("close", f"z.k + ({(2 / 31) ** 2} + er{w} * {(2 / 3) ** 2 - (2 / 31) ** 2}) * (close - z.k)"))


_twice = {n: f"({2 / 26} * {x} + {24 / 26} * z.{n})" for n, x in (("m1", "d"), ("a1", "abs(d)"))}
_strength = _chain("strength", "d0", "rn = 1", m1=("d", _twice["m1"]), m2=("d", f"{2 / 14} * {_twice['m1']} + {12 / 14} * z.m2"), a1=("abs(d)", _twice["a1"]), a2=("abs(d)", f"{2 / 14} * {_twice['a1']} + {12 / 14} * z.a2"))
_step = f"close - {lag('close')}"
_moves = f""", d1 AS (SELECT symbol, ts, rn, close, {_step} AS d, close - {lag('close', 20)} AS moved FROM s0),
    d0 AS (SELECT symbol, ts, rn, close, d, {', '.join(f"avg(greatest(d, 0)) OVER {fr(w)} AS u{w}, avg(greatest(-d, 0)) OVER {fr(w)} AS v{w}" for w in (7, 14, 20, 21))},
      CASE WHEN sum(abs(d)) OVER {fr(20)} > 0 THEN abs(moved) / sum(abs(d)) OVER {fr(20)} ELSE 0 END AS er20 FROM d1)"""


def _of(chain: str, value: str) -> str:
    return f"(SELECT {value} FROM {chain} z WHERE z.symbol = d0.symbol AND z.rn = d0.rn)"


def _trix(w: int) -> str:
    return f"100 * ({_of(f'triple{w}', 'e3')} - (SELECT e3 FROM triple{w} z WHERE z.symbol = d0.symbol AND z.rn = d0.rn - 1)) / ({_of(f'triple{w}', 'e3')} + 1e-10)"


_tema20, _kama20, _tsi = _of("triple20", "3 * e1 - 3 * e2 + e3"), _of("kama20", "k"), _of("strength", "100 * m2 / (a2 + 1e-10)")
_strength_index = {w: _of(f"rsi{w}", "100 - 100 / (1 + g / (l + 1e-10))") for w in (7, 14, 21)}
panel("rsi", lambda b: S.scan(b, {"RSI_14": ("close", S.rsi, {"w": 14})}), ["RSI_14"], sql(more=_moves + _rsi(14), out={"RSI_14": _strength_index[14]}, source="d0"))
panel("tema", lambda b: S.scan(b, {"TEMA_20": ("close", S.tema, {"span": 20})}), ["TEMA_20"], sql(more=_moves + _triple(20), out={"TEMA_20": _tema20}, source="d0"))
panel("kama", lambda b: S.scan(b, {"KAMA_20": ("close", S.kama, {"w": 20})}), ["KAMA_20"], sql(more=_moves + _kama(20), out={"KAMA_20": _kama20}, source="d0"))
panel("trix", lambda b: S.scan(b, {f"TRIX_{w}": ("close", S.trix, {"w": w}) for w in (15, 30)}), ["TRIX_15", "TRIX_30"], sql(more=_moves + _triple(15) + _triple(30), out={f"TRIX_{w}": _trix(w) for w in (15, 30)}, source="d0"))
panel("tsi", lambda b: S.scan(b, {"TSI": ("close", S.tsi, {})}), ["TSI"], sql(more=_moves + _strength, out={"TSI": _tsi}, source="d0"))
panel("trend_scan", T.trend_recurrences, ["TEMA_20", "KAMA_20", "RSI_7", "RSI_21", "TRIX_15", "TRIX_30", "TSI"], sql(
    more=_moves + _rsi(7) + _rsi(21) + _triple(15) + _triple(20) + _triple(30) + _kama(20) + _strength,
    out={"TEMA_20": _tema20, "KAMA_20": _kama20, "RSI_7": _strength_index[7], "RSI_21": _strength_index[21], "TRIX_15": _trix(15), "TRIX_30": _trix(30), "TSI": _tsi}, source="d0"))
_decayed = _chain("decayed", "d0", "rn = 0", e=("0.0::DOUBLE", "0.94 * z.e + 0.06 * pow(close / (close - d) - 1, 2)"))
panel("long_recurrences", lambda b: S.long_recurrences(b, 64), ["TEMA_20", "KAMA_20", "RSI_14", "TRIX_15", "TSI", "EWMA_94"], sql(
    more=_moves + _rsi(14) + _triple(15) + _triple(20) + _kama(20) + _strength + _decayed,
    out={"TEMA_20": _tema20, "KAMA_20": _kama20, "RSI_14": _strength_index[14], "TRIX_15": _trix(15), "TSI": _tsi, "EWMA_94": _of("decayed", "sqrt(e)")}, source="d0"))
_extremes = ", ".join(f"{top(f'q{w}', w)} AS h{w}, {bottom(f'q{w}', w)} AS l{w}" for w in (14, 20))
panel("divergence", T.divergence, ["BearDiv_14", "BullDiv_14", "BearDiv_20", "BullDiv_20"], sql(
    more=_moves + _rsi(14) + _rsi(20) + f""", q AS (SELECT symbol, ts, rn, close, {', '.join(f"{_of(f'rsi{w}', '100 - 100 / (1 + g / (l + 1e-10))')} AS q{w}" for w in (14, 20))} FROM d0), q1 AS (SELECT *, {_extremes} FROM q)""",
    out={x: e for w in (14, 20) for x, e in ((f"BearDiv_{w}", flag(f"close >= {top('close', w)} AND q{w} < {lag(f'h{w}')}")), (f"BullDiv_{w}", flag(f"close <= {bottom('close', w)} AND q{w} > {lag(f'l{w}')}")))}, source="q1"))

# ---- volatility
_hl, _co = "ln(high / low)", "ln(close / open)"
_rs = "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"
W3 = (10, 20, 50)
panel("true_range_atr", V.atr, ["TrueRange", "ATR_14"], sql(TR, out={"TrueRange": "tr", "ATR_14": avg("tr", 14)}))
panel("parkinson", V.parkinson, [f"Parkinson_{w}" for w in W3], sql({"p": f"pow({_hl}, 2)"}, out={f"Parkinson_{w}": f"sqrt({avg('p', w)} / {4 * LN2})" for w in W3}).replace("sqrt(CASE", "sqrt((CASE").replace(f"END / {4 * LN2})", f"END) / {4 * LN2})"))
panel("garman_klass", V.garman_klass, [f"GK_{w}" for w in W3], sql({"g": f"greatest(0.5 * pow({_hl}, 2) - {2 * LN2 - 1} * pow({_co}, 2), 0)"}, out={f"GK_{w}": f"sqrt({avg('g', w)})" for w in W3}))
panel("rogers_satchell", V.rogers_satchell, [f"RS_{w}" for w in W3], sql({"q": _rs}, {f"m{w}": avg("q", w) for w in W3}, out={f"RS_{w}": f"CASE WHEN m{w} IS NOT NULL THEN sqrt(greatest(m{w}, 0)) END" for w in W3}))
panel("yang_zhang", V.yang_zhang, [f"YZ_{w}" for w in W3], sql(
    {"o": f"ln(open / {lag('close')})", "c": _co, "q": _rs}, {f"{n}{w}": e for w in W3 for n, e in (("a", roll("var_samp(o)", "o", w)), ("b", roll("var_samp(c)", "c", w)), ("m", avg("q", w)))},
    out={f"YZ_{w}": f"CASE WHEN a{w} IS NOT NULL THEN sqrt(a{w} + {0.34 / (1.34 + (w + 1) / (w - 1))} * b{w} + {1 - 0.34 / (1.34 + (w + 1) / (w - 1))} * greatest(m{w}, 0)) END" for w in W3}))
panel("vol_of_vol", V.basic, [f"{n}_{w}" for w in W3 for n in ("Vol", "Var", "VolOfVol")], sql(
    RET, {f"v{w}": std("r", w) for w in W3}, out={x: e for w in W3 for x, e in ((f"Vol_{w}", f"v{w}"), (f"Var_{w}", roll("var_samp(r)", "r", w)), (f"VolOfVol_{w}", std(f"v{w}", w)))}))
panel("vol_cluster", V.clustering, [f"VolCluster_{w}" for w in W3], sql(RET, {"a": "abs(r)"}, out={f"VolCluster_{w}": f"({avg('a', w)}) / ({std('a', w)} + 1e-10)" for w in W3}))
panel("shock_recovery", V.shock_recovery, ["ShockRec_20", "ShockRec_50"], sql(RET, {f"v{w}": std("r", w) for w in (20, 50)}, out={f"ShockRec_{w}": f"(v{w} - ({bottom(f'v{w}', w)})) / (({top(f'v{w}', w)}) - ({bottom(f'v{w}', w)}) + 1e-10)" for w in (20, 50)}))
panel("up_down_vol", V.up_down, [f"{n}_{w}" for w in W3 for n in ("UpsideVol", "DownsideVol", "UDRatio")], sql(
    RET, {"u": "CASE WHEN r > 0 THEN r ELSE 0 END", "d": "CASE WHEN r < 0 THEN r ELSE 0 END"}, {f"{n}{w}": std(n, w) for w in W3 for n in "ud"}, out={x: e for w in W3 for x, e in ((f"UpsideVol_{w}", f"u{w}"), (f"DownsideVol_{w}", f"d{w}"), (f"UDRatio_{w}", f"u{w} / (d{w} + 1e-10)"))}))
panel("bipower_jump", V.realized, ["RV", "BV_10", "BV_20", "BV_50", "JumpComp_20", "JumpIdx_20", "JumpComp_50", "JumpIdx_50", "VolRegime_20", "VolRegime_50"], sql(
    RET, {"rv": "coalesce(r * r, 0)", "b": f"abs(r * {lag('r')})"}, {f"bv{w}": f"({total('b', w)}) * {math.pi / 2}" for w in W3}, {f"j{w}": f"CASE WHEN bv{w} IS NOT NULL THEN greatest(({total('rv', w)}) - bv{w}, 0) END" for w in (20, 50)},
    out={"RV": "rv", "BV_10": "bv10", "BV_20": "bv20", "BV_50": "bv50"} | {n: e for w in (20, 50) for n, e in ((f"JumpComp_{w}", f"j{w}"), (f"JumpIdx_{w}", f"j{w} / (bv{w} + 1e-10)"), (f"VolRegime_{w}", avg("rv", w)))}))
panel("extreme_move", V.extreme_move, ["XMove"], sql(RET, {"z": f"(r - avg(r) OVER {ALL}) / (stddev_samp(r) OVER {ALL} + 1e-10)"}, out={"XMove": flag("abs(z) > 3")}))
panel("vol_kurtosis", V.kurt, ["VolKurt_20", "VolKurt_50"], sql(RET, out={f"VolKurt_{w}": roll("kurtosis(r)", "r", w) for w in (20, 50)}, digits=4), 4)
panel("vol_convexity", V.convexity, ["VolConvex_20", "VolConvex_50"], sql(RET, {f"v{w}": std("r", w) for w in (20, 50)}, out={f"VolConvex_{w}": f"v{w} - 2 * {lag(f'v{w}')} + {lag(f'v{w}', 2)}" for w in (20, 50)}))
_tail = {f"{n}{w}": f"CASE WHEN count({n}) OVER {fr(w)} >= {{k}} THEN stddev_samp({n}) OVER {fr(w)} END" for w in (20, 50) for n in "du"}
panel("tail_vol", lambda b: V.tail(b, min_periods=3), [f"{n}_{w}" for w in (20, 50) for n in ("TailDownVol", "TailUpVol", "TailRatio")], sql(
    RET, {"lo": f"quantile_cont(r, 0.1) OVER {ALL}", "hi": f"quantile_cont(r, 0.9) OVER {ALL}"}, {"d": "CASE WHEN r < lo THEN r END", "u": "CASE WHEN r > hi THEN r END"}, {n: e.format(k=3) for n, e in _tail.items()},
    out={x: e for w in (20, 50) for x, e in ((f"TailDownVol_{w}", f"d{w}"), (f"TailUpVol_{w}", f"u{w}"), (f"TailRatio_{w}", f"u{w} / (d{w} + 1e-10)"))}))
panel("vol_skew", lambda b: V.skew(b, min_periods=5), ["VolSkew_20", "VolSkew_50"], sql(
    RET, {"d": "CASE WHEN r < 0 THEN r END", "u": "CASE WHEN r > 0 THEN r END"}, {n: e.format(k=5) for n, e in _tail.items()}, out={f"VolSkew_{w}": f"(u{w} - d{w}) / (({std('r', w)}) + 1e-10)" for w in (20, 50)}))
panel("vol_transforms", lambda b: V.transforms(V.state_shift(V.ewma(b))), ["LogVol_20", "ZVol_20", "VolRatio_20", "VolShift_50"], sql(
    more=f""", src AS (SELECT symbol, ts, rn, close, coalesce(pow(close / {lag('close')} - 1, 2), 0) AS x FROM s0)""" + _recursive("0.94 * z.e + (1 - 0.94) * src.x", "x")
    + f""", y AS (SELECT z.symbol, z.ts, sqrt(z.e) AS e, src.close / (lag(src.close) OVER (PARTITION BY z.symbol ORDER BY z.ts)) - 1 AS r FROM z JOIN src ON src.symbol = z.symbol AND src.rn = z.rn), y1 AS (SELECT *, {std('r', 20)} AS v FROM y)""",
    out={"LogVol_20": "ln(v + 1e-10)", "ZVol_20": f"(v - avg(v) OVER {ALL}) / (stddev_samp(v) OVER {ALL} + 1e-10)", "VolRatio_20": "v / (e + 1e-10)", "VolShift_50": f"CASE WHEN {lag('e')} < e AND e > avg(e) OVER {ALL} THEN 1 WHEN {lag('e')} > e AND e < avg(e) OVER {ALL} THEN -1 ELSE 0 END"}, source="y1"))

# ---- structure
_cand = {"body": "close - open", "rg": "high - low", "uw": "high - greatest(open, close)", "lw": "least(open, close) - low"}
panel("swings", X.swings, [f"Swing{n}_{k}" for k in (2, 3, 5) for n in ("High", "Low")], sql(
    out={f"Swing{x.title()}_{k}": flag(f"count(*) OVER {_centre(k)} = {2 * k + 1} AND {x} = {m}({x}) OVER {_centre(k)}") for k in (2, 3, 5) for x, m in (("high", "max"), ("low", "min"))}))
panel("support_resistance", X.support_resistance, [f"{n}_{w}" for w in W3 for n in ("Support", "Resistance", "SupportStrength", "ResistanceStrength")], sql(
    {f"s{w}": bottom("low", w) for w in W3} | {f"r{w}": top("high", w) for w in W3},
    {f"ts{w}": flag(f"abs(low - s{w}) <= 0.001 * close") for w in W3} | {f"tr{w}": flag(f"abs(high - r{w}) <= 0.001 * close") for w in W3},
    out={x: e for w in W3 for x, e in ((f"Support_{w}", f"s{w}"), (f"Resistance_{w}", f"r{w}"), (f"SupportStrength_{w}", total(f"ts{w}", w)), (f"ResistanceStrength_{w}", total(f"tr{w}", w)))}))
panel("pos_in_range", X.position_in_range, [f"PosInRange_{w}" for w in W3], sql(out={f"PosInRange_{w}": f"(close - {bottom('low', w)}) / ({top('high', w)} - {bottom('low', w)} + 1e-10)" for w in W3}))
panel("ranges", X.ranges, [f"Range_{w}" for w in (5, 10, 20, 50)], sql(out={f"Range_{w}": f"({top('high', w)}) - ({bottom('low', w)})" for w in (5, 10, 20, 50)}))
_day = "(PARTITION BY symbol, CAST(ts AS DATE))"
panel("session_range", X.session_range, ["SessionRange"], sql(out={"SessionRange": f"max(high) OVER {_day} - min(low) OVER {_day}"}))
panel("candles", lambda b: X.imbalance(X.candles(b)), ["Body", "Range", "UpperWick", "LowerWick", "BodyPct", "UpperWickPct", "LowerWickPct", "WickImbalance", "BodyImbalance", "CandleDirection"], sql(
    _cand, out={"Body": "body", "Range": "rg", "UpperWick": "uw", "LowerWick": "lw", "BodyPct": "body / (rg + 1e-10)", "UpperWickPct": "uw / (rg + 1e-10)", "LowerWickPct": "lw / (rg + 1e-10)", "WickImbalance": "(uw - lw) / (rg + 1e-10)", "BodyImbalance": "body / (rg + 1e-10)", "CandleDirection": "sign(body)"}))
_lv = {f"s{w}": bottom("low", w) for w in W3} | {f"r{w}": top("high", w) for w in W3}
panel("breakouts", X.breakouts, [f"{n}_{w}" for w in W3 for n in ("Breakout", "Breakdown")], sql(
    _lv, out={x: e for w in W3 for x, e in ((f"Breakout_{w}", flag(f"{lag('close')} <= {lag(f'r{w}')} AND close > r{w}")), (f"Breakdown_{w}", flag(f"{lag('close')} >= {lag(f's{w}')} AND close < s{w}")))}))
panel("breakouts_prior_level", lambda b: X.breakouts(b, exclude_current=True), [f"{n}_{w}" for w in W3 for n in ("Breakout", "Breakdown")], sql(
    _lv, out={x: e for w in W3 for x, e in ((f"Breakout_{w}", flag(f"{lag('close')} <= {lag(f'r{w}', 2)} AND close > {lag(f'r{w}')}")), (f"Breakdown_{w}", flag(f"{lag('close')} >= {lag(f's{w}', 2)} AND close < {lag(f's{w}')}")))}))
panel("traps", lambda b: X.traps(b, exclude_current=True), [f"{n}_{w}" for w in W3 for n in ("BullTrap", "BearTrap")], sql(
    _lv, out={x: e for w in W3 for x, e in ((f"BullTrap_{w}", flag(f"high > {lag(f'r{w}')} AND close < {lag(f'r{w}')}")), (f"BearTrap_{w}", flag(f"low < {lag(f's{w}')} AND close > {lag(f's{w}')}")))}))
panel("compression", X.compression, [f"{n}_{w}" for w in W3 for n in ("Compression", "Expansion")], sql(
    TR, {f"c{w}": f"(({top('high', w)}) - ({bottom('low', w)})) / (({avg('tr', w)}) + 1e-10)" for w in W3}, out={x: e for w in W3 for x, e in ((f"Compression_{w}", avg(f"c{w}", w)), (f"Expansion_{w}", f"tr / (({avg('tr', w)}) + 1e-10)"))}))
panel("impulse", lambda b: X.impulse(X.candles(b)), [f"{n}_{w}" for w in (5, 10) for n in ("Impulse", "Continuation", "Reversal")], sql(
    _cand | {"nx": f"{lead('close')} / close - 1"}, {f"i{w}": flag(f"abs(body) > {avg('rg', w)}") for w in (5, 10)} | {"same": "coalesce(sign(body) = sign(nx), false)"},
    out={x: e for w in (5, 10) for x, e in ((f"Impulse_{w}", f"i{w}"), (f"Continuation_{w}", flag(f"i{w} = 1 AND same")), (f"Reversal_{w}", flag(f"i{w} = 1 AND NOT same")))}))
panel("rejection", lambda b: X.rejection(X.candles(b)), ["BullReject", "BearReject"], sql(_cand, out={"BullReject": flag("lw > 2 * abs(body) AND close > open"), "BearReject": flag("uw > 2 * abs(body) AND close < open")}))
panel("structure_regime", lambda b: X.structure_regime(X.candles(b)), ["StructureRegime_20", "StructureRegime_50"], sql(_cand, out={f"StructureRegime_{w}": f"coalesce(sign(rg - {lag('rg', w)}), 0)" for w in (20, 50)}))


def _strict(x: str, op: str) -> str:
    return f"{x} {op} {lag(x)} AND {lag(x)} {op} {lag(x, 2)} AND {x} {op} {lead(x)} AND {lead(x)} {op} {lead(x, 2)}"


_fr = {"fh": flag(_strict("high", ">")), "fl": flag(_strict("low", "<"))}
_prior = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
panel("fractals", lambda b: X.fractals(b, lookback=50, w=20, min_periods=2), [f"Fractal{n}_{k}" for k in (3, 5, 7) for n in ("High", "Low")] + ["FractalStrengthHigh", "FractalStrengthLow", "FractalRes", "FractalSup", "FractalBreakout", "FractalBreakdown", "FractalCompression"], sql(
    _fr, {"fhv": "CASE WHEN fh = 1 THEN high END", "flv": "CASE WHEN fl = 1 THEN low END", "mid": f"(({top('high', 20)}) + ({bottom('low', 20)})) / 2", "sz": f"({top('high', 20)}) - ({bottom('low', 20)}) + 1e-10",
          "gh": f"CASE WHEN fh = 1 THEN rn - max(CASE WHEN fh = 1 THEN rn END) OVER {_prior} END", "gl": f"CASE WHEN fl = 1 THEN rn - max(CASE WHEN fl = 1 THEN rn END) OVER {_prior} END"},
    {"res": f"CASE WHEN count(fhv) OVER {fr(50)} >= 2 THEN max(fhv) OVER {fr(50)} END", "sup": f"CASE WHEN count(flv) OVER {fr(50)} >= 2 THEN min(flv) OVER {fr(50)} END"},
    out={f"Fractal{x.title()}_{k}": flag(f"count(*) OVER {_centre(k // 2)} = {k} AND {x} = {m}({x}) OVER {_centre(k // 2)}") for k in (3, 5, 7) for x, m in (("high", "max"), ("low", "min"))}
    | {"FractalStrengthHigh": "(high - mid) / sz * fh", "FractalStrengthLow": "(mid - low) / sz * fl", "FractalRes": "res", "FractalSup": "sup", "FractalBreakout": flag(f"close > {lag('res')}"), "FractalBreakdown": flag(f"close < {lag('sup')}"),
       "FractalCompression": f"coalesce(({avg('gh', 20)}) + ({avg('gl', 20)}), 0)"}))

# ---- calendar and regimes
panel("calendar_fields", K.calendar_fields, ["DayOfWeek", "DayOfMonth", "Month", "Quarter", "Hour"], sql(out={"DayOfWeek": "isodow(ts) - 1", "DayOfMonth": "day(ts)", "Month": "month(ts)", "Quarter": "quarter(ts)", "Hour": "hour(ts)"}))
panel("calendar_one_hots", lambda b: K.one_hots(K.calendar_fields(b)), [f"DOW_{i}" for i in range(7)] + [f"H_{i}" for i in range(24)] + [f"Month_{i}" for i in (1, 12)], sql(
    out={f"DOW_{i}": flag(f"isodow(ts) = {i + 1}") for i in range(7)} | {f"H_{i}": flag(f"hour(ts) = {i}") for i in range(24)} | {f"Month_{i}": flag(f"month(ts) = {i}") for i in (1, 12)}))
panel("turn_of_month", K.month_turns, ["TurnOfMonth", "EOM", "EOQ"], sql(
    {"d": "day(ts)", "l": "day(last_day(ts))", "q": "day(last_day(CAST(date_trunc('quarter', ts) AS DATE) + INTERVAL 2 MONTH))"}, out={"TurnOfMonth": "CASE WHEN d <= 3 THEN 1 WHEN d >= l - 2 THEN -1 ELSE 0 END", "EOM": flag("d >= l - 1"), "EOQ": flag("d >= q - 4")}))
_hol = ", ".join(f"TIMESTAMP '{d} 00:00:00'" for d in K.federal_holidays(2023, 2025))
panel("holiday_distance", K.holiday_distance, ["DaysToHoliday", "DaysFromHoliday"], sql(
    more=f""", h AS (SELECT unnest([{_hol}]) AS h), lim AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM s0 GROUP BY 1),
    j AS (SELECT s0.symbol, s0.ts, (SELECT min(h) FROM h, lim WHERE lim.symbol = s0.symbol AND h >= a AND h <= b AND h >= s0.ts) AS nx, (SELECT max(h) FROM h, lim WHERE lim.symbol = s0.symbol AND h >= a AND h <= b AND h <= s0.ts) AS lx FROM s0)""",
    out={"DaysToHoliday": "floor(epoch(nx - ts) / 86400)", "DaysFromHoliday": "floor(epoch(ts - lx) / 86400)"}, source="j"))
_dow = "(PARTITION BY symbol, {p} ORDER BY ts ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"
panel("seasonal_return", lambda b: K.seasonal_returns(K.calendar_fields(b)), [f"{n}_{w}" for w in (5, 10, 20) for n in ("DOWReturn", "MonthReturn")], sql(
    RET, {"dw": "isodow(ts)", "mo": "month(ts)"}, out={f"{n}_{w}": f"CASE WHEN count(r) OVER {_dow.format(p=p, k=w - 1)} = {w} THEN avg(r) OVER {_dow.format(p=p, k=w - 1)} END" for w in (5, 10, 20) for n, p in (("DOWReturn", "dw"), ("MonthReturn", "mo"))}))
panel("trend_regime", G.trend_regime, ["TrendRegClass_3"], sql({"s": slope("close", 50)}, {"z": f"(s - avg(s) OVER {ALL}) / (stddev_samp(s) OVER {ALL} + 1e-10)"}, out={"TrendRegClass_3": "CASE WHEN z > 0.5 THEN 1 WHEN z < -0.5 THEN -1 ELSE 0 END"}))
_vr = f", src AS (SELECT symbol, ts, rn, coalesce(pow(close / {lag('close')} - 1, 2), 0) AS x FROM s0)" + _recursive("0.94 * z.e + (1 - 0.94) * src.x", "x") + ", y AS (SELECT symbol, ts, rn, sqrt(e) AS e FROM z)"
panel("vol_regime", lambda b: G.vol_regime(V.ewma(b)), ["VolRegClass_4"], sql(more=_vr, out={"VolRegClass_4": " + ".join(f"(CASE WHEN e > quantile_cont(e, {q}) OVER {ALL} THEN 1 ELSE 0 END)" for q in (0.25, 0.5, 0.75))}, source="y"))
_tr = {"s": slope("close", 50)}, {"z": f"(s - avg(s) OVER {ALL}) / (stddev_samp(s) OVER {ALL} + 1e-10)"}, {"c": "CASE WHEN z > 0.5 THEN 1 WHEN z < -0.5 THEN -1 ELSE 0 END"}
panel("regime_runs", lambda b: G.shifts(G.persistence(G.trend_regime(b), "TrendRegClass_3"), "TrendRegClass_3"), ["RegimePersistence", "RegimeShift"], sql(
    *_tr, {"st": flag(f"{lag('c')} IS DISTINCT FROM c")}, {"run": f"sum(st) OVER {RUN}"}, {"k": "row_number() OVER (PARTITION BY symbol, run ORDER BY ts)"},
    out={"RegimePersistence": "CASE WHEN run = 1 AND k > 1 THEN k - 1 ELSE k END", "RegimeShift": f"coalesce(sign(c - {lag('c')}), 0)"}))
panel("cluster_drift", lambda b: G.switch_risk(G.drift(G.trend_regime(b), "TrendRegClass_3"), "TrendRegClass_3"), ["ClusterDrift", "SwitchRisk"], sql(
    *_tr, {"g": flag(f"c <> {lag('c')}")}, out={"ClusterDrift": f"CASE WHEN rn >= 20 THEN sum(g) OVER ({W} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) / 20.0 ELSE 0 END", "SwitchRisk": avg("g", 20)}))
query("regime_transition", sql(*_tr, {"p": lag("c")}, out={"n": "n", "p": "n / sum(n) OVER (PARTITION BY symbol, from_state)"}, keys=("symbol", "from_state", "to_state"), source="(SELECT symbol, p AS from_state, c AS to_state, count(*) AS n FROM s4 WHERE p IS NOT NULL GROUP BY 1, 2, 3)"))(
    lambda spark, d: rounded(G.transition_matrix(G.trend_regime(hourly(spark, d)), "TrendRegClass_3"), ["n", "p"], keys=("symbol", "from_state", "to_state")))
query("regime_fingerprints", sql(
    *_tr, {"r": "close / lag(close) OVER (PARTITION BY symbol, c ORDER BY ts) - 1"}, {"v": "CASE WHEN count(r) OVER (PARTITION BY symbol, c ORDER BY ts ROWS 19 PRECEDING) = 20 THEN stddev_samp(r) OVER (PARTITION BY symbol, c ORDER BY ts ROWS 19 PRECEDING) END"},
    out={"Volatility": "v", "Slope": "r", "Range": "g", "Return": "r"}, keys=("symbol", '"TrendRegClass_3"'), source="(SELECT symbol, c AS \"TrendRegClass_3\", avg(v) AS v, avg(r) AS r, avg(high - low) AS g FROM s5 GROUP BY 1, 2)"))(
    lambda spark, d: rounded(G.fingerprints(G.trend_regime(hourly(spark, d)), "TrendRegClass_3"), ["Volatility", "Slope", "Range", "Return"], keys=("symbol", "TrendRegClass_3")))

# ---- bars
panel("bars_hourly", lambda b: b, ["open", "high", "low", "close", "volume"], sql(out=["open", "high", "low", "close", "volume"]))
query("bars_resampled", """SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, round(arg_min(100.0 + value, ts), 6) AS open, round(max(100.0 + value), 6) AS high, round(min(100.0 + value), 6) AS low,
  round(arg_max(100.0 + value, ts), 6) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""")(lambda spark, d: rounded(B.resample(hourly(spark, d), "4 hours"), ["open", "high", "low", "close", "volume"]))
panel("returns", B.returns, ["ret", "logret"], sql(out={"ret": f"coalesce(close / {lag('close')} - 1, 0)", "logret": f"coalesce(ln(close / {lag('close')}), 0)"}))
panel("spike_filter", B.spike_filter, ["close"], sql({"m": roll("quantile_cont(close, 0.5)", "close", 50)}, {"d": "abs(close - m)"}, {"k": roll("quantile_cont(d, 0.5)", "d", 50)}, out=["close"], where="WHERE d < 10 * k"))
panel("session_filter", B.in_session, ["close"], sql(out=["close"], where="WHERE hour(ts) * 60 + minute(ts) BETWEEN 870 AND 1260"))
query("bar_gap_profile", sql(
    {"gap": f"date_diff('second', {lag('ts')}, ts)"}, {"mode_gap": f"mode(gap) OVER {ALL}"},
    out={"mode_gap": "any_value(mode_gap)", "median_gap": "quantile_cont(gap, 0.5)", "mean_gap": "avg(gap)", "cv": "stddev_samp(gap) / avg(gap)", "cv_inner": "stddev_samp(gap) FILTER (gap <= 4 * mode_gap) / avg(gap) FILTER (gap <= 4 * mode_gap)", "n_inner": "count(*) FILTER (gap <= 4 * mode_gap)", "n_gaps": "count(gap)"},
    keys=("symbol",), where="WHERE gap IS NOT NULL GROUP BY symbol"))(lambda spark, d: rounded(B.gap_profile(hourly(spark, d)), ["mode_gap", "median_gap", "mean_gap", "cv", "cv_inner", "n_inner", "n_gaps"], keys=("symbol",)))
