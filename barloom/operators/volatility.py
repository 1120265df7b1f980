"""Volatility features. ``ret`` here is the simple return, NULL on the first bar."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import EPS, before, flag, high, kurtosis_adjusted, low, mean, rolled, std, total, trailing, var, whole
from .scan import ewma_columns
from .trend import true_range

LN2 = math.log(2)


def with_ret(bars: DataFrame) -> DataFrame:
    return bars if "ret" in bars.columns else bars.withColumn("ret", F.try_divide(F.col("close"), before("close")) - 1)


def parkinson(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    rows = bars.withColumn("__p", F.pow(F.log(F.col("high") / F.col("low")), 2))
    return rows.withColumns({f"Parkinson_{w}": F.sqrt(mean("__p", w) / (4 * LN2)) for w in windows}).drop("__p")


def garman_klass(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50), floor: bool = True) -> DataFrame:
    """``floor``: bars of negative variance count 0; without it a negative mean gives NULL."""
    one = 0.5 * F.pow(F.log(F.col("high") / F.col("low")), 2) - (2 * LN2 - 1) * F.pow(F.log(F.col("close") / F.col("open")), 2)
    rows = bars.withColumn("__g", F.greatest(one, F.lit(0.0)) if floor else one)
    return rows.withColumns({f"GK_{w}": _root(mean("__g", w)) for w in windows}).drop("__g")


def _root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def _rs() -> Column:
    h, lo, c, o = (F.col(n) for n in ("high", "low", "close", "open"))
    return F.log(h / c) * F.log(h / o) + F.log(lo / c) * F.log(lo / o)


def rogers_satchell(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50), floor: bool = True) -> DataFrame:
    rows = bars.withColumn("__r", _rs())
    return rows.withColumns({f"RS_{w}": F.when(mean("__r", w).isNotNull(), F.sqrt(F.greatest(mean("__r", w), F.lit(0.0)))) if floor else _root(mean("__r", w)) for w in windows}).drop("__r")


def yang_zhang(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    rows = bars.withColumns({"__o": F.log(F.col("open") / before("close")), "__c": F.log(F.col("close") / F.col("open")), "__r": _rs()})

    def one(w: int) -> Column:
        k = 0.34 / (1.34 + (w + 1) / (w - 1))
        inner = F.greatest(mean("__r", w), F.lit(0.0))
        return F.when(var("__o", w).isNotNull(), _root(var("__o", w) + k * var("__c", w) + (1 - k) * inner))

    return rows.withColumns({f"YZ_{w}": one(w) for w in windows}).drop("__o", "__c", "__r")


def basic(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """Vol, Var and VolOfVol."""
    rows = with_ret(bars).withColumns({f"Vol_{w}": std("ret", w) for w in windows} | {f"Var_{w}": var("ret", w) for w in windows})
    return rows.withColumns({f"VolOfVol_{w}": std(f"Vol_{w}", w) for w in windows})


def clustering(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    rows = with_ret(bars).withColumn("__a", F.abs("ret"))
    return rows.withColumns({f"VolCluster_{w}": mean("__a", w) / (std("__a", w) + EPS) for w in windows}).drop("__a")


def shock_recovery(bars: DataFrame, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    rows = with_ret(bars).withColumns({f"__v{w}": std("ret", w) for w in windows})
    out = {f"ShockRec_{w}": (F.col(f"__v{w}") - low(f"__v{w}", w)) / (high(f"__v{w}", w) - low(f"__v{w}", w) + EPS) for w in windows}
    return rows.withColumns(out).drop(*[f"__v{w}" for w in windows])


def up_down(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """Deviation of the rises (falls), with all other returns, and the first row, as 0."""
    rows = with_ret(bars).withColumns({"__u": F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0), "__d": F.when(F.col("ret") < 0, F.col("ret")).otherwise(0.0)})
    out = {f"UpsideVol_{w}": std("__u", w) for w in windows} | {f"DownsideVol_{w}": std("__d", w) for w in windows}
    return rows.withColumns(out).withColumns({f"UDRatio_{w}": F.col(f"UpsideVol_{w}") / (F.col(f"DownsideVol_{w}") + EPS) for w in windows}).drop("__u", "__d")


def realized(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """RV (squared return, 0 at first), bipower variation, jump part and index (for windows over 10), and mean squared return."""
    rows = with_ret(bars).withColumn("RV", F.coalesce(F.pow("ret", F.lit(2)), F.lit(0.0)))
    rows = rows.withColumn("__b", F.abs(F.col("ret") * before("ret"))).withColumns({f"BV_{w}": total("__b", w) * math.pi / 2 for w in windows})
    late = [w for w in windows if w > 10]
    rows = rows.withColumns({f"JumpComp_{w}": F.greatest(total("RV", w) - F.col(f"BV_{w}"), F.col(f"BV_{w}") * 0) for w in late})
    out = {f"JumpIdx_{w}": F.col(f"JumpComp_{w}") / (F.col(f"BV_{w}") + EPS) for w in late} | {f"VolRegime_{w}": mean("RV", w) for w in late}
    return rows.withColumns(out).drop("__b")


def tail(bars: DataFrame, windows: tuple[int, ...] = (20, 50), share: float = 0.1, min_periods: int | None = None) -> DataFrame:
    """Deviation of returns beyond whole-sample quantiles; a full window of tail returns is needed unless ``min_periods`` says less."""
    rows = with_ret(bars).withColumns({"__lo": F.percentile("ret", F.lit(share)).over(whole()), "__hi": F.percentile("ret", F.lit(1 - share)).over(whole())})
    rows = rows.withColumns({"__d": F.when(F.col("ret") < F.col("__lo"), F.col("ret")), "__u": F.when(F.col("ret") > F.col("__hi"), F.col("ret"))})

    def one(x: str, w: int) -> Column:
        return F.when(F.count(x).over(trailing(w)) >= (min_periods or w), F.stddev_samp(x).over(trailing(w)))

    out = {f"TailDownVol_{w}": one("__d", w) for w in windows} | {f"TailUpVol_{w}": one("__u", w) for w in windows}
    return rows.withColumns(out).withColumns({f"TailRatio_{w}": F.col(f"TailUpVol_{w}") / (F.col(f"TailDownVol_{w}") + EPS) for w in windows}).drop("__lo", "__hi", "__d", "__u")


def extreme_move(bars: DataFrame, limit: float = 3.0) -> DataFrame:
    z = (F.col("ret") - F.avg("ret").over(whole())) / (F.stddev_samp("ret").over(whole()) + EPS)
    return with_ret(bars).withColumn("XMove", flag(F.abs(z) > limit))


def skew(bars: DataFrame, windows: tuple[int, ...] = (20, 50), min_periods: int | None = None) -> DataFrame:
    rows = with_ret(bars).withColumns({"__u": F.when(F.col("ret") > 0, F.col("ret")), "__d": F.when(F.col("ret") < 0, F.col("ret"))})

    def one(x: str, w: int) -> Column:
        return F.when(F.count(x).over(trailing(w)) >= (min_periods or w), F.stddev_samp(x).over(trailing(w)))

    return rows.withColumns({f"VolSkew_{w}": (one("__u", w) - one("__d", w)) / (std("ret", w) + EPS) for w in windows}).drop("__u", "__d")


def kurt(bars: DataFrame, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    return with_ret(bars).withColumns({f"VolKurt_{w}": kurtosis_adjusted(rolled(F.kurtosis, "ret", w), F.lit(w)) for w in windows})


def convexity(bars: DataFrame, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    rows = with_ret(bars).withColumns({f"__v{w}": std("ret", w) for w in windows})
    return rows.withColumns({f"VolConvex_{w}": F.col(f"__v{w}") - 2 * before(f"__v{w}") + before(f"__v{w}", 2) for w in windows}).drop(*[f"__v{w}" for w in windows])


def ewma(bars: DataFrame) -> DataFrame:
    return ewma_columns(with_ret(bars))


def state_shift(rows: DataFrame) -> DataFrame:
    """1 where EWMA_94 rises above its whole-sample mean, -1 where it falls below; needs ``ewma``."""
    e, m = F.col("EWMA_94"), F.avg("EWMA_94").over(whole())
    return rows.withColumn("VolShift_50", F.when((before("EWMA_94") < e) & (e > m), 1).when((before("EWMA_94") > e) & (e < m), -1).otherwise(0))


def transforms(rows: DataFrame, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    """LogVol, ZVol (whole-sample) and VolRatio to EWMA_94; needs ``ewma``."""
    rows = with_ret(rows).withColumns({f"__v{w}": std("ret", w) for w in windows})
    out = {}
    for w in windows:
        v = F.col(f"__v{w}")
        out[f"LogVol_{w}"] = F.log(v + EPS)
        out[f"ZVol_{w}"] = (v - F.avg(v).over(whole())) / (F.stddev_samp(v).over(whole()) + EPS)
        out[f"VolRatio_{w}"] = v / (F.col("EWMA_94") + EPS)
    return rows.withColumns(out).drop(*[f"__v{w}" for w in windows])


STEPS = (parkinson, garman_klass, rogers_satchell, yang_zhang, basic, ewma, clustering, shock_recovery, up_down, realized, tail, extreme_move, skew, kurt, convexity, state_shift, transforms)


def add_volatility(bars: DataFrame) -> DataFrame:
    for step in STEPS:
        bars = bars.transform(step)
    return bars


def atr(bars: DataFrame, w: int = 14) -> DataFrame:
    return bars.withColumn("TrueRange", true_range()).withColumn(f"ATR_{w}", mean("TrueRange", w))
