"""Trend features over closes (and highs and lows): window forms; recurrences are in scan.py."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import (
    EPS, before, by_symbol, centred, change, flag, full, high, low, mean, row_id, std, total, trailing, whole,
)
from .scan import rsi, scan, trend_recurrences

MA_WINDOWS = (3, 5, 8, 10, 12, 20, 21, 34, 50, 89, 100, 144, 200)


def true_range() -> Column:
    last = before("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def prelim(bars: DataFrame) -> DataFrame:
    """Return, LogRet, TrueRange, ATR_14 and VolRet: shared by every feature group, so named once."""
    last = before("close")
    one = bars.withColumns({"Return": F.try_divide(F.col("close"), last) - 1, "LogRet": F.log(F.try_divide(F.col("close"), last)), "TrueRange": true_range()})
    return one.withColumns({"ATR_14": mean("TrueRange", 14), "VolRet": std("Return", 20)})


def slope(x: str, w: int, position: str = "__rn") -> Column:
    frame = trailing(w)
    return full(F.regr_slope(F.col(x), F.col(position)).over(frame), x, frame, w)


def sma(bars: DataFrame, windows: tuple[int, ...] = MA_WINDOWS) -> DataFrame:
    return bars.withColumns({f"SMA_{w}": mean("close", w) for w in windows})


def _weighted(x: str, w: int) -> Column:
    """Mean weighted 1..w: the plain mean plus the regression slope times (w - 1) / 6."""
    return mean(x, w) + slope(x, w) * (w - 1) / 6


def wma(bars: DataFrame, windows: tuple[int, ...] = MA_WINDOWS) -> DataFrame:
    return bars.withColumn("__rn", row_id()).withColumns({f"WMA_{w}": _weighted("close", w) for w in windows}).drop("__rn")


def hma(bars: DataFrame, windows: tuple[int, ...] = MA_WINDOWS) -> DataFrame:
    usable = [w for w in windows if w // 2 >= 2 and math.isqrt(w) >= 2]
    rows = bars.withColumn("__rn", row_id()).withColumns({f"__h{w}": 2 * _weighted("close", w // 2) - _weighted("close", w) for w in usable})
    return rows.withColumns({f"HMA_{w}": _weighted(f"__h{w}", math.isqrt(w)) for w in usable}).drop("__rn", *[f"__h{w}" for w in usable])


def stochastic(bars: DataFrame, windows: tuple[int, ...] = (14, 21)) -> DataFrame:
    k = {f"StochK_{w}": 100 * (F.col("close") - low("low", w)) / (high("high", w) - low("low", w) + EPS) for w in windows}
    return bars.withColumns(k).withColumns({f"StochD_{w}": mean(f"StochK_{w}", 3) for w in windows})


def roc(bars: DataFrame, windows: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    return bars.withColumns({f"ROC_{w}": 100 * (F.try_divide(F.col("close"), before("close", w)) - 1) for w in windows})


def williams_r(bars: DataFrame, windows: tuple[int, ...] = (14, 28)) -> DataFrame:
    return bars.withColumns({f"WilliamsR_{w}": -100 * (high("high", w) - F.col("close")) / (high("high", w) - low("low", w) + EPS) for w in windows})


def cmo(bars: DataFrame, windows: tuple[int, ...] = (14, 21)) -> DataFrame:
    rows = bars.withColumn("__d", change("close"))
    up, down = F.when(F.col("__d").isNotNull(), F.greatest("__d", F.lit(0.0))), F.when(F.col("__d").isNotNull(), F.greatest(-F.col("__d"), F.lit(0.0)))
    rows = rows.withColumns({"__u": up, "__v": down})
    return rows.withColumns({f"CMO_{w}": 100 * (total("__u", w) - total("__v", w)) / (total("__u", w) + total("__v", w) + EPS) for w in windows}).drop("__d", "__u", "__v")


def ultimate(bars: DataFrame, windows: tuple[int, int, int] = (7, 14, 28)) -> DataFrame:
    last = before("close")
    floor, top = F.least("low", last), F.greatest("high", last)  # null-skipping, so the first row has them
    rows = bars.withColumns({"__bp": F.col("close") - floor, "__tr": top - floor})
    a, b, c = (total("__bp", w) / (total("__tr", w) + EPS) for w in windows)
    return rows.withColumn("UltimateOsc", 100 * (4 * a + 2 * b + c) / 7).drop("__bp", "__tr")


def awesome(bars: DataFrame) -> DataFrame:
    rows = bars.withColumn("__m", (F.col("high") + F.col("low")) / 2)
    return rows.withColumn("AO", mean("__m", 5) - mean("__m", 34)).drop("__m")


def reg_slope(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    return bars.withColumn("__rn", row_id()).withColumns({f"RegSlope_{w}": slope("close", w) for w in windows}).drop("__rn")


def reg_r2(bars: DataFrame, windows: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    rows = bars.withColumn("__rn", row_id())
    return rows.withColumns({f"RegR2_{w}": full(F.regr_r2(F.col("close"), F.col("__rn")).over(trailing(w)), "close", trailing(w), w) for w in windows}).drop("__rn")


def reg_deviation(bars: DataFrame, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    """Residual of the newest point against the line through its window."""
    rows = bars.withColumn("__rn", row_id())
    return rows.withColumns({f"RegDev_{w}": F.col("close") - (mean("close", w) + slope("close", w) * (w - 1) / 2) for w in windows}).drop("__rn")


def curvature(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    rows = bars.withColumns({f"__s{w}": mean("close", w) for w in windows})
    return rows.withColumns({f"Curv_{w}": F.col(f"__s{w}") - 2 * before(f"__s{w}") + before(f"__s{w}", 2) for w in windows}).drop(*[f"__s{w}" for w in windows])


def acceleration(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    rows = bars.withColumn("__rn", row_id()).withColumns({f"__s{w}": slope("close", w) for w in windows})
    return rows.withColumns({f"Accel_{w}": change(f"__s{w}") for w in windows}).drop("__rn", *[f"__s{w}" for w in windows])


def slope_flip(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """1 where the slope turns from below to above zero, -1 the other way, else 0."""
    rows = bars.withColumn("__rn", row_id()).withColumns({f"__s{w}": slope("close", w) for w in windows})

    def turn(w: int) -> Column:
        now, last = F.col(f"__s{w}"), before(f"__s{w}")
        return F.when((last < 0) & (now > 0), 1).when((last > 0) & (now < 0), -1).otherwise(0)

    return rows.withColumns({f"SlopeFlip_{w}": turn(w) for w in windows}).drop("__rn", *[f"__s{w}" for w in windows])


def dpo(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 30)) -> DataFrame:
    rows = bars.withColumns({f"__s{w}": mean("close", w) for w in windows})
    return rows.withColumns({f"DPO_{w}": F.col("close") - before(f"__s{w}", w // 2 + 1) for w in windows}).drop(*[f"__s{w}" for w in windows])


def persistence(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """(rises - others) / w of the closes' changes; no change counts with the falls."""
    rows = bars.withColumn("__d", change("close")).withColumn("__s", F.when(F.col("__d") > 0, 1.0).when(F.col("__d").isNotNull(), -1.0))
    return rows.withColumns({f"TrendPersist_{w}": total("__s", w) / w for w in windows}).drop("__d", "__s")


def noise_ratio(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """Path length over net move of the w bars before the current one (w - 1 steps)."""
    rows = bars.withColumn("__a", F.abs(change("close")))

    def ratio(w: int) -> Column:
        steps = by_symbol().rowsBetween(-(w - 1), -1)
        net = F.abs(before("close", 1) - before("close", w))
        return F.when(before("close", w).isNotNull(), F.sum("__a").over(steps) / (net + EPS))

    return rows.withColumns({f"NSR_{w}": ratio(w) for w in windows}).drop("__a")


def vol_adjusted_slope(bars: DataFrame, windows: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    rows = bars.withColumns({"__rn": row_id(), "__r": F.try_divide(F.col("close"), before("close")) - 1})
    return rows.withColumns({f"VASlope_{w}": slope("close", w) / (std("__r", w) * math.sqrt(252) + EPS) for w in windows}).drop("__rn", "__r")


def trend_strength(bars: DataFrame, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    """Slope over the deviation of the last w changes of the whole series: a look-ahead scalar, kept for parity."""
    rows = bars.withColumns({"__rn": row_id(), "__d": change("close"), "__n": F.count(F.lit(1)).over(whole())})
    late = {w: F.stddev_pop(F.when((F.col("__rn") > F.col("__n") - w) & (F.col("__n") > w), F.col("__d"))).over(whole()) for w in windows}
    return rows.withColumns({f"TSI2_{w}": slope("close", w) / (late[w] + EPS) for w in windows}).drop("__rn", "__d", "__n")


def local_extrema(bars: DataFrame, sides: tuple[int, ...] = (3, 5, 10), causal: bool = False) -> DataFrame:
    """1 at a centred extremum of the closes; ``causal`` reports it only when its k later bars are known."""
    out = {}
    for k in sides:
        frame = centred(k)
        there = F.count("close").over(frame) == 2 * k + 1
        out[f"LocalMax_{k}"] = flag(there & (F.col("close") == F.max("close").over(frame)))
        out[f"LocalMin_{k}"] = flag(there & (F.col("close") == F.min("close").over(frame)))
    rows = bars.withColumns(out)
    return rows.withColumns({n: F.coalesce(before(n, int(n.split("_")[1])), F.lit(0)) for n in out}) if causal else rows


def extension(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    return bars.withColumns({f"Extension_{w}": (F.col("close") - mean("close", w)) / (mean("close", w) + EPS) for w in windows})


def band_width(bars: DataFrame, w: int = 20, atr: int = 14) -> DataFrame:
    rows = bars.withColumn("__tr", true_range())
    spread = high("high", atr) - low("low", atr)
    return rows.withColumns({f"BBWidth_{w}": 4 * std("close", w) / (mean("close", w) + EPS), f"ATRCompress_{atr}": mean("__tr", atr) / (spread + EPS)}).drop("__tr")


def trend_consistency(bars: DataFrame, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    rows = bars.withColumn("__tr", true_range())
    return rows.withColumns({f"TCI_{w}": std("close", w) / (mean("__tr", 20) + EPS) for w in windows}).drop("__tr")


def divergence(bars: DataFrame, windows: tuple[int, ...] = (14, 20)) -> DataFrame:
    """Price at a new high (low) of its window while the RSI is below (above) the extreme it had a bar ago."""
    rows = scan(bars, {f"__rsi{w}": ("close", rsi, {"w": w}) for w in windows})
    rows = rows.withColumns({f"__{n}{w}": fn(f"__rsi{w}", w) for w in windows for n, fn in (("h", high), ("l", low))})
    out = {}
    for w in windows:
        out[f"BearDiv_{w}"] = flag((F.col("close") >= high("close", w)) & (F.col(f"__rsi{w}") < before(f"__h{w}")))
        out[f"BullDiv_{w}"] = flag((F.col("close") <= low("close", w)) & (F.col(f"__rsi{w}") > before(f"__l{w}")))
    return rows.withColumns(out).drop(*[f"__{n}{w}" for w in windows for n in ("rsi", "h", "l")])


STEPS = (
    sma, wma, hma, stochastic, roc, williams_r, cmo, ultimate, awesome, reg_slope, reg_r2, reg_deviation, curvature, acceleration, slope_flip, dpo, persistence,
    noise_ratio, vol_adjusted_slope, trend_strength, local_extrema, extension, band_width, trend_consistency, divergence, trend_recurrences,
)


def add_trend(bars: DataFrame) -> DataFrame:
    """Every trend column."""
    for step in STEPS:
        bars = bars.transform(step)
    return bars


