"""Market structure: swings, support and resistance, candles, breakouts, traps, compression, impulses, rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import EPS, after, before, by_symbol, centred, flag, full, high, low, mean, total, trailing
from .trend import true_range


def swings(bars: DataFrame, sides: tuple[int, ...] = (2, 3, 5), causal: bool = False) -> DataFrame:
    """1 where the high (low) is the extreme of k bars on either side; ``causal`` reports it k bars later."""
    out = {}
    for k in sides:
        there = F.count(F.lit(1)).over(centred(k)) == 2 * k + 1
        out[f"SwingHigh_{k}"] = flag(there & (F.col("high") == F.max("high").over(centred(k))))
        out[f"SwingLow_{k}"] = flag(there & (F.col("low") == F.min("low").over(centred(k))))
    rows = bars.withColumns(out)
    return rows.withColumns({n: F.coalesce(before(n, int(n.split("_")[1])), F.lit(0)) for n in out}) if causal else rows


def support_resistance(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50), tolerance: float = 0.001) -> DataFrame:
    """Levels, and how many of the last w bars touched theirs."""
    rows = bars.withColumns({f"Support_{w}": low("low", w) for w in windows} | {f"Resistance_{w}": high("high", w) for w in windows})
    touch = {f"__s{w}": flag(F.abs(F.col("low") - F.col(f"Support_{w}")) <= tolerance * F.col("close")) for w in windows}
    touch |= {f"__r{w}": flag(F.abs(F.col("high") - F.col(f"Resistance_{w}")) <= tolerance * F.col("close")) for w in windows}
    out = {f"SupportStrength_{w}": total(f"__s{w}", w) for w in windows} | {f"ResistanceStrength_{w}": total(f"__r{w}", w) for w in windows}
    return rows.withColumns(touch).withColumns(out).drop(*touch)


def position_in_range(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    return bars.withColumns({f"PosInRange_{w}": (F.col("close") - low("low", w)) / (high("high", w) - low("low", w) + EPS) for w in windows})


def ranges(bars: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    return bars.withColumns({f"Range_{w}": high("high", w) - low("low", w) for w in windows})


def session_range(bars: DataFrame, causal: bool = False) -> DataFrame:
    """The day's high less its low on each of its bars; ``causal`` uses the day so far."""
    day = Window.partitionBy("symbol", F.to_date("ts"))
    if causal:
        day = day.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("SessionRange", F.max("high").over(day) - F.min("low").over(day))


def candles(bars: DataFrame) -> DataFrame:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    rows = bars.withColumns({"Body": F.col("close") - F.col("open"), "Range": F.col("high") - F.col("low"), "UpperWick": F.col("high") - top, "LowerWick": bottom - F.col("low")})
    size = F.col("Range") + EPS
    return rows.withColumns({"BodyPct": F.col("Body") / size, "UpperWickPct": F.col("UpperWick") / size, "LowerWickPct": F.col("LowerWick") / size})


def breakouts(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50), exclude_current: bool = False) -> DataFrame:
    """Close crosses its rolling level. The level includes the current bar unless ``exclude_current``, so the plain form never fires on valid bars."""
    rows = bars.withColumns({f"__s{w}": low("low", w) for w in windows} | {f"__r{w}": high("high", w) for w in windows})
    out = {}
    for w in windows:
        s, r = (before(f"__s{w}"), before(f"__r{w}")) if exclude_current else (F.col(f"__s{w}"), F.col(f"__r{w}"))
        s1, r1 = before(f"__s{w}", 2 if exclude_current else 1), before(f"__r{w}", 2 if exclude_current else 1)
        out[f"Breakout_{w}"] = flag((before("close") <= r1) & (F.col("close") > r))
        out[f"Breakdown_{w}"] = flag((before("close") >= s1) & (F.col("close") < s))
    return rows.withColumns(out).drop(*[f"__{n}{w}" for n in "sr" for w in windows])


def traps(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50), exclude_current: bool = False) -> DataFrame:
    rows = bars.withColumns({f"__s{w}": low("low", w) for w in windows} | {f"__r{w}": high("high", w) for w in windows})
    out = {}
    for w in windows:
        s, r = (before(f"__s{w}"), before(f"__r{w}")) if exclude_current else (F.col(f"__s{w}"), F.col(f"__r{w}"))
        out[f"BullTrap_{w}"] = flag((F.col("high") > r) & (F.col("close") < r))
        out[f"BearTrap_{w}"] = flag((F.col("low") < s) & (F.col("close") > s))
    return rows.withColumns(out).drop(*[f"__{n}{w}" for n in "sr" for w in windows])


def compression(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    rows = bars.withColumn("__t", true_range())
    rows = rows.withColumns({f"__c{w}": (high("high", w) - low("low", w)) / (mean("__t", w) + EPS) for w in windows})
    out = {f"Compression_{w}": mean(f"__c{w}", w) for w in windows} | {f"Expansion_{w}": F.col("__t") / (mean("__t", w) + EPS) for w in windows}
    return rows.withColumns(out).drop("__t", *[f"__c{w}" for w in windows])


def imbalance(rows: DataFrame) -> DataFrame:
    """Needs ``candles``."""
    size = F.col("Range") + EPS
    return rows.withColumns({"WickImbalance": (F.col("UpperWick") - F.col("LowerWick")) / size, "BodyImbalance": F.col("Body") / size, "CandleDirection": F.signum("Body")})


def impulse(rows: DataFrame, windows: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Impulse of the bar, and whether the next bar goes on or turns back (look-ahead labels); needs ``candles``.

    On the last bar the next return is unknown: an impulse there counts as a reversal.
    """
    next_sign = F.signum(F.try_divide(after("close"), F.col("close")) - 1)
    rows = rows.withColumns({"__n": next_sign} | {f"Impulse_{w}": flag(F.abs("Body") > mean("Range", w)) for w in windows})
    same = F.coalesce(F.signum("Body") == F.col("__n"), F.lit(False))
    out = {f"Continuation_{w}": flag((F.col(f"Impulse_{w}") == 1) & same) for w in windows} | {f"Reversal_{w}": flag((F.col(f"Impulse_{w}") == 1) & ~same) for w in windows}
    return rows.withColumns(out).drop("__n")


def rejection(rows: DataFrame, times: float = 2.0) -> DataFrame:
    """Needs ``candles``."""
    body = F.abs("Body")
    return rows.withColumns({
        "BullReject": flag((F.col("LowerWick") > times * body) & (F.col("close") > F.col("open"))),
        "BearReject": flag((F.col("UpperWick") > times * body) & (F.col("close") < F.col("open"))),
    })


def structure_regime(rows: DataFrame, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    """Sign of the change of the mean range, 0 where unknown; needs ``candles``.

    Two neighbouring means over w bars differ by the newest value less the one w bars back,
    which tells the sign without rounding errors.
    """
    out = {f"StructureRegime_{w}": F.coalesce(F.signum(F.col("Range") - before("Range", w)), F.lit(0.0)) for w in windows}
    return rows.withColumns(out)


# ---- fractals


def _run(x: str, up: bool) -> Column:
    a, b, c, d, e = before(x, 2), before(x), F.col(x), after(x), after(x, 2)
    return (c > b) & (b > a) & (c > d) & (d > e) if up else (c < b) & (b < a) & (c < d) & (d < e)


def fractals(bars: DataFrame, sizes: tuple[int, ...] = (3, 5, 7), lookback: int = 50, w: int = 20, min_periods: int | None = None) -> DataFrame:
    """Five-bar fractals (strictly monotone on both sides), adaptive ones of odd sizes, strength, lines, breaks, compression.

    The adaptive size 5 takes the name FractalHigh_5 / FractalLow_5; lines, strength and
    compression use the strict ones.
    """
    if any(n % 2 == 0 for n in sizes):
        raise ValueError("fractal sizes are odd")
    rows = bars.withColumns({"__fh": flag(_run("high", True)), "__fl": flag(_run("low", False))})
    out = {}
    for n in sizes:
        k = n // 2
        there = F.count(F.lit(1)).over(centred(k)) == n
        out[f"FractalHigh_{n}"] = flag(there & (F.col("high") == F.max("high").over(centred(k))))
        out[f"FractalLow_{n}"] = flag(there & (F.col("low") == F.min("low").over(centred(k))))
    top, bottom = high("high", w), low("low", w)
    middle, size = (top + bottom) / 2, top - bottom + EPS
    out["FractalStrengthHigh"] = (F.col("high") - middle) / size * F.col("__fh")
    out["FractalStrengthLow"] = (middle - F.col("low")) / size * F.col("__fl")
    rows = rows.withColumns(out | {"__h": F.when(F.col("__fh") == 1, F.col("high")), "__l": F.when(F.col("__fl") == 1, F.col("low"))})
    need = min_periods or lookback
    frame = trailing(lookback)
    rows = rows.withColumns({"FractalRes": F.when(F.count("__h").over(frame) >= need, F.max("__h").over(frame)), "FractalSup": F.when(F.count("__l").over(frame) >= need, F.min("__l").over(frame))})
    rows = rows.withColumns({"FractalBreakout": flag(F.col("close") > before("FractalRes")), "FractalBreakdown": flag(F.col("close") < before("FractalSup")), "__rn": F.row_number().over(by_symbol())})
    earlier = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    gap = {f"__g{s}": F.when(F.col(f"__f{s}") == 1, F.col("__rn") - F.max(F.when(F.col(f"__f{s}") == 1, F.col("__rn"))).over(earlier)) for s in "hl"}
    rows = rows.withColumns(gap)
    both = full(F.avg("__gh").over(trailing(w)), "__gh", trailing(w), w) + full(F.avg("__gl").over(trailing(w)), "__gl", trailing(w), w)
    return rows.withColumn("FractalCompression", F.coalesce(both, F.lit(0.0))).drop("__fh", "__fl", "__h", "__l", "__rn", "__gh", "__gl")


STEPS = (swings, support_resistance, position_in_range, ranges, session_range, candles, breakouts, traps, compression, imbalance, impulse, rejection, structure_regime, fractals)


def add_structure(bars: DataFrame) -> DataFrame:
    for step in STEPS:
        bars = bars.transform(step)
    return bars
