"""Timeframe settings: bars a day and scale decide horizons, windows, folds and model sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: bars a trading day and scale relative to an hour
TIMEFRAMES = {
    "1T": (50000, 0.0001), "10T": (5000, 0.001), "100T": (500, 0.01), "1000T": (50, 0.1),
    "1S": (25200, 0.0003), "5S": (5040, 0.0014), "10S": (2520, 0.003), "15S": (1680, 0.004), "30S": (840, 0.008), "45S": (560, 0.013),
    "1M": (420, 0.017), "2M": (210, 0.033), "3M": (140, 0.05), "5M": (84, 0.083), "10M": (42, 0.17), "15M": (28, 0.25), "30M": (14, 0.5), "45M": (9.3, 0.75),
    "1H": (7, 1.0), "2H": (3.5, 2.0), "3H": (2.3, 3.0), "4H": (1.75, 4.0),
    "1D": (1, 7.0), "1W": (0.2, 35.0), "1MO": (0.05, 140.0), "3MO": (0.016, 420.0), "6MO": (0.008, 840.0), "12MO": (0.004, 1680.0),
    "1R": (1000, 0.007), "10R": (100, 0.07), "100R": (10, 0.7), "1000R": (1, 7.0),
}
#: train and test days of the walk-forward regimes
WALKS = {"reversion": (21, 5), "balanced": (63, 10), "momentum": (126, 21)}


@dataclass(frozen=True)
class Timeframe:
    name: str
    bars_per_day: float
    scale: float

    @property
    def horizons(self) -> list[int]:
        return sorted({min(500, max(1, int(h / self.scale))) for h in (5, 10, 20, 50, 100)})[:5]

    @property
    def vol_window(self) -> int:
        return max(5, min(200, int(50 / self.scale)))

    @property
    def rolling_windows(self) -> list[int]:
        return sorted({max(3, int(w / self.scale)) for w in (10, 20, 50, 100)})[:4]

    @property
    def day_bars(self) -> int:
        """Bars of a vertical barrier and of an embargo: one day, one bar at least."""
        return max(1, int(self.bars_per_day))

    @property
    def folds(self) -> int:
        return 3 if self.bars_per_day < 1 else 4 if self.bars_per_day < 10 else 5

    @property
    def forest(self) -> tuple[int, int, int]:
        """Trees, depth, least rows in a leaf."""
        return (50, 3, 10) if self.scale > 10 else (100, 4, 5) if self.scale > 1 else (200, 6, 3)

    @property
    def bars_needed(self) -> tuple[int, int]:
        """At least, and ideally."""
        return max(200, int(500 / self.scale)), max(1000, int(2000 / self.scale))

    def walk(self, regime: str | None = None) -> tuple[int, int, int]:
        """Train, test and step bars of a walk-forward regime; 63 and 5 days without one."""
        train, test = WALKS[regime] if regime else (63, 5)
        return int(self.bars_per_day * train), int(self.bars_per_day * test), int(self.bars_per_day * test)


def timeframe(name: str) -> Timeframe:
    if name not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {name}; known: {', '.join(TIMEFRAMES)}")
    return Timeframe(name, *TIMEFRAMES[name])


UNITS = {"S": 1, "M": 60, "H": 3600, "D": 86_400, "W": 604_800}


def seconds_of(name: str) -> int | None:
    """Length of a timeframe's bars; None for months and for bars that aren't made by the clock."""
    return int(name[:-1]) * UNITS[name[-1]] if name[:-1].isdigit() and name[-1] in UNITS else None


def interval_of(bars: DataFrame) -> DataFrame:
    """(symbol, seconds, n_bars): the commonest gap between bars of each series, the shorter one on a tie."""
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts")).cast("timestamp"))
    gaps = bars.select("symbol", (gap / 1_000_000).cast("long").alias("seconds")).groupBy("symbol", "seconds").agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("seconds").isNotNull(), F.struct((-F.col("n")).alias("n"), "seconds")))
    return gaps.groupBy("symbol").agg(best["seconds"].alias("seconds"), F.sum("n").alias("n_bars"))


def settings_of(bars: DataFrame) -> DataFrame:
    """The timeframe each series is in, by its own interval, with that timeframe's settings and whether its bars are enough."""
    rows = []
    for name in TIMEFRAMES:
        f = timeframe(name)
        if seconds_of(name):
            rows.append((seconds_of(name), name, ",".join(map(str, f.horizons)), ",".join(map(str, f.rolling_windows)), f.vol_window, f.day_bars, f.folds, *f.forest, *f.bars_needed, *f.walk("balanced")[:2]))
    table = bars.sparkSession.createDataFrame(rows, "seconds long, name string, horizons string, windows string, vol_window long, day_bars long, folds long, trees long, depth long, leaf long, least long, ideal long, train long, test long")
    return interval_of(bars).join(F.broadcast(table), "seconds", "left").withColumn("enough", F.col("n_bars") >= F.col("least"))
