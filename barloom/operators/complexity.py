"""Complexity scalars of a series: Hurst, Higuchi, DFA, entropies, neighbour distance.

Hurst, Higuchi and DFA are window and group aggregates. The entropies count near pairs of a
series' embedded points by a join on grid cells, so that only points of neighbouring cells meet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import before, by_symbol, row_id, trailing


def _line(x: Column, y: Column) -> Column:
    return F.regr_slope(y, x)


def hurst(bars: DataFrame, least: int = 10, most: int = 200, steps: int = 20) -> DataFrame:
    """Slope of log mean rolling range over deviation of log returns against log window; NULL under ``most`` returns."""
    sizes = [int(v) for v in np.logspace(np.log10(least), np.log10(most), num=steps)]
    rows = bars.withColumn("__r", F.log(F.try_divide(F.col("close"), before("close")))).where("__r is not null")
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))

    def ratio(w: int) -> Column:
        f = trailing(w)
        return F.when(F.count("__r").over(f) == w, (F.max("__r").over(f) - F.min("__r").over(f)) / (F.stddev_samp("__r").over(f) + 1e-10))

    unique = sorted(set(sizes))
    means = rows.withColumns({f"__w{w}": ratio(w) for w in unique}).groupBy("symbol").agg(F.first("__n").alias("n"), *[F.avg(f"__w{w}").alias(f"w{w}") for w in unique])
    long = means.select("symbol", "n", F.explode(F.array(*[F.struct(F.lit(float(w)).alias("w"), F.col(f"w{w}").alias("t")) for w in sizes])).alias("x")).where("x.w < n and x.t is not null")
    slope = _line(F.log(F.col("x.w") + 1e-10), F.log(F.col("x.t") + 1e-10))
    return long.groupBy("symbol").agg(F.when(F.first("n") >= most, slope).alias("Hurst"))


def higuchi(bars: DataFrame, k_most: int = 10) -> DataFrame:
    """1 less the slope of log curve length against log 1/k, the k-th length from steps of k bars."""
    rows = bars.withColumns({"__i": row_id(), "__n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    rows = rows.withColumns({f"__d{k}": F.abs(F.col("close") - before("close", k)) for k in range(1, k_most + 1)})
    long = rows.select("symbol", "__n", "__i", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__d{k}").alias("d")) for k in range(1, k_most + 1)])).alias("x")).where("x.d is not null")
    each = long.groupBy("symbol", "x.k", F.pmod("__i", F.col("x.k")).alias("m")).agg((F.sum("x.d") * (F.first("__n") - 1) / (F.count("*") * F.first("x.k"))).alias("l"))
    lengths = each.groupBy("symbol", "k").agg((F.sum("l") / F.first("k")).alias("l"))
    return lengths.groupBy("symbol").agg((1 - _line(F.log(1 / F.col("k")), F.log(F.col("l") + 1e-10))).alias("FracDim"))


def dfa(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    """Slope of log mean detrended deviation of segments against log size; the last segment, whole or not, is left out."""
    g = Window.partitionBy("symbol")
    rows = bars.withColumns({"__i": row_id(), "__n": F.count(F.lit(1)).over(g), "__c": F.col("close") - F.avg("close").over(g)})
    rows = rows.withColumn("__y", F.sum("__c").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    long = rows.select("symbol", "__i", "__n", "__y", F.explode(F.array(*[F.lit(w) for w in windows])).alias("w")).where(F.col("w") < F.col("__n"))
    long = long.withColumn("s", F.floor(F.col("__i") / F.col("w"))).where(F.col("s") * F.col("w") < F.col("__n") - F.col("w"))
    # mean squared residual of the line = population variance * (1 - r2)
    each = long.groupBy("symbol", "w", "s").agg(F.sqrt(F.greatest(F.var_pop("__y") * (1 - F.coalesce(F.regr_r2("__y", "__i"), F.lit(1.0))), F.lit(0.0))).alias("f"))
    means = each.groupBy("symbol", "w").agg(F.avg("f").alias("f"))
    return means.groupBy("symbol").agg(_line(F.log(F.col("w") + 1e-10), F.log(F.col("f") + 1e-10)).alias("DFA"))


def embedded(bars: DataFrame) -> DataFrame:
    """(symbol, i, n, x0, x1, x2): each close with the next two, its place and the series' length."""
    rows = bars.select("symbol", "ts", F.col("close").cast("double").alias("x0"), row_id().cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"))
    return rows.withColumns({"x1": F.lead("x0").over(by_symbol()), "x2": F.lead("x0", 2).over(by_symbol())}).drop("ts")


def near_counts(points: DataFrame, r: float = 0.2) -> DataFrame:
    """For each point of dimension 2: how many lie within r in every coordinate (``k2``), also in the third one (``k3``), itself included.

    A grid join: cells a shade wider than r, every point is met with the points of its own and the
    eight cells around it. ``s2`` and ``s3`` leave out the series' last points, as the sample entropy does.
    """
    side = r * (1 + 1e-9)  # so that rounding never parts two points by more than one cell
    placed = points.where("x1 is not null").withColumns({f"c{j}": F.floor(F.col(f"x{j}") / side) for j in (0, 1)})
    steps = [F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    asks = placed.select("symbol", "i", "n", *[F.col(f"x{j}").alias(f"p{j}") for j in range(3)], "c0", "c1", F.explode(F.array(*steps)).alias("d"))
    asks = asks.withColumns({"c0": F.col("c0") + F.col("d.a"), "c1": F.col("c1") + F.col("d.b")}).drop("d")
    found = asks.join(placed.select("symbol", "c0", "c1", F.col("i").alias("j"), "x0", "x1", "x2"), ["symbol", "c0", "c1"])
    found = found.where((F.abs(F.col("p0") - F.col("x0")) <= r) & (F.abs(F.col("p1") - F.col("x1")) <= r))
    third = F.abs(F.col("p2") - F.col("x2")) <= r
    early = lambda m: (F.col("i") < F.col("n") - m) & (F.col("j") < F.col("n") - m)
    return found.groupBy("symbol", "i", "n").agg(F.count("*").alias("k2"), F.count_if(third).alias("k3"), F.count_if(early(2)).alias("s2"), F.count_if(third & early(3)).alias("s3"))


def entropies(points: DataFrame, r: float = 0.2) -> DataFrame:
    """(symbol, ApEn, SampEn) of dimension 2; NULL for series of four values or fewer."""
    counts = near_counts(points, r)
    n2, n3 = F.first("n") - 1, F.first("n") - 2

    def phi(k: str, m: int, n: Column) -> Column:
        """Sum of log shares over the first n points of dimension m, over n."""
        return F.sum(F.when(F.col("i") <= F.col("n") - m, F.log(F.col(k) / (F.col("n") - (m - 1)) + 1e-10))) / n

    pairs = {m: F.sum(f"s{m}") - (F.first("n") - m) for m in (2, 3)}
    sample = -F.log((pairs[3] + 1e-10) / (pairs[2] + 1e-10))
    enough = F.first("n") > 4
    return counts.groupBy("symbol").agg(F.when(enough, phi("k2", 2, n2) - phi("k3", 3, n3)).alias("ApEn"), F.when(enough, sample).alias("SampEn"))


def neighbour_distance(points: DataFrame, window: int = 200) -> DataFrame:
    """(symbol, Lyap): mean log distance from each of the first ``window`` points of dimension 2 to its nearest other point, over the window.

    Those few points go to all points of their series as one array; the least distances are kept
    where the rows lie before they are shuffled. NULL for series of under ``window`` + 2 values.
    """
    there = points.where("x1 is not null")
    asks = there.where(F.col("i") < window).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("i", "x0", "x1"))).alias("q"))
    each = there.join(asks, "symbol").select("symbol", "i", "n", "x0", "x1", F.explode("q").alias("q")).where(F.col("i") != F.col("q.i"))
    apart = F.sqrt((F.col("x0") - F.col("q.x0")) ** 2 + (F.col("x1") - F.col("q.x1")) ** 2)
    least = each.groupBy("symbol", F.col("q.i").alias("k")).agg(F.min(apart).alias("d"), F.first("n").alias("n"))
    return least.groupBy("symbol").agg(F.when(F.first("n") >= window + 2, F.avg(F.log(F.col("d") + 1e-10)) / window).alias("Lyap"))


def pair_scalars(bars: DataFrame, r: float = 0.2) -> DataFrame:
    """(symbol, ApEn, SampEn, Lyap)."""
    points = embedded(bars)
    every = points.select("symbol").distinct()
    return every.join(entropies(points, r), "symbol", "left").join(neighbour_distance(points), "symbol", "left")


def scalars(bars: DataFrame) -> DataFrame:
    """One row a symbol with all six."""
    out = hurst(bars)
    for other in (higuchi(bars), dfa(bars), pair_scalars(bars)):
        out = out.join(other, "symbol", "full")
    return out


def add_complexity(bars: DataFrame) -> DataFrame:
    """The scalars on every row of their symbol; one small row a symbol is joined."""
    return bars.join(scalars(bars), "symbol", "left")


