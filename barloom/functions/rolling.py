"""Window helpers over (symbol, ts): frames, and aggregates that wait for a full frame.

Missing is NULL throughout. A trailing aggregate over ``w`` rows is NULL unless all ``w``
values are there, as rolling statistics have it. Frames with the same partition and order
end up in one Window node, so a panel of statistics costs one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-10


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by_symbol(*more: str) -> WindowSpec:
    return Window.partitionBy("symbol", *more).orderBy("ts")


def trailing(w: int, *more: str) -> WindowSpec:
    """The current row and the w - 1 before it."""
    return by_symbol(*more).rowsBetween(-(w - 1), 0)


def prior(w: int) -> WindowSpec:
    """The w rows before the current one."""
    return by_symbol().rowsBetween(-w, -1)


def centred(k: int) -> WindowSpec:
    return by_symbol().rowsBetween(-k, k)


def running() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    """All rows of the symbol: a whole-sample statistic, which sees the future."""
    return Window.partitionBy("symbol")


def full(value: Column, x: Column | str, frame: WindowSpec, w: int) -> Column:
    """``value`` where the frame holds w non-null x."""
    return F.when(F.count(col(x)).over(frame) == w, value)


def rolled(fn: Callable[[Column], Column], x: Column | str, w: int, *more: str) -> Column:
    frame = trailing(w, *more)
    return full(fn(col(x)).over(frame), x, frame, w)


def mean(x: Column | str, w: int, *more: str) -> Column:
    return rolled(F.avg, x, w, *more)


def total(x: Column | str, w: int) -> Column:
    return rolled(F.sum, x, w)


def std(x: Column | str, w: int) -> Column:
    return rolled(F.stddev_samp, x, w)


def std_pop(x: Column | str, w: int) -> Column:
    return rolled(F.stddev_pop, x, w)


def var(x: Column | str, w: int) -> Column:
    return rolled(F.var_samp, x, w)


def high(x: Column | str, w: int) -> Column:
    return rolled(F.max, x, w)


def low(x: Column | str, w: int) -> Column:
    return rolled(F.min, x, w)


def median(x: Column | str, w: int) -> Column:
    return rolled(lambda c: F.percentile(c, F.lit(0.5)), x, w)


def before(x: Column | str, n: int = 1) -> Column:
    return F.lag(col(x), n).over(by_symbol())


def after(x: Column | str, n: int = 1) -> Column:
    return F.lead(col(x), n).over(by_symbol())


def change(x: Column | str) -> Column:
    return col(x) - before(x)


def row_id() -> Column:
    """Place in the series, from 0."""
    return F.row_number().over(by_symbol()) - 1


def flag(condition: Column) -> Column:
    """1 where the condition holds; unknown counts as no."""
    return F.when(condition, 1).otherwise(0)


def skew_adjusted(skewness: Column, n: Column) -> Column:
    """Population skewness to the bias-corrected one."""
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * skewness)


def kurtosis_adjusted(excess: Column, n: Column) -> Column:
    """Population excess kurtosis to the bias-corrected one."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6))


def run_start(x: Column | str) -> Column:
    """1 on the first row of each run of equal values; null and value differ, null and null don't."""
    first = F.row_number().over(by_symbol()) == 1
    return flag(first | ~col(x).eqNullSafe(before(x)))


def average_rank(x: Column, window: WindowSpec, ties: WindowSpec) -> Column:
    """Rank with ties sharing their mean; ``ties`` partitions by the value too."""
    return F.rank().over(window) + (F.count(F.lit(1)).over(ties) - 1) / 2


def count_equal(values: Column, value: float) -> Column:
    """How many elements of an array equal ``value``."""
    return F.size(F.filter(values, lambda v: v == value))
