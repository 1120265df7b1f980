"""Running sums over one long order without a window that puts all rows into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 64


def cut_points(df: DataFrame, on: str, bins: int = BINS) -> list:
    """At most ``bins`` - 1 values that cut ``on`` into bins of about equal counts; read once, so every use sees the same."""
    found = df.agg(F.percentile_approx(on, [i / bins for i in range(1, bins)], 10_000).alias("e")).first()["e"]
    return sorted(set(found or []))


def running_sums(df: DataFrame, on: str, sums: dict[str, Column], by: tuple[str, ...] = (), descending: bool = False, here: bool = True, bin_of: Column | None = None) -> DataFrame:
    """``df`` with sums over the rows of its group up to each one in the order of ``on`` (without that one, if not ``here``).

    Values of ``on`` are cut into bins. A window runs inside each (group, bin), and the sums
    of earlier bins, one row a (group, bin), are added to it: the largest task is a bin, not
    the group. ``bin_of`` gives the bins where the caller knows the spread of the values; it
    must not fall where ``on`` rises. Where values of ``on`` are equal within a group, their order is open.
    """
    if bin_of is None:
        edges = cut_points(df, on)
        bin_of = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(on))) if edges else F.lit(0)
    rows = df.withColumn("__bin", (-bin_of if descending else bin_of).cast("long")).withColumns({f"__v_{n}": c for n, c in sums.items()})
    inside = Window.partitionBy(*by, "__bin").orderBy(F.desc(on) if descending else F.col(on)).rowsBetween(Window.unboundedPreceding, 0 if here else -1)
    before = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "__bin").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    keys = [*by, "__bin"]
    carried = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums])
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    out = rows.withColumns({f"__i_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in sums}).join(carried, met)
    return out.select(*df.columns, *[(F.col(f"__i_{n}") + F.col(f"__c_{n}")).alias(n) for n in sums])


def unit_bins(x: Column, bins: int = 4096) -> Column:
    """Bins of equal width for values from 0 to 1, such as probabilities; what lies beyond goes to the first or last one."""
    return F.floor(F.greatest(F.least(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) * bins)
