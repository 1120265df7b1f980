"""Joins that Spark has no operator for: as-of, and intervals, both without pairwise comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: tuple[str, ...], on: str, values: tuple[str, ...], tie: str | None = None, exact: bool = True) -> DataFrame:
    """Each left row with the right row of the same key that is latest at or before its time (before it, if not ``exact``).

    Both sides go into one ordered window, so a key's rows are sorted once and nothing is
    compared pairwise. ``tie`` orders right rows of one time; the last wins. Left rows
    without a match have NULLs.
    """
    columns = [c for c in left.columns if c not in (*by, on)]
    kept, looked = F.struct(*columns, F.lit(True).alias("__any")), F.struct(*values)
    left_type, right_type = left.select(kept.alias("s")).schema["s"].dataType, right.select(looked.alias("s")).schema["s"].dataType
    none = F.lit(None).cast("long")
    a = left.select(*by, on, F.lit(1 if exact else 0).alias("__side"), none.alias("__tie"), kept.alias("__l"), F.lit(None).cast(right_type).alias("__r"))
    b = right.select(*by, on, F.lit(0 if exact else 1).alias("__side"), (F.col(tie).cast("long") if tie else none).alias("__tie"), F.lit(None).cast(left_type).alias("__l"), looked.alias("__r"))
    both = a.union(b)
    order = Window.partitionBy(*by).orderBy(on, "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__last", F.last("__r", True).over(order)).where("__l is not null")
    return seen.select(*by, on, *[F.col(f"__l.{c}").alias(c) for c in columns], *[F.col(f"__last.{v}").alias(v) for v in values])


def first_from(rows: DataFrame, by: tuple[str, ...], at: Column, target: Column, value: Column, name: str) -> DataFrame:
    """``rows`` with the smallest ``value`` among the earliest rows of their key whose ``at`` is ``target`` or later; NULL if there are none.

    One descending window over both the rows and what they ask for: a frame that reaches to a
    key's end would be read anew for every row.
    """
    whole = rows.select(F.struct(*rows.columns).alias("s")).schema["s"].dataType
    points = rows.select(*by, at.alias("__t"), F.lit(0).alias("__side"), value.alias("__v"), F.lit(None).cast(whole).alias("__row"))
    asks = rows.select(*by, target.alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(points.schema["__v"].dataType).alias("__v"), F.struct(*rows.columns).alias("__row"))
    order = Window.partitionBy(*by).orderBy(F.desc("__t"), "__side", F.desc("__v")).rowsBetween(Window.unboundedPreceding, 0)
    seen = points.union(asks).withColumn(name, F.last("__v", True).over(order)).where("__row is not null")
    return seen.select("__row.*", F.when(F.col("__t").isNotNull(), F.col(name)).alias(name))


def interval_join(points: DataFrame, spans: DataFrame, by: tuple[str, ...], at: Column, start: Column, stop: Column, size: float) -> DataFrame:
    """Points inside closed spans of the same key: spans are listed under every bin of ``size`` they touch, points under theirs, then an equi-join."""
    p = points.withColumn("__at", at).withColumn("__bin", F.floor(F.col("__at") / size))
    s = spans.withColumns({"__a": start, "__b": stop}).where("__a <= __b")
    s = s.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__a") / size), F.floor(F.col("__b") / size))))
    return p.join(s, [*by, "__bin"]).where(F.col("__at").between(F.col("__a"), F.col("__b"))).drop("__at", "__bin", "__a", "__b")


def outer_concat(frames: list[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """Columns of several tables side by side on the union of their keys."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, list(keys), "full")
    return out


def sampled(rows: DataFrame, key: str, share: float) -> DataFrame:
    """About ``share`` of all integer keys (0 or more), by a multiplicative hash: the same rows however the table is partitioned, and on every rerun."""
    return rows.where((F.col(key).cast("decimal(38,0)") * F.lit(2654435761)) % F.lit(1 << 32) < int(share * (1 << 32)))
