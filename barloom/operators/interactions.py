"""How one feature's contribution depends on another feature's value, for all ordered pairs in one pass.

Every task multiplies matrices of its rows: contributions by values (regression), and contributions and
their squares, plain and absolute, by the marks of the lowest and highest quarter of each value. A task hands
on these sums, a row for each feature; nothing is read again for a pair. Sums are taken around
the series' means, which come with the quarter edges from one aggregate before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMS = ("n", "sx", "s", "x", "ss", "xx", "nl", "nh", "l", "h", "ll", "hh", "al", "ah")


def pair_effects(rows: DataFrame, features: list[str], values: dict[str, str], by: str | None = None, least: int = 20, least_quarter: int = 5) -> DataFrame:
    """(by, x, given, n, beta, beta_std, r2, diff, cohens_d, diff_abs, cohens_d_abs, mean_low, mean_high) for each ordered pair.

    ``values`` names each feature's contribution column. beta is the slope of x's contribution on ``given``, standardised;
    the others compare x's contribution where ``given`` is in its highest and its lowest quarter (of the group ``by``). Rows
    with a missing value are left out; pairs of under ``least`` rows or quarters of under ``least_quarter`` have effects of 0.
    """
    group = F.col(by).cast("string") if by else F.lit("")
    ready = rows.select(group.alias("g"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], *[F.col(values[f]).cast("double").alias(f"s{i}") for i, f in enumerate(features)])
    ready = ready.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ready.columns if c != "g"))
    k = len(features)
    stats = ready.groupBy("g").agg(*[x for i in range(k) for x in (F.percentile(f"x{i}", [0.25, 0.75]).alias(f"q{i}"), F.avg(f"x{i}").alias(f"m{i}"), F.avg(f"s{i}").alias(f"c{i}"))])
    centre = {r.g: tuple(np.array(v, float) for v in ([r[f"q{i}"][0] for i in range(k)], [r[f"q{i}"][1] for i in range(k)], [r[f"m{i}"] for i in range(k)], [r[f"c{i}"] for i in range(k)])) for r in stats.collect()}  # a row a group
    lists = [f"{n} array<double>" for n in SUMS[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            both = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            for g in set(names):
                own = both[np.array([n == g for n in names])]
                low, high, mean, middle = centre[g]
                x, s = own[:, :k], own[:, k:]
                lo, hi = (x <= low).astype(float), (x >= high).astype(float)
                a, x, s = np.abs(s), x - mean, s - middle
                ones = np.ones((k, 1))
                sums = [s.T @ x, s.sum(0)[:, None] * ones.T, ones * x.sum(0), (s * s).sum(0)[:, None] * ones.T, ones * (x * x).sum(0), ones * lo.sum(0), ones * hi.sum(0), s.T @ lo, s.T @ hi, (s * s).T @ lo, (s * s).T @ hi, a.T @ lo, a.T @ hi]
                sums = [np.full((k, k), float(len(own))), *sums]
                held[g] = [m + n for m, n in zip(held[g], sums, strict=True)] if g in held else sums
        for g, sums in held.items():
            columns = [pa.array(list(m), pa.list_(pa.float64())) for m in sums]
            yield pa.record_batch([pa.array([g] * k), pa.array(np.arange(k, dtype=np.int32)), *columns], names=["g", "a", *SUMS])

    parts = ready.mapInArrow(run, "g string, a int, n array<double>, " + ", ".join(lists))
    long = parts.select("g", "a", F.posexplode(F.arrays_zip(*SUMS)).alias("b", "z")).where("a <> b")
    sums = long.groupBy("g", "a", "b").agg(*[F.sum(f"z.{n}").alias(n) for n in SUMS])
    names = F.array(*[F.lit(f) for f in features])
    offsets = F.create_map(*[x for g, (_, _, _, c) in centre.items() for x in (F.lit(g), F.array(*[F.lit(float(v)) for v in c]))]) if centre else F.lit(None).cast("map<string, array<double>>")
    out = sums.withColumns({"c": F.get(F.try_element_at(offsets, F.col("g")), F.col("a")), "x_": F.get(names, F.col("a")), "given": F.get(names, F.col("b"))})
    sxy, sxx, syy = (F.col(p) - F.col(q) * F.col(r) / F.col("n") for p, q, r in (("sx", "s", "x"), ("xx", "x", "x"), ("ss", "s", "s")))
    sd_x, sd_y = F.sqrt(F.greatest(sxx, F.lit(0.0)) / F.col("n")), F.sqrt(F.greatest(syy, F.lit(0.0)) / F.col("n"))
    beta = F.coalesce(F.try_divide(sxy, sxx), F.lit(0.0)) * (sd_x + 1e-10)
    enough = (F.col("n") >= least) & (F.col("nl") >= least_quarter) & (F.col("nh") >= least_quarter)
    low, high = F.col("l") / F.col("nl"), F.col("h") / F.col("nh")

    def squares(q: str, s: str, n: str) -> Column:
        return F.greatest(F.col(q) - F.col(s) ** 2 / F.col(n), F.lit(0.0))

    # squares of absolute contributions are those of the plain ones around 0
    def plain_squares(q: str, s: str, n: str) -> Column:
        return F.col(q) + 2 * F.col("c") * F.col(s) + F.col("c") ** 2 * F.col(n)

    def absolute(q: str, s: str, a: str, n: str) -> Column:
        return F.greatest(plain_squares(q, s, n) - F.col(a) ** 2 / F.col(n), F.lit(0.0))

    def effect(apart: Column, both: Column) -> Column:
        return F.when(enough, F.coalesce(F.try_divide(apart, F.sqrt(both / (F.col("nl") + F.col("nh") - 2))), F.lit(0.0))).otherwise(0.0)

    apart_abs = F.col("ah") / F.col("nh") - F.col("al") / F.col("nl")
    found = out.select(
        *([F.col("g").cast(_kind(rows, by)).alias(by)] if by else []), F.col("x_").alias("x"), "given", F.col("n").cast("long").alias("n"), beta.alias("beta"), (beta / (sd_y + 1e-10)).alias("beta_std"),
        F.coalesce(F.try_divide(sxy * sxy, sxx * syy), F.lit(0.0)).alias("r2"), F.when(enough, high - low).otherwise(0.0).alias("diff"), effect(high - low, squares("ll", "l", "nl") + squares("hh", "h", "nh")).alias("cohens_d"),
        F.when(enough, apart_abs).otherwise(0.0).alias("diff_abs"), effect(apart_abs, absolute("ll", "l", "al", "nl") + absolute("hh", "h", "ah", "nh")).alias("cohens_d_abs"),
        F.when(enough, low + F.col("c")).otherwise(0.0).alias("mean_low"), F.when(enough, high + F.col("c")).otherwise(0.0).alias("mean_high"),
    )
    return found


def _kind(rows: DataFrame, column: str) -> T.DataType:
    return rows.schema[column].dataType


def strongest(rows: DataFrame, features: list[str], values: dict[str, str], top: int) -> list[str]:
    """The ``top`` features by mean absolute contribution."""
    means = rows.agg(*[F.avg(F.abs(values[f])).alias(str(i)) for i, f in enumerate(features)]).first()
    return [features[i] for i in sorted(range(len(features)), key=lambda i: (-(means[i] or 0.0), i))[:top]]


def combined(rows: DataFrame, features: list[str], values: dict[str, str], top: int = 25) -> DataFrame:
    """Effects of all ordered pairs of the ``top`` features, read: x counts MORE or LESS where ``given`` is high, and how strongly."""
    d = F.abs("cohens_d")
    strength = F.when(d > 0.5, "strong").when(d > 0.2, "moderate").otherwise("weak")
    found = pair_effects(rows, strongest(rows, features, values, top), values)
    return found.withColumns({"direction": F.when(F.col("diff") > 0, "MORE").otherwise("LESS"), "strength": strength, "abs_cohens_d": d})


def consistency(rows: DataFrame, features: list[str], values: dict[str, str], split: str, top: int = 25) -> DataFrame:
    """(x, given, mean_d, std_d, mean_r2, same_sign, n_splits): each pair's effects in every split, and the share of splits with the mean's sign."""
    each = pair_effects(rows, strongest(rows, features, values, top), values, split)
    sums = each.groupBy("x", "given").agg(F.avg("cohens_d").alias("mean_d"), F.stddev_samp("cohens_d").alias("std_d"), F.avg("r2").alias("mean_r2"), F.collect_list("cohens_d").alias("d"))  # an entry a split
    same = F.size(F.filter("d", lambda v: F.signum(v) == F.signum(F.col("mean_d"))))
    return sums.select("x", "given", "mean_d", "std_d", "mean_r2", (same / F.size("d")).alias("same_sign"), F.size("d").alias("n_splits"))


def summary(effects: DataFrame) -> DataFrame:
    """Counts of strong and moderate pairs, and the largest effects."""
    d = F.abs("cohens_d")
    return effects.agg(F.count("*").alias("n_pairs"), F.count_if(d > 0.5).alias("n_strong"), F.count_if((d > 0.2) & (d <= 0.5)).alias("n_moderate"), F.max("r2").alias("max_r2"), F.max(d).alias("max_d"))
