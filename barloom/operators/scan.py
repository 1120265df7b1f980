"""Recurrences (EMA family, KAMA, RSI, TRIX, TSI, EWMA, debiased ewm std), one pass a symbol.

A window function can't use its own last output, so a symbol's series goes through one
grouped-map call that computes every recurrence a query asks for. ``chained`` is the form
for very long series: all of these but the debiased deviation are linear in what came
before, so chunks run on their own and only their ends are chained (``long_recurrences``);
the deviation's moments merge in the same way (``moments_chained``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rolling import EPS, by_symbol


def ema(x: np.ndarray, span: float) -> np.ndarray:
    """Seeded with the first value; a = 2 / (span + 1)."""
    a = 2.0 / (span + 1)
    out = np.empty(len(x))
    last = np.nan
    for i, v in enumerate(x):
        last = v if i == 0 else a * v + (1 - a) * last
        out[i] = last
    return out


def tema(x: np.ndarray, span: float) -> np.ndarray:
    one = ema(x, span)
    two = ema(one, span)
    return 3 * one - 3 * two + ema(two, span)


def kama(x: np.ndarray, w: int, fast: int = 2, slow: int = 30) -> np.ndarray:
    """Adaptive average: null before w, the price at w, then steps that the efficiency ratio blends between two squared constants."""
    out = np.full(len(x), np.nan)
    if len(x) <= w:
        return out
    quick, calm = (2.0 / (fast + 1)) ** 2, (2.0 / (slow + 1)) ** 2
    step = np.concatenate(([0.0], np.abs(np.diff(x))))
    path = np.cumsum(step)
    out[w] = x[w]
    for i in range(w + 1, len(x)):
        moved = path[i] - path[i - w]
        ratio = abs(x[i] - x[i - w]) / moved if moved > 0 else 0.0
        out[i] = out[i - 1] + (calm + ratio * (quick - calm)) * (x[i] - out[i - 1])
    return out


def rsi(x: np.ndarray, w: int) -> np.ndarray:
    """Wilder's: seeded at index w with the mean of the first w gains and losses."""
    out = np.full(len(x), np.nan)
    if len(x) <= w:
        return out
    d = np.diff(x)
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    gain, loss = up[:w].mean(), down[:w].mean()
    out[w] = 100 - 100 / (1 + gain / (loss + EPS))
    for i in range(w + 1, len(x)):
        gain = (gain * (w - 1) + up[i - 1]) / w
        loss = (loss * (w - 1) + down[i - 1]) / w
        out[i] = 100 - 100 / (1 + gain / (loss + EPS))
    return out


def trix(x: np.ndarray, w: int) -> np.ndarray:
    three = ema(ema(ema(x, w), w), w)
    out = np.full(len(x), np.nan)
    out[1:] = 100 * (three[1:] - three[:-1]) / (three[1:] + EPS)
    return out


def tsi(x: np.ndarray, slow: int = 25, fast: int = 13) -> np.ndarray:
    """From the first difference on; the first row is null."""
    out, d = np.full(len(x), np.nan), np.diff(x)
    out[1:] = 100 * ema(ema(d, slow), fast) / (ema(ema(np.abs(d), slow), fast) + EPS)
    return out


def ewma_vol(x: np.ndarray, decay: float) -> np.ndarray:
    """Root of the decayed mean of squared returns; the first value is the first squared return."""
    out = np.empty(len(x))
    last = 0.0
    for i, v in enumerate(np.nan_to_num(x) ** 2):
        last = v if i == 0 else decay * last + (1 - decay) * v
        out[i] = last
    return np.sqrt(out)


def ewm_std(x: np.ndarray, span: float) -> np.ndarray:
    """Debiased exponentially weighted deviation of adjusted weights; nulls are skipped, two values are needed."""
    a = 2.0 / (span + 1)
    out = np.full(len(x), np.nan)
    w = w2 = m = s = 0.0
    seen = 0
    for i, v in enumerate(x):
        w, w2, s = w * (1 - a), w2 * (1 - a) ** 2, s * (1 - a)
        if np.isnan(v):
            if seen > 1:
                out[i] = out[i - 1]
            continue
        seen += 1
        w, w2 = w + 1, w2 + 1
        before = m
        m += (v - m) / w
        s += (v - before) * (v - m)
        if seen > 1 and w * w - w2 > 0:
            out[i] = np.sqrt(max(s / w * (w * w) / (w * w - w2), 0))
    return out


Recurrence = Callable[[np.ndarray], np.ndarray]


def scan(bars: DataFrame, columns: dict[str, tuple[str, Callable, dict]]) -> DataFrame:
    """Add columns: name -> (input column, recurrence, its arguments); all in one pass over each symbol."""
    schema = T.StructType(bars.schema.fields + [T.StructField(n, T.DoubleType()) for n in columns])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        out = {name: fn(frame[source].to_numpy(float, na_value=np.nan), **args) for name, (source, fn, args) in columns.items()}
        new = pd.DataFrame(out).astype(object)
        return pd.concat([frame, new.where(new.notna(), None)], axis=1)

    return bars.groupBy("symbol").applyInPandas(run, schema)


CHUNK = 100_000  # rows of a series that one task goes through
SPANS = (3, 5, 8, 10, 12, 20, 21, 34, 50, 89, 100, 144, 200)


def by_length(rows: DataFrame, short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame], chunk: int) -> DataFrame:
    """Series of up to ``chunk`` rows through ``short`` (a task each), longer ones through ``long`` (many tasks each); both give the same columns."""
    sizes = rows.groupBy("symbol").agg(F.count("*").alias("__n"))
    if not sizes.where(F.col("__n") > chunk).limit(1).count():
        return short(rows)
    marked, is_long = rows.join(sizes, "symbol"), F.col("__n") > chunk
    one = long(marked.where(is_long).drop("__n").select(*rows.columns))
    return one.unionByName(short(marked.where(~is_long).drop("__n").select(*rows.columns)).select(*one.columns))


def ema_panel(bars: DataFrame, spans: tuple[int, ...] = SPANS, chunk: int = CHUNK) -> DataFrame:
    def long(rows: DataFrame) -> DataFrame:
        return chained(in_order(rows), {f"EMA_{w}": ("close", 1 - 2.0 / (w + 1), 0) for w in spans}, chunk).drop("__rn")

    return by_length(bars, lambda rows: scan(rows, {f"EMA_{w}": ("close", ema, {"span": w}) for w in spans}), long, chunk)


def trend_recurrences(bars: DataFrame, spans: tuple[int, ...] = SPANS, chunk: int = CHUNK) -> DataFrame:
    """All recurrent trend columns: EMA, TEMA, KAMA, RSI, TRIX, TSI."""
    columns: dict[str, tuple[str, Callable, dict]] = {f"EMA_{w}": ("close", ema, {"span": w}) for w in spans}
    columns |= {f"TEMA_{w}": ("close", tema, {"span": w}) for w in spans}
    columns |= {f"KAMA_{w}": ("close", kama, {"w": w}) for w in spans}
    columns |= {f"RSI_{w}": ("close", rsi, {"w": w}) for w in (7, 14, 21)}
    columns |= {f"TRIX_{w}": ("close", trix, {"w": w}) for w in (15, 30)}
    columns["TSI"] = ("close", tsi, {})

    def long(rows: DataFrame) -> DataFrame:
        emas = ema_panel(rows, spans, chunk).select("symbol", "ts", *[f"EMA_{w}" for w in spans])
        others = long_recurrences(rows, chunk, spans, spans, (7, 14, 21), (15, 30), std_spans=())
        return others.join(emas, ["symbol", "ts"]).select(*rows.columns, *columns)

    return by_length(bars, lambda rows: scan(rows, columns), long, chunk)


def ewma_columns(rows: DataFrame, ret: str = "ret", decays: tuple[float, ...] = (0.94, 0.97, 0.99), chunk: int = CHUNK) -> DataFrame:
    def long(part: DataFrame) -> DataFrame:
        squared = in_order(part).withColumn("__v", F.coalesce(F.col(ret) * F.col(ret), F.lit(0.0)))
        done = chained(squared, {f"__e{i}": ("__v", d, 0) for i, d in enumerate(decays)}, chunk)
        return done.select(*part.columns, *[F.sqrt(f"__e{i}").alias(f"EWMA_{round(100 * d)}") for i, d in enumerate(decays)])

    return by_length(rows, lambda part: scan(part, {f"EWMA_{round(100 * d)}": (ret, ewma_vol, {"decay": d}) for d in decays}), long, chunk)


def chained(rows: DataFrame, columns: dict[str, tuple[str, float | str, int]], chunk: int = 100_000) -> DataFrame:
    """Add y(t) = k(t) y(t-1) + (1 - k(t)) x(t) on many tasks: name -> (x, k, start); null before row ``start``, x there.

    k is a number or a column. Needs ``__rn``, a row's number in its series. Each chunk runs
    from zero and notes how much of what came before is left at each row; chunk ends are
    then chained (one small row a chunk) and the carry added.
    """
    names = list(columns)
    numbered = rows.withColumn("__chunk", F.floor(F.col("__rn") / chunk).cast("long"))
    schema = T.StructType(numbered.schema.fields + [T.StructField(f"__{p}{i}", T.DoubleType()) for i in range(len(names)) for p in ("y", "k")])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__rn").reset_index(drop=True)
        place = frame["__rn"].to_numpy()
        out = {}
        for i, (source, keep, start) in enumerate(columns.values()):
            x = frame[source].to_numpy(float, na_value=np.nan)
            k = frame[keep].to_numpy(float, na_value=np.nan) if isinstance(keep, str) else np.full(len(x), keep)
            y, left = np.full(len(x), np.nan), np.zeros(len(x))
            last, fade = 0.0, 1.0
            for j in np.flatnonzero(place >= start).tolist():
                if place[j] == start:
                    last, fade = x[j], 0.0
                else:
                    last, fade = k[j] * last + (1 - k[j]) * x[j], fade * k[j]
                y[j], left[j] = last, fade
            out |= {f"__y{i}": y, f"__k{i}": left}
        new = pd.DataFrame(out).astype(object)
        return pd.concat([frame, new.where(new.notna(), None)], axis=1)

    parts = numbered.groupBy("symbol", "__chunk").applyInPandas(run, schema)
    ends = parts.groupBy("symbol", "__chunk").agg(*[F.max_by(f"__{p}{i}", "__rn").alias(f"__{p}{i}") for i in range(len(names)) for p in ("y", "k")])
    earlier = F.collect_list(F.struct(*[c for c in ends.columns if c not in ("symbol", "__chunk")])).over(Window.partitionBy("symbol").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))

    def carry(i: int) -> Column:
        return F.aggregate(earlier, F.lit(0.0), lambda acc, e: F.coalesce(e[f"__y{i}"], F.lit(0.0)) + acc * e[f"__k{i}"])

    carried = ends.select("symbol", "__chunk", *[carry(i).alias(f"__c{i}") for i in range(len(names))])
    whole = parts.join(carried, ["symbol", "__chunk"]).withColumns({n: F.col(f"__y{i}") + F.col(f"__c{i}") * F.col(f"__k{i}") for i, n in enumerate(names)})
    return whole.drop("__chunk", *[f"__{p}{i}" for i in range(len(names)) for p in "ykc"])


def moments_chained(rows: DataFrame, columns: dict[str, tuple[str, float]], chunk: int = 100_000) -> DataFrame:
    """Add debiased weighted deviations (``ewm_std``) on many tasks: name -> (x, span). Needs ``__rn``.

    The state is a weight, the sum of squared weights, a mean and a sum of squares; it fades with every row, and
    two stretches merge as weighted samples do. Each chunk adds its rows up from nothing, the
    chunks' ends are merged in order (one small row a chunk), and what entered a chunk is merged
    with each of its rows. A missing x fades both sides alike, which leaves the deviation as it was.
    """
    names, parts = list(columns), ("w", "v", "m", "s", "n")
    numbered = rows.withColumn("__chunk", F.floor(F.col("__rn") / chunk).cast("long"))
    fields = [T.StructField(f"__{p}{i}", T.DoubleType()) for i in range(len(names)) for p in parts]
    schema = T.StructType([*numbered.schema.fields, *fields])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__rn").reset_index(drop=True)
        out = {}
        for i, (source, span) in enumerate(columns.values()):
            keep, held = 1 - 2.0 / (span + 1), np.zeros((5, len(frame)))
            w = v = m = s = n = 0.0
            for j, x in enumerate(frame[source].to_numpy(float, na_value=np.nan).tolist()):
                w, v, s = w * keep, v * keep * keep, s * keep
                if x == x:
                    w, v, n = w + 1, v + 1, n + 1
                    old = m
                    m += (x - m) / w
                    s += (x - old) * (x - m)
                held[:, j] = w, v, m, s, n
            out |= {f"__{p}{i}": h for p, h in zip(parts, held, strict=True)}
        return pd.concat([frame, pd.DataFrame(out)], axis=1)

    each = numbered.groupBy("symbol", "__chunk").applyInPandas(run, schema)
    last = F.max_by(F.struct(F.col("__rn"), *[f.name for f in fields]), "__rn").alias("e")
    ends = each.groupBy("symbol", "__chunk").agg(last, F.count("*").cast("double").alias("rows"))

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        """What enters each chunk; a row a chunk."""
        frame = frame.sort_values("__chunk")
        state, out = np.zeros((len(names), 5)), []
        for end, n in zip(frame["e"], frame["rows"], strict=True):
            out.append(state.ravel().copy())
            for i, (_, span) in enumerate(columns.values()):
                state[i] = _merged(state[i], np.array([end[f"__{p}{i}"] for p in parts]), (1 - 2.0 / (span + 1)) ** n)
        return pd.concat([frame[["symbol", "__chunk"]].reset_index(drop=True), pd.DataFrame(np.array(out), columns=[f"__c{p}{i}" for i in range(len(names)) for p in parts])], axis=1)

    carried = ends.groupBy("symbol").applyInPandas(carry, "symbol string, __chunk long, " + ", ".join(f"__c{p}{i} double" for i in range(len(names)) for p in parts))
    whole = each.join(carried, ["symbol", "__chunk"])
    out = {}
    for i, (name, (_, span)) in enumerate(columns.items()):
        fade = F.pow(F.lit(1 - 2.0 / (span + 1)), F.pmod("__rn", F.lit(chunk)) + 1)
        cw, cv, cs = F.col(f"__cw{i}") * fade, F.col(f"__cv{i}") * fade * fade, F.col(f"__cs{i}") * fade
        w, v = cw + F.col(f"__w{i}"), cv + F.col(f"__v{i}")
        s = cs + F.col(f"__s{i}") + F.coalesce(F.try_divide(cw * F.col(f"__w{i}"), w), F.lit(0.0)) * (F.col(f"__m{i}") - F.col(f"__cm{i}")) ** 2
        out[name] = F.when((F.col(f"__cn{i}") + F.col(f"__n{i}") > 1) & (w * w - v > 0), F.sqrt(F.greatest(s / w * (w * w) / (w * w - v), F.lit(0.0))))
    return whole.withColumns(out).drop("__chunk", *[f.name for f in fields], *[f"__c{p}{i}" for i in range(len(names)) for p in parts])


def _merged(one: np.ndarray, two: np.ndarray, fade: float) -> np.ndarray:
    """(weight, squared weights, mean, squares, count) of a stretch after another, which has faded."""
    w, v, m, s, n = one
    w, v, s = w * fade, v * fade * fade, s * fade
    total = w + two[0]
    if total <= 0:
        return np.array([0.0, 0.0, m, 0.0, n + two[4]])
    return np.array([total, v + two[1], (w * m + two[0] * two[2]) / total, s + two[3] + w * two[0] / total * (two[2] - m) ** 2, n + two[4]])


def in_order(bars: DataFrame) -> DataFrame:
    return bars.withColumn("__rn", F.row_number().over(by_symbol()) - 1)


def ema_chunked(bars: DataFrame, span: int, chunk: int = 100_000, value: str = "close") -> DataFrame:
    """EMA of long series."""
    return chained(in_order(bars), {f"EMA_{span}": (value, 1 - 2.0 / (span + 1), 0)}, chunk).drop("__rn")


def long_recurrences(bars: DataFrame, chunk: int = 100_000, spans: tuple[int, ...] = (20,), kama_windows: tuple[int, ...] = (20,), rsi_windows: tuple[int, ...] = (14,), trix_spans: tuple[int, ...] = (15,), decay: float = 0.94, std_spans: tuple[int, ...] = (100,)) -> DataFrame:
    """TEMA, KAMA, RSI, TRIX, TSI, EWMA volatility and the debiased deviation of returns of long series; all recurrences of one depth share a pass."""
    move = F.col("close") - F.lag("close").over(by_symbol())
    rows = in_order(bars).withColumns({"__d": move, "__v": F.coalesce(F.pow(F.try_divide(F.col("close"), F.col("close") - move) - 1, F.lit(2)), F.lit(0.0))})
    rows = rows.withColumns({"__a": F.abs("__d"), "__up": F.greatest("__d", F.lit(0.0)), "__dn": F.greatest(-F.col("__d"), F.lit(0.0))})
    for w in rsi_windows:  # the seed is the mean of the first w moves
        frame = by_symbol().rowsBetween(1 - w, 0)
        rows = rows.withColumns({f"__{n}{w}": F.when(F.col("__rn") == w, F.avg(f"__{n}").over(frame)).otherwise(F.col(f"__{n}")) for n in ("up", "dn")})
    quick, calm = (2.0 / 3) ** 2, (2.0 / 31) ** 2
    for w in kama_windows:
        path = F.sum("__a").over(by_symbol().rowsBetween(1 - w, 0))
        ratio = F.when(path > 0, F.abs(F.col("close") - F.lag("close", w).over(by_symbol())) / path).otherwise(0.0)
        rows = rows.withColumn(f"__s{w}", 1 - (calm + ratio * (quick - calm)))
    triple = sorted({*spans, *trix_spans})
    keep = {w: 1 - 2.0 / (w + 1) for w in {*triple, 25, 13}}
    one = {f"__e1_{w}": ("close", keep[w], 0) for w in triple} | {f"KAMA_{w}": ("close", f"__s{w}", w) for w in kama_windows}
    one |= {f"__{n}_{w}": (f"__{n}{w}", 1 - 1.0 / w, w) for w in rsi_windows for n in ("up", "dn")} | {"__m1": ("__d", keep[25], 1), "__a1": ("__a", keep[25], 1), "__ew": ("__v", decay, 0)}
    rows = chained(rows, one, chunk)
    rows = chained(rows, {f"__e2_{w}": (f"__e1_{w}", keep[w], 0) for w in triple} | {"__m2": ("__m1", keep[13], 1), "__a2": ("__a1", keep[13], 1)}, chunk)
    rows = chained(rows, {f"__e3_{w}": (f"__e2_{w}", keep[w], 0) for w in triple}, chunk)
    out = {f"TEMA_{w}": 3 * F.col(f"__e1_{w}") - 3 * F.col(f"__e2_{w}") + F.col(f"__e3_{w}") for w in spans}
    out |= {f"RSI_{w}": 100 - 100 / (1 + F.col(f"__up_{w}") / (F.col(f"__dn_{w}") + EPS)) for w in rsi_windows}
    out |= {f"TRIX_{w}": 100 * (F.col(f"__e3_{w}") - F.lag(f"__e3_{w}").over(by_symbol())) / (F.col(f"__e3_{w}") + EPS) for w in trix_spans}
    out |= {"TSI": 100 * F.col("__m2") / (F.col("__a2") + EPS), f"EWMA_{round(100 * decay)}": F.sqrt("__ew")}
    rows = rows.withColumns(out).withColumn("__r", F.try_divide("close", F.col("close") - F.col("__d")) - 1)
    rows = moments_chained(rows, {f"EWMStd_{w}": ("__r", w) for w in std_spans}, chunk) if std_spans else rows
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])
