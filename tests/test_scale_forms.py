"""Forms that cut long series or many blocks over tasks, against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.joins import first_from
from barloom.operators import complexity as Z
from barloom.operators import interactions as I
from barloom.operators import scan as S
from barloom.operators import splits as C

START = dt.datetime(2024, 1, 1)


def bars(spark, x, symbol="a"):
    return [(symbol, START + dt.timedelta(hours=i), None if v is None or np.isnan(v) else float(v)) for i, v in enumerate(x)]


@pytest.mark.parametrize("chunk", [1, 7, 50, 1000])
def test_deviation_over_chunks(spark, chunk):
    rng = np.random.default_rng(1)
    x = rng.normal(size=130) + 5
    x[[0, 1, 20, 21, 22, 70]] = np.nan
    y = np.full(3, np.nan)
    rows = spark.createDataFrame(bars(spark, x) + bars(spark, y, "b"), "symbol string, ts timestamp, x double").repartition(3)
    got = S.moments_chained(S.in_order(rows), {"d": ("x", 10), "e": ("x", 40)}, chunk).orderBy("symbol", "ts").toPandas()
    for name, span in (("d", 10), ("e", 40)):
        for s, series in (("a", x), ("b", y)):
            assert np.allclose(got[got.symbol == s][name].to_numpy(float), S.ewm_std(series, span), equal_nan=True)


def close_counts(x, m, n, r):
    p = np.array([x[i : i + m] for i in range(n)])
    return (np.abs(p[:, None] - p[None]) <= r).all(axis=2).sum(axis=1)


@pytest.mark.parametrize("r", [0.05, 0.2, 3.0])
def test_grid_counts_and_entropies(spark, r):
    rng = np.random.default_rng(2)
    x = np.round(np.cumsum(rng.normal(size=230) * 0.1), 2)  # ties, and pairs exactly r apart
    rows = spark.createDataFrame([(*b[:2], b[2]) for b in bars(spark, x) + bars(spark, x[:4], "b") + bars(spark, x[:1], "c")], "symbol string, ts timestamp, close double").repartition(3)
    got = {q.symbol: q for q in Z.pair_scalars(rows, r).collect()}

    def phi(m):
        n = len(x) - m + 1
        return np.log(close_counts(x, m, n, r) / n + 1e-10).sum() / n

    pairs = {m: close_counts(x, m, len(x) - m, r).sum() - (len(x) - m) for m in (2, 3)}
    assert got["a"].ApEn == pytest.approx(phi(2) - phi(3)) and got["a"].SampEn == pytest.approx(-np.log((pairs[3] + 1e-10) / (pairs[2] + 1e-10)))
    y = np.column_stack([x[:-1], x[1:]])
    least = [min(np.hypot(*(y[i] - y[j])) for j in range(len(y)) if j != i) for i in range(200)]
    assert got["a"].Lyap == pytest.approx(np.mean(np.log(np.array(least) + 1e-10)) / 200)
    assert all(v is None for s in "bc" for v in (got[s].ApEn, got[s].SampEn, got[s].Lyap))


@pytest.mark.parametrize(("hull", "each_block", "sent"), [(False, True, 10**6), (False, False, 500), (True, True, 1)])
def test_purge_with_many_blocks(spark, monkeypatch, hull, each_block, sent):
    monkeypatch.setattr(C, "SENT", sent)
    rng, n = random.Random(3), 3000
    spans = [(i, i * 10, i * 10 + rng.choice([0, 5, 20, 200])) for i in range(n)]
    rows = spark.createDataFrame(spans, "row_id long, t0 long, t1 long").repartition(3)
    chosen = {0: {i for i in range(n) if i % 3 == 0 and 300 < i < 2700}, 1: {i for i in range(n) if rng.random() < 0.2}}
    tests = spark.createDataFrame([(s, *spans[i]) for s, own in chosen.items() for i in own], "split_id int, row_id long, t0 long, t1 long")
    got = {(r.split_id, r.row_id): r.role for r in C.purged(rows, tests, 2, hull, True, each_block).collect()}
    want = {}
    for s, own in chosen.items():
        a, z, last = np.array([spans[i][1] for i in sorted(own)]), np.array([spans[i][2] for i in sorted(own)]), max(own)
        for i, t0, t1 in spans:
            over = (t0 <= z.max() and t1 >= a.min()) if hull else bool(((a <= t1) & (z >= t0)).any())
            ends = [i - k for k in (1, 2) if i - k in own and i - k + 1 not in own] if each_block else [k for k in (i - 1, i - 2) if k == last]
            if i in own or not (over or ends):
                want[s, i] = "test" if i in own else "train"
    assert got == want


def test_first_from(spark):
    rng = random.Random(5)
    data = [("k" if rng.random() < 0.5 else None, rng.randrange(40), rng.choice([None, rng.randrange(50)]), i) for i in range(200)]
    rows = spark.createDataFrame(data, "k string, t int, u int, v int").where("k is not null").repartition(4)
    own = [d for d in data if d[0]]
    for r in first_from(rows, ("k",), F.col("t"), F.col("u"), F.col("v"), "found").collect():
        later = [(t, v) for _, t, _, v in own if r.u is not None and t >= r.u]
        assert r.found == (min(later)[1] if later else None)


def test_pair_effects_with_gaps_and_small_groups(spark):
    rng = np.random.default_rng(6)
    n = 300
    x, s = rng.normal(size=(n, 3)), rng.normal(size=(n, 3))
    s[:, 0] += 0.8 * x[:, 1]
    data = [(int(i % 50 == 0), *map(float, x[i]), *map(float, s[i])) for i in range(n)]
    data[3] = (0, None, *data[3][2:])
    rows = spark.createDataFrame(data, "g int, a double, b double, c double, pa double, pb double, pc double").repartition(4)
    values = {"a": "pa", "b": "pb", "c": "pc"}
    got = {(r.g, r.x, r.given): r for r in I.pair_effects(rows, list("abc"), values, "g").collect()}
    own = [d for d in data if d[0] == 0 and d[1] is not None]
    y, z = np.array([d[4] for d in own]), np.array([d[2] for d in own])
    lo, hi = y[z <= np.quantile(z, 0.25)], y[z >= np.quantile(z, 0.75)]
    pooled = np.sqrt(((len(lo) - 1) * lo.var(ddof=1) + (len(hi) - 1) * hi.var(ddof=1)) / (len(lo) + len(hi) - 2))
    r = got[0, "a", "b"]
    assert r.n == len(own) and r.cohens_d == pytest.approx((hi.mean() - lo.mean()) / pooled) and r.r2 == pytest.approx(np.corrcoef(y, z)[0, 1] ** 2)
    assert r.mean_low == pytest.approx(lo.mean()) and r.diff_abs == pytest.approx(np.abs(hi).mean() - np.abs(lo).mean())
    assert got[1, "a", "b"].n == 6 and got[1, "a", "b"].cohens_d == 0  # too few rows to say
    best = I.combined(rows, list("abc"), values, 2).orderBy(F.desc("abs_cohens_d")).first()
    assert (best.x, best.given, best.strength, best.direction) == ("a", "b", "strong", "MORE") or I.strongest(rows, list("abc"), values, 2) != ["a", "b"]
    assert I.summary(I.pair_effects(rows, list("abc"), values)).first().n_pairs == 6
    assert I.pair_effects(rows.limit(0), list("abc"), values).count() == 0


def test_recurrences_of_long_and_short_series(spark, sf):
    from barloom.plans.registry import hourly

    rows = hourly(spark, sf)
    sizes = sorted(r["count"] for r in rows.groupBy("symbol").count().collect())
    edge = (sizes[0] + sizes[-1]) // 2
    assert sizes[0] <= edge < sizes[-1]
    for fn, args in ((S.trend_recurrences, ((5, 20),)), (S.ema_panel, ((5, 20),))):
        a, b = (fn(rows, *args, chunk=c).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for c in (100_000, edge))
        assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
        for c in a.columns:
            if c not in ("symbol", "ts"):
                assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True), c
    moves = rows.withColumn("ret", F.when(F.col("volume") % 3 > 0, F.col("close") / F.col("open") - 1))
    a, b = (S.ewma_columns(moves, chunk=c).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for c in (100_000, edge))
    assert all(np.allclose(a[c], b[c]) for c in ("EWMA_94", "EWMA_97", "EWMA_99"))
