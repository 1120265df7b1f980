"""Greedy event filters by links equal the walk one by one."""

import datetime as dt
import random

import pytest

from barloom.operators import labels as L

SCHEMA = "symbol string, t0 timestamp, t1 timestamp, vol double"


def events(spark, seed, step, n=60):
    rng, rows, start = random.Random(seed), [], dt.datetime(2024, 1, 1, 9)
    for s in ("a", "b", "c"):
        t = start
        for i in range(n if s != "c" else 1):
            t += dt.timedelta(seconds=rng.choice(step))
            end = None if rng.random() < 0.004 else t + dt.timedelta(seconds=rng.choice([0, 60, 3600, 20_000]))
            rows.append((s, t, end, float(i)))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(got, want):
    key = lambda r: (r.symbol, r.t0, r.vol)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


@pytest.mark.parametrize("chunk", [7, 1000])
@pytest.mark.parametrize(("seed", "step"), [(1, [600, 1800, 3600]), (2, [3600, 86_400, 90_000]), (3, [30_000, 200_000])])
def test_spaced(spark, seed, step, chunk):
    rows = events(spark, seed, step)
    for seconds in (3600, 6 * 3600):
        same(L.spaced(rows, seconds, True, chunk), L.greedy(rows, lambda t0, a, _, s=seconds: (t0 - a) // 1_000_000 >= s))
        if chunk == 7 or seconds == 3600:
            same(L.spaced(rows, seconds, False, chunk), L.greedy(rows, lambda t0, a, _, s=seconds: (t0 - a) // 1_000_000 % 86_400 >= s))


def test_once_a_day(spark):
    """Distances of whole days count as none: only the first event stays, after the looks end."""
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), None, float(i)) for i in range(20)], SCHEMA)
    assert [r.vol for r in L.spaced(rows, 3600).collect()] == [0.0]
    assert [r.vol for r in L.spaced(rows, 90_000).collect()] == [0.0] and L.spaced(rows, 0).count() == 20


@pytest.mark.parametrize("chunk", [5, 1000])
def test_without_overlap(spark, chunk):
    rows = events(spark, 5, [600, 1800, 3600])
    same(L.without_overlap(rows, chunk), L.greedy(rows, lambda t0, _, b: b is not None and t0 >= b))
    assert L.without_overlap(rows.limit(0)).count() == 0


def test_barrier_is_the_first_time_from_there(spark):
    rows = events(spark, 8, [600, 1800, 3600]).select("symbol", "t0").withColumnRenamed("t0", "ts")
    got = {(r.symbol, r.ts): r.t1 for r in L.vertical_barrier(rows, 5000).collect()}
    for (s, t), found in got.items():
        later = [u for (z, u) in got if z == s and u >= t + dt.timedelta(seconds=5000)]
        assert found == min(later, default=None)
