"""Streamed indicators equal the batch ones; late rows are counted, idle symbols forgotten."""

import datetime as dt

import numpy as np
import pytest

from barloom.operators import scan as S
from barloom.streaming import live_bars as L

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, close double"


def replay(spark, folder, parts, **options):
    for rows in parts:  # one file after the other
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")
    return L.run_to_files(L.stream_indicators(stream, **options), f"file://{folder}/run").orderBy("symbol", "ts").collect()


def test_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = {s: 100 + np.cumsum(rng.normal(size=60)) for s in "ab"}
    parts = [[(s, START + dt.timedelta(hours=i), float(x[s][i])) for s in "ba" for i in range(lo, lo + 20)] for lo in (0, 20, 40)]
    parts[2].append(("a", START + dt.timedelta(hours=39), 999.0))  # late
    got = replay(spark, tmp_path, parts)
    for s in "ab":
        own = [r for r in got if r.symbol == s]
        assert [r.ts for r in own] == [START + dt.timedelta(hours=i) for i in range(60)]
        assert np.allclose([r.ema for r in own], S.ema(x[s], 20))
        want = S.rsi(x[s], 14)
        assert all(r.rsi is None for r in own[:14]) and np.allclose([r.rsi for r in own[14:]], want[14:])
        assert own[-1].late == (s == "a")


def test_idle_symbol_starts_anew(spark, tmp_path):
    day = dt.timedelta(days=1)
    parts = [[("a", START, 10.0), ("b", START, 10.0)], [("b", START + 9 * day, 20.0)], [("b", START + 10 * day, 20.0)], [("a", START + 11 * day, 40.0), ("b", START + 11 * day, 20.0)]]
    got = {(r.symbol, r.ts): r.ema for r in replay(spark, tmp_path, parts, late="1 hour", idle_hours=24 * 5)}
    assert got["a", START + 11 * day] == 40.0  # its state had expired
    # b's second bar came before the watermark had moved on, so its state was still there
    assert got["b", START + 10 * day] == pytest.approx(S.ema(np.array([10.0, 20.0, 20.0]), 20)[-1])
