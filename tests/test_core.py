"""Edge fixtures, recurrences, splits, barriers, models, sources and streams."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, bars, checks, complexity, evaluate, extensions, labels, normalize, regimes, scan, splits, structure, trend, unsupervised
from barloom.operators.calendar import federal_holidays
from barloom.plans import config
from barloom.plans.pipeline import Scaler, Settings, build_features, feature_matrix
from barloom.plans.registry import hourly
from barloom.sources import tables
from barloom.streaming import live_bars

START = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def series(spark, closes, step=dt.timedelta(hours=1), symbol="A"):
    rows = [(symbol, START + i * step, c, None if c is None else c + 1, None if c is None else c - 1, c, 10) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def walk(n, seed=1):
    return (100 + np.cumsum(np.random.default_rng(seed).normal(size=n))).round(6).tolist()


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


# ---- bars


def test_cleaning(spark):
    rows = [("A", START, 1.0, 1), ("A", START, 2.0, 2), ("A", START + dt.timedelta(hours=1), None, 3)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, seq int")
    kept = bars.drop_incomplete(bars.keep_first(df, "seq"), ("close",)).collect()
    assert [(r.close, r.seq) for r in kept] == [(1.0, 1)]


def test_spike_filter_drops_warm_up_and_spikes(spark):
    closes = walk(150)
    closes[120] += 500
    got = {r.ts for r in bars.spike_filter(series(spark, closes)).collect()}
    assert START + dt.timedelta(hours=120) not in got and min(got) == START + dt.timedelta(hours=98)


def test_daily_gaps_are_zero_days(spark):
    rows = spark.createDataFrame([("A", START + dt.timedelta(days=d), 5.0) for d in (0, 1, 4)], "symbol string, ts timestamp_ntz, v double")
    assert [r.v for r in bars.daily_with_gaps(rows, "v").orderBy("day").collect()] == [5.0, 5.0, 0.0, 0.0, 5.0]


def test_contract_codes(spark):
    df = spark.createDataFrame([("NQM4",), ("NQH24",), ("NQZ31",), ("NQA4",)], "c string")
    assert [r[0] for r in df.select(bars.parse_code("c")).collect()] == [202406, 202403, 203112, None]


def test_roll_never_goes_back(spark):
    rows = []
    for day, leader in enumerate(("NQH4", "NQM4", "NQH4", "NQM4")):
        for hour in range(3):
            for code, base in (("NQH4", 100.0), ("NQM4", 110.0)):
                rows.append((code, START + dt.timedelta(days=day, hours=hour), *(base + hour,) * 4, 50 if code == leader else 5))
    minutes = spark.createDataFrame(rows, BAR)
    front = bars.front_contracts(minutes, bars.parse_code("symbol"))
    assert [r.symbol for r in front.orderBy("day").collect()] == ["NQH4", "NQM4", "NQM4", "NQM4"]
    factors = {r.day.day: r.factor for r in bars.roll_factors(minutes, front).collect()}
    assert factors[1] == pytest.approx(112 / 102) and {factors[d] for d in (2, 3, 4)} == {1.0}
    assert bars.back_adjust(minutes, bars.roll_factors(minutes, front)).count() == 12


def test_chunks_with_halo_give_the_same_windows(spark):
    df = series(spark, walk(230))
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "__chunk").orderBy("ts").rowsBetween(-9, 0)
    cut = bars.in_chunks(df, 50, 9).withColumn("m", F.when(F.count("close").over(w) == 10, F.avg("close").over(w))).where("__own")
    assert column(cut, "m") == pytest.approx(column(trend.sma(df, (10,)), "SMA_10"), nan_ok=True)


# ---- recurrences


def test_recurrences_match_pandas(spark):
    x = pd.Series(walk(300))
    out = scan.scan(series(spark, x.tolist()).withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(scan.by_symbol())) - 1), {
        "ema": ("close", scan.ema, {"span": 20}), "std": ("ret", scan.ewm_std, {"span": 30}), "tema": ("close", scan.tema, {"span": 10}), "ewma": ("ret", scan.ewma_vol, {"decay": 0.94}),
        "kama": ("close", scan.kama, {"w": 10}), "rsi": ("close", scan.rsi, {"w": 14}), "trix": ("close", scan.trix, {"w": 15}), "tsi": ("close", scan.tsi, {}),
    })
    e = x.ewm(span=20, adjust=False).mean()
    assert column(out, "ema") == pytest.approx(e.tolist())
    one = x.ewm(span=10, adjust=False).mean()
    two = one.ewm(span=10, adjust=False).mean()
    assert column(out, "tema") == pytest.approx((3 * one - 3 * two + two.ewm(span=10, adjust=False).mean()).tolist())
    std = x.pct_change().ewm(span=30).std()
    got = [np.nan if v is None else v for v in column(out, "std")]
    assert got[2:] == pytest.approx(std.tolist()[2:])
    r2 = x.pct_change().fillna(0) ** 2
    assert column(out, "ewma") == pytest.approx(np.sqrt(r2.ewm(alpha=0.06, adjust=False).mean()).tolist())
    up, down = x.diff().clip(lower=0)[1:], (-x.diff()).clip(lower=0)[1:]
    seeded = lambda s: pd.concat([pd.Series([s[:14].mean()]), s[14:]]).ewm(alpha=1 / 14, adjust=False).mean()
    want = 100 - 100 / (1 + seeded(up) / (seeded(down) + 1e-10))
    assert column(out, "rsi")[14:] == pytest.approx(want.tolist()) and column(out, "rsi")[:14] == [None] * 14
    assert column(out, "kama")[:10] == [None] * 10 and column(out, "kama")[10] == x[10]
    ema_of = lambda s, n: s.ewm(span=n, adjust=False).mean()
    e3 = ema_of(ema_of(ema_of(x, 15), 15), 15)
    assert column(out, "trix")[1:] == pytest.approx((100 * e3.diff() / (e3 + 1e-10)).tolist()[1:])
    d = x.diff()[1:]
    assert column(out, "tsi")[0] is None
    assert column(out, "tsi")[1:] == pytest.approx((100 * ema_of(ema_of(d, 25), 13) / (ema_of(ema_of(d.abs(), 25), 13) + 1e-10)).tolist())
    want = [x[10]]
    for i in range(11, len(x)):
        ratio = abs(x[i] - x[i - 10]) / x[i - 10 : i + 1].diff().abs().sum()
        want.append(want[-1] + (ratio * ((2 / 3) ** 2 - (2 / 31) ** 2) + (2 / 31) ** 2) * (x[i] - want[-1]))
    assert column(out, "kama")[10:] == pytest.approx(want)


def test_constant_series(spark):
    out = trend.trend_recurrences(trend.reg_r2(series(spark, [100.0] * 60), (20,)), (10,))
    row = out.orderBy(F.desc("ts")).first()
    assert row.EMA_10 == 100 and row.KAMA_10 == 100 and row.RSI_14 == pytest.approx(0) and row.RegR2_20 == 1.0


# ---- structure, regimes, calendar


def test_parity_flags_never_fire_but_prior_levels_do(spark):
    df = series(spark, walk(300))
    plain = structure.traps(structure.breakouts(df, (10,)), (10,))
    assert plain.where("Breakout_10 = 1 or Breakdown_10 = 1 or BullTrap_10 = 1 or BearTrap_10 = 1").count() == 0
    assert structure.breakouts(df, (10,), exclude_current=True).where("Breakout_10 = 1 or Breakdown_10 = 1").count() > 0


def test_causal_swings_wait(spark):
    df = series(spark, [1.0, 2.0, 3.0, 2.0, 1.0, 1.0, 1.0])
    assert column(structure.swings(df, (2,)), "SwingHigh_2")[2] == 1
    assert column(structure.swings(df, (2,), causal=True), "SwingHigh_2")[4] == 1


def test_run_lengths(spark):
    df = series(spark, [1.0, 1.0, 1.0, 2.0, 2.0, 1.0])
    assert column(regimes.run_lengths(df, "close", "n"), "n") == [1, 2, 3, 1, 2, 1]
    assert column(regimes.run_lengths(df, "close", "n", True), "n") == [1, 1, 2, 1, 2, 1]


def test_holidays():
    days = federal_holidays(2024, 2024)
    assert dt.date(2024, 1, 15) in days and dt.date(2024, 5, 27) in days and dt.date(2024, 11, 28) in days and len(days) == 11


# ---- labels


@pytest.mark.parametrize(
    ("path", "first_touch", "label", "end"),
    [
        ([100, 103, 100, 100], False, 1, 1), ([100, 97, 100, 100], False, -1, 1), ([100, 97, 103, 100], False, 1, 2), ([100, 97, 103, 100], True, -1, 1),
        ([100, 100.5, 100.2, 100.1], False, 1, 3), ([100, 99.5, 99.8, 99.9], False, -1, 3), ([100, 102, 100, 100], False, 1, 1), ([100, 100, 100, 100], False, 0, 3),
    ],
)
def test_barrier_paths(spark, path, first_touch, label, end):
    df = series(spark, [float(p) for p in path])
    events = labels.event_table(labels.vertical_barrier(df, 3 * 3600).withColumn("vol", F.lit(0.02)), "vol").where(F.col("t0") == F.lit(START))
    row = labels.barrier_outcomes(events, df, first_touch, bin_seconds=7200).first()
    assert (row.label, row.t_end) == (label, START + dt.timedelta(hours=end))


def test_no_vertical_barrier_past_the_end(spark):
    assert column(labels.vertical_barrier(series(spark, walk(4)), 7200), "t1") == [START + dt.timedelta(hours=2), START + dt.timedelta(hours=3), None, None]


def test_greedy_filters(spark):
    rows = [("A", START + dt.timedelta(hours=h), START + dt.timedelta(hours=h + 5), 0.1, 0.1, -0.1) for h in (0, 2, 5, 30, 36)]
    events = spark.createDataFrame(rows, "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, vol double, pt double, sl double")
    hours = lambda df: sorted((r.t0 - START).total_seconds() // 3600 for r in df.collect())
    assert hours(labels.without_overlap(events)) == [0, 5, 30, 36]
    assert hours(labels.spaced(events, 4 * 3600)) == [0, 5, 36]  # 25 hours count as one
    assert hours(labels.spaced(events, 4 * 3600, whole_days=True)) == [0, 5, 30, 36]


# ---- splits


@pytest.mark.parametrize(("train", "test", "step", "want"), [(4, 2, None, 3), (4, 2, 3, 2), (6, 6, None, 0)])
def test_rolling_counts(train, test, step, want):
    assert splits.n_rolling(10, train, test, step) == want


def index(spark, n, reach=0):
    return splits.numbered(series(spark, walk(n), dt.timedelta(days=1)).withColumn("t1", F.lead("ts", reach).over(scan.by_symbol()) if reach else F.col("ts")), "ts", "t1").drop("symbol")


def parts(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.split_id, r.role), set()).add(r.row_id)
    return out


def test_rolling_windows(spark):
    got = parts(splits.walk_forward(index(spark, 10), 4, 2))
    assert got == {(0, "train"): {0, 1, 2, 3}, (0, "test"): {4, 5}, (1, "train"): {2, 3, 4, 5}, (1, "test"): {6, 7}, (2, "train"): {4, 5, 6, 7}, (2, "test"): {8, 9}}
    assert splits.walk_forward(index(spark, 10), 6, 6).count() == 0


@pytest.mark.parametrize("reach", [0, 3])
def test_purge_leaves_no_overlap(spark, reach):
    rows = index(spark, 60, reach)
    spans = {r.row_id: (r.t0, r.t1) for r in rows.collect()}
    for table in (splits.purged_kfold(rows, 5, 2), splits.combinatorial(rows, 5, 2, 2, hull=False), splits.clustered(rows.withColumn("k", F.col("row_id") % 3), "k", 4, embargo=2)):
        got = parts(table)
        for split in {s for s, _ in got}:
            train, test = got.get((split, "train"), set()), got[split, "test"]
            assert not train & test
            assert all(spans[a][1] < spans[b][0] or spans[a][0] > spans[b][1] for a in train for b in test)
            assert not any(t - 2 <= e < t for t in train for e in test if e + 1 not in test)


def test_fold_sizes_are_ntiles(spark):
    sizes = [r["count"] for r in splits.folds(index(spark, 60), 7).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [9, 9, 9, 9, 8, 8, 8]


def test_combinations_and_audit(spark):
    rows = index(spark, 30, 2)
    table = splits.combinatorial(rows, 5, 2)
    assert table.select("split_id").distinct().count() == len(list(itertools.combinations(range(5), 2)))
    plain = splits.audit(splits.purged_kfold(rows, 3, 0, purge=False), rows)
    assert {r.n_shared for r in plain.collect()} == {0} and sum(r.n_overlap for r in plain.collect()) > 0
    assert {r.leaks for r in splits.audit(splits.purged_kfold(rows, 3), rows, strict=True).collect()} == {False}


def test_embargo_sizes():
    assert splits.embargo_size(100, 0.015) == 2 and splits.embargo_size(100, 7) == 7
    for bad in (-1, 1.0):
        with pytest.raises(ValueError):
            splits.embargo_size(10, bad)
    with pytest.raises(TypeError):
        splits.embargo_size(10, "1")


# ---- simulation, evaluation, checks


def test_equity_is_the_sum_of_pnl(spark, sf):
    from barloom.plans.research_queries import preds

    rows = backtest.backtest(backtest.with_market(backtest.signals(preds(spark, sf)), hourly(spark, sf)), "signal_net", "s")
    last = rows.groupBy("symbol").agg(F.max_by("s_equity", "ts").alias("e"), F.sum("s_pnl_net").alias("p")).collect()
    assert all(r.e == pytest.approx(r.p) for r in last)
    assert rows.where("abs(p_bear + p_neutral + p_bull - 1) > 1e-9").count() == 0


def test_conviction_zones(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (0.1, 0.4), (0.2, 0.2), (1.0, 0.0)], f"{extensions.BULL} double, {extensions.BEAR} double")
    assert [r.conviction_zone for r in extensions.conviction(rows).collect()] == [None, "Strong Bear", "Neutral", "Strong Bull"]


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "p double, y int")
    assert evaluate.auc(rows, "p", F.col("y") == 1).first().auc == pytest.approx(0.875)


def test_t_tail():
    assert evaluate.t_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and evaluate.t_tail(0.0, 5) == 1.0


def test_validation_finds_faults(spark):
    rows = spark.createDataFrame([("A", 1, 0.5, 0.2, 0.2, 0), ("A", 1, 0.5, 0.3, 0.2, 1), ("A", 2, None, 0.3, 0.2, 0)], "symbol string, ts int, p_bear double, p_neutral double, p_bull double, y int")
    got = {r.check: (r.value, r.ok) for r in checks.validate(rows, "y").collect()}
    assert got["null_cells"] == (1, False) and got["repeated_keys"] == (1, False) and got["bad_probability_sums"][1] is False and got["rarest_class_share"][1] is True


def test_clean_drops_and_fills(spark):
    rows = spark.createDataFrame([("A", i, None if i % 2 else 1.0, float(i) if i != 3 else None, float(i)) for i in range(6)], "symbol string, ts int, a double, b double, c double")
    out = normalize.clean(rows, ["a", "b", "c"], max_column_nulls=0.4, min_row_share=0.5)
    assert "a" not in out.columns and {r.ts: r.b for r in out.collect()}[3] == 2.0


# ---- complexity, hidden states, settings


def test_entropies_and_hurst(spark):
    out = complexity.scalars(series(spark, walk(400))).first()
    x = np.array(walk(400))
    d = np.abs(x[:, None] - x[None, :]) <= 0.2
    pair = d[:-1, :-1] & d[1:, 1:]
    triple = pair[:-1, :-1] & d[2:, 2:]
    phi = lambda c: np.log(c.mean(axis=0) + 1e-10).mean()
    steps = [np.mean([np.abs(np.diff(x[m::k])).mean() * (len(x) - 1) / k for m in range(k)]) for k in range(1, 11)]
    assert out.FracDim == pytest.approx(1 - np.polyfit(np.log(1 / np.arange(1, 11)), np.log(steps), 1)[0])
    assert out.ApEn == pytest.approx(phi(pair) - phi(triple)) and out.Hurst is not None and out.DFA > 1


def test_hidden_chain_separates_regimes():
    rng = np.random.default_rng(0)
    truth = np.repeat([0, 1, 0, 1], 150)
    x = np.where(truth[:, None] == 1, rng.normal(3, 1, (600, 2)), rng.normal(-3, 0.5, (600, 2)))
    model = unsupervised.fit_chain(x, 2, 50)
    states = unsupervised.viterbi(unsupervised._log_density(x, model), model)
    assert (states == truth).mean() > 0.99 and np.allclose(model.move.sum(axis=1), 1)


def test_timeframes():
    hour = config.timeframe("1H")
    assert hour.horizons == [5, 10, 20, 50, 100] and hour.forest == (200, 6, 3) and hour.walk("momentum") == (882, 147, 147) and hour.bars_needed == (500, 2000)
    assert config.timeframe("1W").folds == 3
    with pytest.raises(ValueError):
        config.timeframe("7Q")


def test_feature_matrix(spark):
    df = series(spark, walk(260))
    light = Settings(trend=False, structure=False, seasonality=False)
    rows, names = feature_matrix(df, light)
    assert names and rows.count() > 100 and any(n.endswith("_zscore") for n in names)
    built = build_features(df, light)
    scaled = Scaler.fit(built, ["EWMA_94"]).transform(built)
    assert abs(scaled.agg(F.avg("EWMA_94_zscore")).first()[0]) < 1e-6


# ---- sources and streams


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("time,open,high,low,close,volume\n1704067200,1,2,0.5,1.5,10\n1704067200000,1,2,0.5,1.5,10\n")
    got = tables.read_bars(spark, str(tmp_path / "bars.csv")).collect()
    assert {r.ts for r in got} == {START}
    df = series(spark, walk(5))
    for form in ("parquet", "json"):
        tables.write(df, str(tmp_path / form), form, by=("symbol",))
        assert spark.read.format(form).load(str(tmp_path / form)).count() == 5
    assert tables.checksum(df) == tables.checksum(df.repartition(3))
    for name, v in (("config_1.json", 1), ("config_2.json", 2)):
        (tmp_path / name).write_text('{"v": %d}' % v)
    assert tables.newest_config(spark, str(tmp_path / "config_*.json")).first().v == 2
    runs = spark.createDataFrame([(f"r{i}", i) for i in range(8)], "run_id string, x int")
    assert {r.run_id: r.age for r in tables.run_history(runs, 3).collect()} == {"r7": 0, "r6": 1, "r5": 2}


def test_streamed_bars_are_the_batch_bars(spark, tmp_path):
    rows = [("A", START + dt.timedelta(minutes=7 * i), i, 100.0 + i % 13) for i in range(120)] + [("A", START + dt.timedelta(days=3), 999, 1.0)]
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], "symbol string, ts timestamp, event_id long, price double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ticks = live_bars.tick_stream(spark, str(tmp_path / "in"), "symbol string, ts timestamp, event_id long, price double")
    got = live_bars.run_to_table(live_bars.stream_bars(ticks), "live", str(tmp_path / "c1"))
    plain = spark.createDataFrame(rows[:120], "symbol string, ts timestamp_ntz, event_id long, price double")
    want = bars.bars_of(plain, "1 hour").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streamed_ema(spark, tmp_path):
    closes = walk(30)
    df = spark.createDataFrame([("A", START + dt.timedelta(hours=i), c) for i, c in enumerate(closes)], "symbol string, ts timestamp, close double")
    df.where("ts < '2024-01-01 15:00:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("ts >= '2024-01-01 15:00:00'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = live_bars.run_to_table(live_bars.stream_ema(stream, 10), "ema", str(tmp_path / "c2")).orderBy("ts").collect()
    assert [r.ema for r in out] == pytest.approx(pd.Series(closes).ewm(span=10, adjust=False).mean().tolist())


def test_running_sums_match_one_window(spark):
    import random

    from pyspark.sql import functions as F

    from barloom.functions.running import running_sums, unit_bins

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), v, rng.randrange(5)) for v in rng.sample(range(2000), 700)]
    frame = spark.createDataFrame([(g, float(v), n) for g, v, n in rows], "g string, v double, n int")
    for by, descending, here in (((), False, True), ((), True, True), (("g",), False, False), (("g",), True, False)):
        got = running_sums(frame, "v", {"s": F.col("n")}, by, descending, here).collect()
        assert len(got) == len(rows)
        for r in got:
            peers = [x for x in rows if not by or x[0] == r.g]
            assert r.s == sum(x[2] for x in peers if (x[1] > r.v if descending else x[1] < r.v) or (here and x[1] == r.v))
    unit = running_sums(frame, "v", {"s": F.col("n")}, bin_of=unit_bins(F.col("v") / 1000)).collect()
    assert all(r.s == sum(x[2] for x in rows if x[1] <= r.v) for r in unit)
    assert running_sums(frame.where("false"), "v", {"s": F.col("n")}).count() == 0
