"""Models, run histories and compressed exports are read back as they were written."""

import datetime as dt

import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import Vectors

from barloom.operators import bars, labels
from barloom.sources import tables


def test_model_is_read_back_and_checked(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 2), Vectors.dense([i % 2 + i / 50, i % 3])) for i in range(60)], ["label", "features"])
    model = LogisticRegression(maxIter=5).fit(rows)
    digest = tables.write_model(model, str(tmp_path / "a"))
    again = tables.read_model(LogisticRegressionModel, str(tmp_path / "a"), digest)
    assert again.coefficients == model.coefficients
    other = LogisticRegression(maxIter=1).fit(rows)
    assert tables.write_model(other, str(tmp_path / "b")) != digest
    with pytest.raises(ValueError, match="not the one"):
        tables.read_model(LogisticRegressionModel, str(tmp_path / "b"), digest)


def test_history_keeps_the_newest_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    for k in range(4):
        kept = tables.record_run(spark.createDataFrame([(f"r{k}", k)], "run_id string, n int"), path, keep=2)
    assert kept == ["r3", "r2"]
    assert {r.n for r in spark.read.parquet(path).collect()} == {2, 3}


def test_zstd_minutes(spark, tmp_path):
    import zstandard

    text = "symbol,ts_event,open,high,low,close,volume\nNQH4,2024-01-02 10:00:00,1,2,0.5,1.5,7\nNQM4,2024-01-02 10:01:00,1,2,0.5,,8\n"
    (tmp_path / "x.csv.zst").write_bytes(zstandard.compress(text.encode()))
    rows = tables.read_zstd_minutes(spark, str(tmp_path / "x.csv.zst")).orderBy("symbol").collect()
    assert [(r.symbol, r.close, r.volume) for r in rows] == [("NQH4", 1.5, 7), ("NQM4", None, 8)]
    assert rows[0].ts_event.hour == 10


def test_roots_roll_apart(spark):
    day = lambda k: dt.datetime(2024, 1, 1 + k, 12)
    rows = [(f"{root}{month}4", day(k), 100.0 + k, 10 if (month == "H") == (k < roll) else 1) for root, roll in (("NQ", 2), ("ES", 3)) for month in "HM" for k in range(5)]
    minutes = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, volume long")
    front = {(r.root, r.day.day): r.symbol for r in bars.front_contracts(minutes, bars.parse_code("symbol")).collect()}
    assert front == {(root, 1 + k): f"{root}{'H' if k < roll else 'M'}4" for root, roll in (("NQ", 2), ("ES", 3)) for k in range(5)}
    assert bars.roll_factors(minutes, bars.front_contracts(minutes, bars.parse_code("symbol"))).count() == 10


def test_events_after_an_open_end(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    events = spark.createDataFrame([("a", t(0), t(2)), ("a", t(1), t(3)), ("a", t(2), None), ("a", t(9), t(10))], "symbol string, t0 timestamp_ntz, t1 timestamp_ntz")
    assert sorted(r.t0.hour for r in labels.without_overlap(events).collect()) == [0, 2]
