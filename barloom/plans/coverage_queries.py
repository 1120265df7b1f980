"""Queries of sources, sinks, settings, complexity and small operators, with the SQL that checks each."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest as P
from ..operators import bars as B
from ..operators import complexity as Z
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import splits as C
from ..sources import tables as S
from .config import TIMEFRAMES, seconds_of, settings_of
from .oracle import ALL, FIXTURE, FIXTURE_ALL, RET, RUN, lag, sql
from .registry import ORACLES, hourly, hourly_all, query, rounded, ticks
from .research_queries import _rows, _sig, _split, preds, psql

OHLCV = ["open", "high", "low", "close", "volume"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{S.scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks: what was written is read again


def _csv_bars(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "bars-csv")
    S.write(hourly_all(spark, d).select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), *OHLCV), path, "csv")
    return rounded(S.read_bars(spark, path), OHLCV)


query("csv_bars", f"WITH {FIXTURE_ALL} SELECT symbol, ts, {', '.join(f'round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}' for c in OHLCV)} FROM bars")(_csv_bars)


def _json_customers(spark: SparkSession, d: str) -> DataFrame:
    path, rows = _folder(spark, "customers-json"), S.read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    S.write(rows, path, "json", by=("c_mktsegment",))
    return spark.read.schema(rows.schema).json(path).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


query("json_sink", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")(_json_customers)


def _newest(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "configs")
    S.write(S.read_table(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("version"), "n_regionkey").coalesce(1), path, "json", by=("version",))
    # one file a version; a configuration is what the last one holds
    return S.newest_config(spark, f"{path}/*/*.json", multi_line=False).select("n_name", "n_regionkey")


query("newest_config", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = (SELECT max(n_regionkey) FROM nation)")(_newest)


def _history(spark: SparkSession, d: str) -> DataFrame:
    runs = ticks(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), "symbol").agg(F.count("*").alias("n"))
    path = _folder(spark, "runs")
    S.record_run(runs, path, keep=4)
    return S.run_history(spark.read.schema(runs.schema).parquet(path), keep=3).select("run_id", "symbol", "n", F.col("age").cast("int").alias("age"))


query("run_history", """WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type AS symbol, count(*) AS n FROM events GROUP BY 1, 2)
 SELECT * FROM (SELECT run_id, symbol, n, CAST(dense_rank() OVER (ORDER BY run_id DESC) - 1 AS INT) AS age FROM r) WHERE age < 3""")(_history)

# ---- cleaning of rows and keys
query("keep_first", "SELECT symbol, ts, round(arg_min(price, event_id), 6) AS price, arg_min(event_id, event_id) AS event_id FROM (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, 100.0 + value AS price, event_id FROM events) GROUP BY 1, 2")(
    lambda spark, d: B.keep_first(ticks(spark, d).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz")), "event_id").select("symbol", "ts", F.round("price", 6).alias("price"), "event_id"))
query("complete_utc_bars", sql(out=["open", "close"], keys=("symbol", "ts + INTERVAL 5 HOUR AS ts"), where="WHERE volume % 3 <> 0"))(
    lambda spark, d: rounded(B.to_utc(B.drop_incomplete(hourly(spark, d).withColumn("close", F.when(F.col("volume") % 3 != 0, F.col("close")))), "Etc/GMT+5"), ["open", "close"]))
query("index_check", """SELECT event_type AS symbol, count(*) FILTER (ts IS NULL) AS n_null, count(ts) - count(DISTINCT date_trunc('minute', ts)) AS n_repeated FROM events GROUP BY 1""")(
    lambda spark, d: L.time_index_problems(ticks(spark, d).withColumn("ts", F.date_trunc("minute", "ts"))))
query("span_check", f"WITH {FIXTURE_ALL}, r AS (SELECT ts AS t0, coalesce(lead(ts, 5) OVER (ORDER BY ts), ts) AS t1 FROM s0) SELECT count(*) FILTER (t0 IS NULL) AS n_null, count(t0) - count(DISTINCT t0) AS n_repeated, count(*) FILTER (t1 < t0) AS n_backward FROM r")(
    lambda spark, d: C.index_problems(_rows(spark, d)))

# ---- settings
def _list(values: str, least: int, most: int | None, first: int) -> str:
    """Distinct whole values / scale within limits, rising, at most ``first`` of them, joined."""
    one = f"greatest({least}, CAST(trunc(x / scale) AS BIGINT))"
    one = f"least({most}, {one})" if most else one
    return f"array_to_string(list_slice(list_sort(list_distinct(list_transform({values}, lambda x: {one}))), 1, {first}), ',')"


def _three_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Bars of three intervals, each a series of its own."""
    rows = ticks(spark, d)
    return reduce(DataFrame.union, [B.bars_of(rows.withColumn("symbol", F.concat("symbol", F.lit(f" {name}"))), size) for name, size in (("30M", "30 minutes"), ("1H", "1 hour"), ("1D", "1 day"))])


_clock = ", ".join(f"({seconds_of(n)}, '{n}', {b}::DOUBLE, {s}::DOUBLE)" for n, (b, s) in TIMEFRAMES.items() if seconds_of(n))
query("timeframe_settings", f"""WITH b AS (SELECT DISTINCT event_type || ' ' || n AS symbol, time_bucket(w, ts) AS ts FROM events, (VALUES ('30M', INTERVAL 30 MINUTE), ('1H', INTERVAL 1 HOUR), ('1D', INTERVAL 1 DAY)) v(n, w)),
  g AS (SELECT symbol, CAST(epoch(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS BIGINT) AS gap FROM b), c AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
  i AS (SELECT c.symbol, first(c.gap ORDER BY c.n DESC, c.gap) AS seconds, any_value(k.n) AS n_bars FROM c JOIN (SELECT symbol, count(*) AS n FROM b GROUP BY 1) k USING (symbol) GROUP BY 1)
  SELECT symbol, seconds, n_bars, n_bars >= least AS enough, * EXCLUDE (symbol, seconds, n_bars) FROM i LEFT JOIN (SELECT seconds, name, {_list('[5, 10, 20, 50, 100]', 1, 500, 5)} AS horizons, {_list('[10, 20, 50, 100]', 3, None, 4)} AS windows, greatest(5, least(200, CAST(trunc(50 / scale) AS BIGINT))) AS vol_window, greatest(1, CAST(trunc(a_day) AS BIGINT)) AS day_bars,
  CASE WHEN a_day < 1 THEN 3 WHEN a_day < 10 THEN 4 ELSE 5 END::BIGINT AS folds, CASE WHEN scale > 10 THEN 50 WHEN scale > 1 THEN 100 ELSE 200 END::BIGINT AS trees, CASE WHEN scale > 10 THEN 3 WHEN scale > 1 THEN 4 ELSE 6 END::BIGINT AS depth,
  CASE WHEN scale > 10 THEN 10 WHEN scale > 1 THEN 5 ELSE 3 END::BIGINT AS leaf, greatest(200, CAST(trunc(500 / scale) AS BIGINT)) AS least, greatest(1000, CAST(trunc(2000 / scale) AS BIGINT)) AS ideal, CAST(trunc(a_day * 63) AS BIGINT) AS train, CAST(trunc(a_day * 10) AS BIGINT) AS test
  FROM (VALUES {_clock}) v(seconds, name, a_day, scale)) t USING (seconds)""")(lambda spark, d: settings_of(_three_sizes(spark, d)))

# ---- complexity of each series
_logs = f"WITH {FIXTURE}, l AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, ln(close / p) AS r, count(*) OVER {ALL} AS n FROM (SELECT *, {lag('close')} AS p FROM s0) WHERE p IS NOT NULL)"
_sizes = [int(v) for v in np.logspace(1, np.log10(200), num=20)]
_ranges = " UNION ALL ".join(
    f"SELECT symbol, {w} AS w, any_value(n) AS n, avg(x) AS t FROM (SELECT symbol, n, CASE WHEN count(*) OVER f = {w} THEN (max(r) OVER f - min(r) OVER f) / (stddev_samp(r) OVER f + 1e-10) END AS x FROM l WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS {w - 1} PRECEDING)) GROUP BY 1"
    for w in sorted(set(_sizes)))
query("hurst", _logs + f""", m AS ({_ranges}), k AS (SELECT unnest([{', '.join(map(str, _sizes))}]) AS w)
 SELECT symbol, CASE WHEN any_value(n) >= 200 THEN round(regr_slope(ln(t + 1e-10), ln(w + 1e-10)), 6) + 0.0 END AS "Hurst" FROM m JOIN k USING (w) WHERE w < n AND t IS NOT NULL GROUP BY 1""")(
    lambda spark, d: rounded(Z.hurst(hourly(spark, d)), keys=("symbol",)))
query("fractal_dimension", f"""WITH {FIXTURE}, c AS (SELECT symbol, rn, count(*) OVER {ALL} AS n, k, abs(close - lag(close, CAST(k AS INT)) OVER (PARTITION BY symbol, k ORDER BY ts)) AS d FROM s0, (SELECT unnest(range(1, 11)) AS k)),
 e AS (SELECT symbol, k, rn % k AS m, sum(d) * (any_value(n) / 10 - 1) / (count(*) * k) AS l FROM c WHERE d IS NOT NULL GROUP BY 1, 2, 3), g AS (SELECT symbol, k, sum(l) / k AS l FROM e GROUP BY 1, 2)
 SELECT symbol, round(1 - regr_slope(ln(l + 1e-10), ln(1.0 / k)), 6) + 0.0 AS "FracDim" FROM g GROUP BY 1""")(lambda spark, d: rounded(Z.higuchi(hourly(spark, d)), keys=("symbol",)))
query("detrended_fluctuation", f"""WITH {FIXTURE}, y AS (SELECT symbol, rn, n, sum(c) OVER {RUN} AS y FROM (SELECT *, count(*) OVER {ALL} AS n, close - avg(close) OVER {ALL} AS c FROM s0)),
 e AS (SELECT symbol, w, rn // w AS s, sqrt(greatest(var_pop(y) * (1 - coalesce(pow(corr(y, rn), 2), 1)), 0)) AS f FROM y, (SELECT unnest([10, 20, 50, 100]) AS w) WHERE w < n AND (rn // w) * w < n - w GROUP BY 1, 2, 3),
 g AS (SELECT symbol, w, avg(f) AS f FROM e GROUP BY 1, 2) SELECT symbol, round(regr_slope(ln(f + 1e-10), ln(w + 1e-10)), 5) + 0.0 AS "DFA" FROM g GROUP BY 1""")(lambda spark, d: rounded(Z.dfa(hourly(spark, d)), digits=5, keys=("symbol",)))
_near = "abs(a.x0 - b.x0) <= 0.2 AND abs(a.x1 - b.x1) <= 0.2"
query("entropies", f"""WITH {FIXTURE}, x AS (SELECT symbol, rn, count(*) OVER {ALL} AS n, close AS x0, lead(close) OVER ({'PARTITION BY symbol ORDER BY ts'}) AS x1, lead(close, 2) OVER (PARTITION BY symbol ORDER BY ts) AS x2 FROM s0),
 c2 AS (SELECT a.symbol, a.rn, any_value(a.n) AS n, count(*) AS k, count(*) FILTER (a.rn < a.n - 2 AND b.rn < b.n - 2) AS k0 FROM x a JOIN x b ON b.symbol = a.symbol AND {_near} WHERE a.x1 IS NOT NULL AND b.x1 IS NOT NULL GROUP BY 1, 2),
 c3 AS (SELECT a.symbol, a.rn, any_value(a.n) AS n, count(*) AS k, count(*) FILTER (a.rn < a.n - 3 AND b.rn < b.n - 3) AS k0 FROM x a JOIN x b ON b.symbol = a.symbol AND {_near} AND abs(a.x2 - b.x2) <= 0.2 WHERE a.x2 IS NOT NULL AND b.x2 IS NOT NULL GROUP BY 1, 2),
 p2 AS (SELECT symbol, avg(ln(k / (n - 1.0) + 1e-10)) AS phi, sum(k0) - (any_value(n) - 2) AS pairs FROM c2 GROUP BY 1), p3 AS (SELECT symbol, avg(ln(k / (n - 2.0) + 1e-10)) AS phi, sum(k0) - (any_value(n) - 3) AS pairs FROM c3 GROUP BY 1),
 d AS (SELECT a.symbol, a.rn, any_value(a.n) AS n, min(sqrt(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2))) AS d FROM x a JOIN x b ON b.symbol = a.symbol AND b.rn <> a.rn WHERE a.rn < 200 AND a.x1 IS NOT NULL AND b.x1 IS NOT NULL GROUP BY 1, 2),
 g AS (SELECT symbol, CASE WHEN any_value(n) >= 202 THEN avg(ln(d + 1e-10)) / 200 END AS l FROM d GROUP BY 1)
 SELECT p2.symbol, round(p2.phi - p3.phi, 6) + 0.0 AS "ApEn", round(-ln((p3.pairs + 1e-10) / (p2.pairs + 1e-10)), 6) + 0.0 AS "SampEn", round(g.l, 6) + 0.0 AS "Lyap" FROM p2 JOIN p3 USING (symbol) JOIN g USING (symbol)""")(
    lambda spark, d: rounded(Z.pair_scalars(hourly(spark, d)), keys=("symbol",)))

# ---- labels and splits
query("weighted_labels", psql(out={"hmm_label": "t / (1 + p_bull)", "cluster_label": f"t * p_bear / (max(p_bear) OVER {ALL} + 1e-10)"}))(
    lambda spark, d: rounded(L.stability_weighted(L.entropy_weighted(preds(spark, d), "true", "p_bull"), "true", "p_bear"), ["hmm_label", "cluster_label"]))
query("split_timeline", f"SELECT split_id, role, min(row_id) AS from_row, max(row_id) AS to_row FROM (SELECT *, row_id - row_number() OVER (PARTITION BY split_id, role ORDER BY row_id) AS run FROM ({ORACLES['kfold_purged']})) GROUP BY split_id, role, run")(
    lambda spark, d: C.timeline(_split(spark, C.purged_kfold(_rows(spark, d), 6, 10))))
query("uncorrelated_features", sql(
    out={"place": "place"}, keys=("feature",), source="(SELECT unnest(['close', 'open', 'volume']) AS feature, unnest([1, 2, 3]) AS place, unnest([true, NOT a, NOT b AND (a OR NOT c)]) AS kept FROM (SELECT abs(corr(close, open)) > 0.95 AS a, abs(corr(close, volume)) > 0.95 AS b, abs(corr(open, volume)) > 0.95 AS c FROM s0))", where="WHERE kept"))(
    lambda spark, d: rounded(spark.createDataFrame([(f, ["close", "open", "volume"].index(f) + 1) for f in E.uncorrelated(hourly(spark, d), ["close", "open", "volume"])], "feature string, place int"), ["place"], keys=("feature",)))

# ---- signals that other columns allow or size, and their backtests


def _allowed(spark: SparkSession, d: str) -> DataFrame:
    rows = P.agreement_filter(P.signals(preds(spark, d)), "signal_net", "pred")
    return P.regime_size(rows, "signal_net", "fold", {0: 1.5, 1: 1.0, 2: 0.5, 3: 0.0})


_size = "CASE fold WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.0 ELSE 1.0 END"
_agreed = (*_sig, {"s": "CASE WHEN sign(signal_net) = sign(pred) THEN signal_net ELSE 0 END"}, {"sized": f"s * {_size}"})
query("filtered_sized_signals", psql(*_agreed, out={"signal_net": "s", "signal_net_sized": "sized"}))(lambda spark, d: rounded(_allowed(spark, d), ["signal_net", "signal_net_sized"]))


def _meta_backtest(spark: SparkSession, d: str) -> DataFrame:
    """A signal kept where its meta probability is over a half, with its own size and cost."""
    rows = P.signals(preds(spark, d)).withColumn("kept", F.when(F.greatest("p_bear", "p_neutral", "p_bull") > 0.45, F.col("signal_direct")).otherwise(0))
    return P.backtest(P.with_market(rows, hourly(spark, d)), "kept", "meta", size=2.0, cost=10.0)


def _traded(signal: str, size: float, cost: float) -> tuple[dict[str, str], ...]:
    return {"sig": signal, "returns": f"coalesce({RET['r']}, 0)"}, {"ex": f"coalesce({lag('sig')}, 0)"}, {"tr": f"abs(coalesce(ex - {lag('ex')}, 0))"}, {"pn": f"ex * {size} * returns * close * 20 - tr * {cost}"}, {"eq": f"sum(pn) OVER {RUN}"}, {"dd": f"eq - max(eq) OVER {RUN}"}


query("meta_backtest", psql(*_sig, *_traded("CASE WHEN best > 0.45 THEN pred ELSE 0 END", 2.0, 10.0), out={"meta_exec": "ex", "meta_pnl_net": "pn", "meta_equity": "eq", "meta_drawdown": "dd"}, digits=4))(
    lambda spark, d: rounded(_meta_backtest(spark, d), ["meta_exec", "meta_pnl_net", "meta_equity", "meta_drawdown"], 4))


def _ensemble_backtest(spark: SparkSession, d: str) -> DataFrame:
    """The sign of the sum of three signals."""
    rows = P.signals(preds(spark, d))
    rows = L.ensemble_sources(rows, ["signal_direct", "signal_thresh", "signal_net"])
    return P.backtest(P.with_market(rows, hourly(spark, d)), "ensemble_vote", "ensemble", cost=15.0)


query("ensemble_backtest", psql(*_sig, *_traded("sign(signal_direct + signal_thresh + signal_net)", 1.0, 15.0), out={"ensemble_exec": "ex", "ensemble_pnl_net": "pn", "ensemble_equity": "eq"}, digits=4))(
    lambda spark, d: rounded(_ensemble_backtest(spark, d), ["ensemble_exec", "ensemble_pnl_net", "ensemble_equity"], 4))
query("label_ranking", psql(
    out={"mean_rank": "avg(k)"}, keys=("label",), source="""(SELECT label, rank() OVER (PARTITION BY metric ORDER BY v DESC) AS k FROM (
      SELECT unnest(['pred', 'pred', 'up', 'up']) AS label, unnest(['accuracy', 'corr', 'accuracy', 'corr']) AS metric, unnest([a, b, c, e]) AS v FROM (SELECT avg(CASE WHEN pred = t THEN 1.0 ELSE 0 END) AS a, corr(pred, t) AS b, avg(CASE WHEN 1 = t THEN 1.0 ELSE 0 END) AS c, corr(p_bull, t) AS e FROM s4)))""", where="GROUP BY label"))(
    lambda spark, d: rounded(_label_ranking(spark, d), ["mean_rank"], keys=("label",)))


def _label_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Two ways to predict, ranked by each figure; the mean of the ranks decides."""
    from pyspark.sql import Window

    one = preds(spark, d).agg(F.avg((F.col("pred") == F.col("true")).cast("double")).alias("a"), F.corr("pred", "true").alias("b"), F.avg((F.col("true") == 1).cast("double")).alias("c"), F.corr("p_bull", "true").alias("e"))
    cells = [("pred", "accuracy", "a"), ("pred", "corr", "b"), ("up", "accuracy", "c"), ("up", "corr", "e")]
    long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(m).alias("metric"), F.col(c).alias("v")) for n, m, c in cells])).alias("x")).select("x.*")
    ranked = long.withColumn("k", F.rank().over(Window.partitionBy("metric").orderBy(F.desc("v"))))
    return ranked.groupBy("label").agg(F.avg("k").alias("mean_rank"))



