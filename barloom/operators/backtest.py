"""Signals, execution, costs, equity and risk figures, and strategy comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import before, kurtosis_adjusted, running, skew_adjusted
from .bars import daily_with_gaps

POINT_VALUE, COST = 20.0, 27.5


def signals(preds: DataFrame, prob_cut: float = 0.5, net_cut: float = 0.25) -> DataFrame:
    """signal_direct, signal_thresh (the likeliest class if its probability is over the cut and it isn't 0) and signal_net; needs pred, p_bear, p_neutral, p_bull.

    Equal probabilities go to the first of bear, neutral, bull.
    """
    top = F.greatest("p_bear", "p_neutral", "p_bull")
    best = F.when(F.col("p_bear") == top, -1).when(F.col("p_neutral") == top, 0).otherwise(1)
    rows = preds.withColumn("net_prob", F.col("p_bull") - F.col("p_bear"))
    return rows.withColumns({
        "signal_direct": F.col("pred"), "signal_thresh": F.when((top > prob_cut) & (best != 0), best).otherwise(0),
        "signal_net": F.when(F.col("net_prob") > net_cut, 1).when(F.col("net_prob") < -net_cut, -1).otherwise(0),
    })


def with_market(preds: DataFrame, bars: DataFrame) -> DataFrame:
    """Join returns (0 if missing) and prices (the last one known) at the predictions' times."""
    rows = bars.select("symbol", "ts", F.col("close").alias("price"), F.coalesce(F.try_divide(F.col("close"), before("close")) - 1, F.lit(0.0)).alias("returns"))
    joined = preds.join(rows, ["symbol", "ts"], "left").withColumn("returns", F.coalesce("returns", F.lit(0.0)))
    return joined.withColumn("price", F.last("price", True).over(running()))


def backtest(rows: DataFrame, signal: str, name: str, size: float = 1.0, point: float = POINT_VALUE, cost: float = COST) -> DataFrame:
    """A bar's signal is executed on the next bar. Adds <name>_exec, position, pnl, trade, cost, pnl_net, equity, drawdown."""
    def c(part: str) -> Column:
        return F.col(f"{name}_{part}")

    rows = rows.withColumn(f"{name}_exec", F.coalesce(before(signal), F.lit(0)).cast("double"))
    rows = rows.withColumns({f"{name}_position": c("exec") * size, f"{name}_trade": F.abs(F.coalesce(c("exec") - before(f"{name}_exec"), F.lit(0.0)))})
    rows = rows.withColumns({f"{name}_pnl": c("position") * F.col("returns") * F.col("price") * point, f"{name}_cost": c("trade") * cost})
    rows = rows.withColumn(f"{name}_pnl_net", c("pnl") - c("cost")).withColumn(f"{name}_equity", F.sum(c("pnl_net")).over(running()))
    return rows.withColumn(f"{name}_drawdown", c("equity") - F.max(c("equity")).over(running()))


def agreement_filter(rows: DataFrame, signal: str, label: str) -> DataFrame:
    """The signal where the label agrees with it, else 0."""
    return rows.withColumn(signal, F.when(F.signum(signal) == F.signum(label), F.col(signal)).otherwise(0))


def regime_size(rows: DataFrame, signal: str, regime: str, sizes: dict[int, float]) -> DataFrame:
    """Signal times the regime's size (1 if not listed)."""
    table = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))])
    return rows.withColumn(f"{signal}_sized", F.col(signal) * F.coalesce(F.try_element_at(table, F.col(regime).cast("int")), F.lit(1.0)))


def daily_pnl(rows: DataFrame, pnl: str) -> DataFrame:
    return daily_with_gaps(rows, pnl)


def _ratio(mean: Column, spread: Column, eps: float = 0.0) -> Column:
    if eps:
        return math.sqrt(252) * mean / (spread + eps)
    return F.when(spread.isNotNull() & (spread != 0), math.sqrt(252) * mean / spread).otherwise(0.0)


def risk_metrics(rows: DataFrame, name: str) -> DataFrame:
    """(symbol, total_pnl, sharpe, sortino, max_drawdown, win_rate, n_trades); ratios over daily sums, days without bars counting 0."""
    pnl = f"{name}_pnl_net"
    daily = daily_pnl(rows, pnl).groupBy("symbol").agg(
        _ratio(F.avg(pnl), F.stddev_samp(pnl)).alias("sharpe"), _ratio(F.avg(pnl), F.stddev_samp(F.when(F.col(pnl) < 0, F.col(pnl)))).alias("sortino"),
    )
    plain = rows.groupBy("symbol").agg(
        F.sum(pnl).alias("total_pnl"), F.min(f"{name}_drawdown").alias("max_drawdown"), F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate"), F.sum(f"{name}_trade").alias("n_trades"),
    )
    return plain.join(daily, "symbol")


def rolling_sharpe(daily: DataFrame, pnl: str, days: int = 20, least: int = 5) -> DataFrame:
    """Over at most ``days`` days, of which ``least`` must be there."""
    frame = Window.partitionBy("symbol").orderBy("day").rowsBetween(-(days - 1), 0)
    sharpe = math.sqrt(252) * F.avg(pnl).over(frame) / (F.stddev_samp(pnl).over(frame) + 1e-9)
    return daily.withColumn("rolling_sharpe", F.when(F.count(pnl).over(frame) >= least, sharpe))


def period_pnl(daily: DataFrame, pnl: str, period: str = "week") -> DataFrame:
    """Sums by week (named by its Sunday) or month (by its last day)."""
    end = F.date_add(F.trunc("day", "week"), 6) if period == "week" else F.last_day("day")
    return daily.groupBy("symbol", end.alias("period_end")).agg(F.sum(pnl).alias(pnl))


def regime_pnl(rows: DataFrame, pnl: str, regime: str) -> DataFrame:
    """Of each regime: pnl, share of days, win rate, profit factor (mean win over mean loss), Sharpe of its days, worst drawdown inside it."""
    daily = rows.groupBy("symbol", regime, F.to_date("ts").alias("day")).agg(F.sum(pnl).alias("p"))
    inside = Window.partitionBy("symbol", regime).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("equity", F.sum("p").over(inside)).withColumn("dd", F.col("equity") - F.max("equity").over(inside))
    p = F.col("p")
    return daily.groupBy("symbol", regime).agg(
        F.sum(p).alias("total_pnl"), F.count("*").alias("n_days"), F.avg((p > 0).cast("double")).alias("win_rate"),
        F.try_divide(F.avg(F.when(p > 0, p)), F.abs(F.avg(F.when(p < 0, p)))).alias("profit_factor"),
        (math.sqrt(252) * F.avg(p) / (F.stddev_samp(p) + 1e-9)).alias("sharpe"), F.min("dd").alias("max_drawdown"),
    )


def vol_target(daily: DataFrame, pnl: str, target: float = 0.10) -> DataFrame:
    spread = F.stddev_samp(pnl).over(Window.partitionBy("symbol"))
    return daily.withColumn(f"{pnl}_scaled", F.col(pnl) * target / (spread * math.sqrt(252) + 1e-9))


def distribution(daily: DataFrame, pnl: str) -> DataFrame:
    n = F.count(pnl).cast("double")
    return daily.groupBy("symbol").agg(F.avg(pnl).alias("mean"), F.stddev_samp(pnl).alias("std"), skew_adjusted(F.skewness(pnl), n).alias("skew"), kurtosis_adjusted(F.kurtosis(pnl), n).alias("kurtosis"))


def exposure(rows: DataFrame, name: str) -> DataFrame:
    """Mean |position|, shares of long, short and flat bars, and trades per 365 days of the span."""
    p = F.col(f"{name}_position")
    days = F.expr("timestampdiff(SECOND, min(ts), max(ts))") / 86_400
    return rows.groupBy("symbol").agg(
        F.avg(F.abs(p)).alias("mean_exposure"), F.avg((p > 0).cast("double")).alias("share_long"), F.avg((p < 0).cast("double")).alias("share_short"), F.avg((p == 0).cast("double")).alias("share_flat"),
        F.try_divide(F.sum(f"{name}_trade"), days / 365).alias("turnover"),
    )


def rank_strategies(metrics: DataFrame, better_high: tuple[str, ...] = ("total_pnl", "sharpe", "sortino", "max_drawdown", "win_rate"), by: str = "symbol") -> DataFrame:
    """Mean over the metrics of each strategy's rank (1 best, ties share their mean), and the order it gives."""
    out = metrics
    for m in better_high:
        order, ties = Window.partitionBy(by).orderBy(F.desc(m)), Window.partitionBy(by, m)
        out = out.withColumn(f"rank_{m}", F.rank().over(order) + (F.count("*").over(ties) - 1) / 2)
    return out.withColumn("mean_rank", sum((F.col(f"rank_{m}") for m in better_high), F.lit(0.0)) / len(better_high))


def buy_and_hold(bars: DataFrame, size: float = 1.0) -> DataFrame:
    rows = bars.withColumn("ret", F.coalesce(F.try_divide(F.col("close"), before("close")) - 1, F.lit(0.0)) * size)
    return rows.withColumn("growth", F.exp(F.sum(F.log1p("ret")).over(running())))


def comparison(daily: DataFrame, strategy: str = "strategy", benchmark: str = "benchmark", periods: int = 252, share: float = 0.05) -> DataFrame:
    """Total and annualised return, Sharpe, Sortino, drawdown, Calmar, value at risk of a return series against a benchmark's; tracking error, information ratio, outperformance."""
    order = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("g", F.exp(F.sum(F.log1p(strategy)).over(order))).withColumn("dd", F.col("g") / F.greatest(F.max("g").over(order), F.lit(1.0)) - 1)
    s, b = F.col(strategy), F.col(benchmark)
    out = rows.groupBy("symbol").agg(
        (F.exp(F.sum(F.log1p(s))) - 1).alias("total_return"), (F.exp(F.sum(F.log1p(b))) - 1).alias("benchmark_return"), (F.exp(F.avg(F.log1p(s)) * periods) - 1).alias("annual_return"),
        (math.sqrt(periods) * F.try_divide(F.avg(s), F.stddev_samp(s))).alias("sharpe"), (math.sqrt(periods) * F.try_divide(F.avg(s), F.stddev_samp(F.when(s < 0, s)))).alias("sortino"),
        F.min("dd").alias("max_drawdown"), F.percentile(s, F.lit(share)).alias("value_at_risk"), (math.sqrt(periods) * F.stddev_samp(s - b)).alias("tracking_error"),
        (math.sqrt(periods) * F.try_divide(F.avg(s - b), F.stddev_samp(s - b))).alias("information_ratio"),
    )
    return out.withColumns({"calmar": F.try_divide(F.col("annual_return"), F.abs("max_drawdown")), "outperformance": F.col("total_return") - F.col("benchmark_return")})


def inference(rows: DataFrame, prob: str, up: float = 0.55, down: float = 0.45) -> DataFrame:
    p = F.col(prob)
    return rows.withColumns({"signal": F.when(p >= up, 1).when(p <= down, -1).otherwise(0), "confidence": F.abs(p - 0.5) * 2})


def drift_check(rows: DataFrame, stats: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """(feature, z, drifted): the rows' means against training means and deviations (feature, mean, std)."""
    sums = rows.agg(*[F.avg(c).alias(c) for c in columns])
    turned = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    z = (F.col("value") - F.col("mean")) / (F.col("std") + 1e-9)
    return turned.join(F.broadcast(stats), "feature").select("feature", z.alias("z"), F.coalesce(F.abs(z) > limit, F.lit(False)).alias("drifted"))


def training_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    sums = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in columns])).alias("x")).select("x.*")
