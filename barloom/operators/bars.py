"""From ticks to clean bars: buckets, contract roll, back-adjustment, filters, gap inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import by_symbol, col, median

#: fixed values: delivery month letters of futures codes
MONTH_CODES = "FGHJKMNQUVXZ"


def bars_of(ticks: DataFrame, interval: str = "1 hour", price: Column | str = "price", symbol: str = "symbol", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Open, high, low, close and count of each bucket; empty buckets are absent."""
    p, by = col(price), F.struct(*order)
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), F.window("ts", interval)["start"].alias("ts"))
        .agg(F.min_by(p, by).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, by).alias("close"), F.count("*").alias("volume"))
    )


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Coarser bars: first, max, min, last, sum of each bucket."""
    return (
        bars.groupBy("symbol", F.window("ts", interval)["start"].alias("bucket"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("bucket", "ts")
    )


def keep_first(rows: DataFrame, order: str) -> DataFrame:
    """One row for each (symbol, ts): the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(order))
    return rows.withColumn("__k", rank).where("__k = 1").drop("__k")


def drop_incomplete(rows: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    return rows.na.drop(subset=list(columns))


def to_utc(rows: DataFrame, zone: str) -> DataFrame:
    return rows.withColumn("ts", F.to_timestamp_ntz(F.to_utc_timestamp(F.col("ts").cast("timestamp"), zone).cast("string")))


def in_session(rows: DataFrame, start: int = 14 * 60 + 30, end: int = 21 * 60) -> DataFrame:
    """Bars whose minute of the day is in [start, end]."""
    return rows.where((F.hour("ts") * 60 + F.minute("ts")).between(start, end))


def spike_filter(bars: DataFrame, w: int = 50, times: float = 10.0) -> DataFrame:
    """Keep |close - median| < times * median of that deviation; rows before two full windows go."""
    away = bars.withColumn("__d", F.abs(F.col("close") - median("close", w)))
    return away.withColumn("__m", median("__d", w)).where(F.col("__d") < times * F.col("__m")).drop("__d", "__m")


def returns(bars: DataFrame) -> DataFrame:
    """Simple and log returns, 0 on the first bar."""
    last = F.lag("close").over(by_symbol())
    return bars.withColumns({"ret": F.coalesce(F.try_divide(F.col("close"), last) - 1, F.lit(0.0)), "logret": F.coalesce(F.log(F.try_divide(F.col("close"), last)), F.lit(0.0))})


def gap_profile(bars: DataFrame, cut: float = 4.0) -> DataFrame:
    """Of the seconds between bars: mode, median, mean, spread, and whether the series is regular.

    A second pair of figures leaves out gaps over ``cut`` times the mode (nights, weekends).
    """
    gaps = bars.select("symbol", F.expr("timestampdiff(SECOND, lag(ts) over (partition by symbol order by ts), ts)").alias("gap")).where("gap is not null")
    mode = gaps.groupBy("symbol").agg(F.mode("gap", True).alias("mode_gap"))
    inner = F.when(F.col("gap") <= cut * F.col("mode_gap"), F.col("gap"))
    out = gaps.join(F.broadcast(mode), "symbol").groupBy("symbol").agg(
        F.first("mode_gap").alias("mode_gap"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.avg("gap").alias("mean_gap"),
        (F.stddev_samp("gap") / F.avg("gap")).alias("cv"), (F.stddev_samp(inner) / F.avg(inner)).alias("cv_inner"), F.count(inner).alias("n_inner"), F.count("*").alias("n_gaps"),
    )
    return out.withColumn("regular", F.coalesce(F.col("cv") < 0.1, F.lit(False))).withColumn("regular_inner", F.coalesce(F.col("cv_inner") < 0.1, F.lit(False)))


def parse_code(code: Column | str, root_length: int = 2) -> Column:
    """Contract code to year * 100 + month; one-digit years belong to 2020-2029."""
    c = col(code)
    month = F.instr(F.lit(MONTH_CODES), c.substr(root_length + 1, 1))
    year = F.try_to_number(F.substring(c, root_length + 2, 2), F.lit("99")).cast("int")
    return F.when(month > 0, F.when(F.length(c) == root_length + 2, year + 2020).otherwise(year + 2000) * 100 + month)


def root_of(code: Column | str, root_length: int = 2) -> Column:
    return F.substring(col(code), 1, root_length)


def front_contracts(minutes: DataFrame, expiry: Column, root: Column | None = None) -> DataFrame:
    """(root, day, symbol, expiry): of each root each day's contract with most volume, never going back to an earlier expiry.

    Of contracts with equal volume the first by name leads. The running step is over days of
    one root, of which there is one row each, so it stays small at any number of bars.
    """
    root = root_of("symbol") if root is None else root
    daily = minutes.groupBy(root.alias("root"), F.to_date("ts").alias("day"), "symbol").agg(F.sum("volume").alias("v"), F.max(expiry).alias("expiry"))
    top = daily.groupBy("root", "day").agg(F.min(F.struct((-F.col("v")).alias("v"), "symbol", "expiry")).alias("top"))
    order = Window.partitionBy("root").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    held = top.select("root", "day", F.max(F.struct("top.expiry", "top.symbol")).over(order).alias("held"))
    return held.select("root", "day", F.col("held.symbol").alias("symbol"), F.col("held.expiry").alias("expiry"))


def roll_factors(minutes: DataFrame, front: DataFrame) -> DataFrame:
    """(root, day, symbol, factor): price ratio at each roll (last common time of the day before, else of the roll day, else 1), chained from the newest back."""
    order = Window.partitionBy("root").orderBy("day")
    rolls = front.withColumns({"old": F.lag("symbol").over(order), "old_day": F.lag("day").over(order)}).where("old is not null and old <> symbol")
    bars = minutes.select("symbol", "ts", "close", F.to_date("ts").alias("bar_day"))
    pairs = (
        rolls.alias("r").join(bars.alias("a"), (F.col("a.symbol") == F.col("r.old")) & F.col("a.bar_day").isin(F.col("r.day"), F.col("r.old_day")))
        .join(bars.alias("b"), (F.col("b.symbol") == F.col("r.symbol")) & (F.col("b.ts") == F.col("a.ts")))
        .groupBy(F.col("r.root").alias("root"), F.col("r.day").alias("day"))
        .agg(F.max_by(F.try_divide("b.close", "a.close"), F.struct(F.col("a.bar_day") == F.col("r.old_day"), F.col("a.ts"))).alias("ratio"))
    )
    newest_first = Window.partitionBy("root").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    steps = front.join(pairs, ["root", "day"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    return steps.select("root", "day", "symbol", "expiry", F.coalesce(F.product("ratio").over(newest_first), F.lit(1.0)).alias("factor"))


def back_adjust(minutes: DataFrame, factors: DataFrame) -> DataFrame:
    """The front contract's bars of each day, prices times the day's factor."""
    held = minutes.withColumn("day", F.to_date("ts")).join(F.broadcast(factors.select("day", "symbol", "factor")), ["day", "symbol"])
    return held.select("symbol", "ts", *[(F.col(c) * F.col("factor")).alias(c) for c in ("open", "high", "low", "close")], "volume", "factor")


def daily_with_gaps(rows: DataFrame, value: str, key: str = "symbol") -> DataFrame:
    """Daily sums of ``value`` with a 0 for days without rows."""
    sums = rows.groupBy(key, F.to_date("ts").alias("day")).agg(F.sum(value).alias(value))
    spine = sums.groupBy(key).agg(F.min("day").alias("a"), F.max("day").alias("b")).select(key, F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(sums, [key, "day"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def contract_problems(bars: DataFrame) -> DataFrame:
    """One row of counts that are all zero for a valid bar table: null times, repeated keys, prices out of order."""
    return bars.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("ts").isNull()).alias("n_null_ts"), (F.count("*") - F.count_distinct("symbol", "ts")).alias("n_repeated"),
        F.count_if((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).alias("n_disordered"),
    )


def in_chunks(bars: DataFrame, chunk: int, halo: int) -> DataFrame:
    """Cut each series into chunks of ``chunk`` bars, each with the ``halo`` bars before it.

    Adds ``__chunk`` and ``__own``. Finite windows partitioned by (symbol, __chunk) are then
    right on the rows with ``__own``, and one long series runs on many tasks. Numbering rows
    needs one pass in order; it shuffles keys and times only where the planner prunes.
    """
    numbered = bars.withColumn("__rn", F.row_number().over(by_symbol()) - 1)
    home = F.floor(F.col("__rn") / chunk).cast("long")
    reach = F.floor((F.col("__rn") + halo) / chunk).cast("long")
    return numbered.withColumn("__chunk", F.explode(F.sequence(home, reach))).withColumn("__own", F.col("__chunk") == home).drop("__rn")
