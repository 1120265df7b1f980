"""Bars and recurrent features over a stream: watermarked tumbling windows, EMA and RSI held as state, with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.rolling import EPS


def tick_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of ticks as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_bars(ticks: DataFrame, interval: str = "1 hour", late: str = "10 minutes", price: str = "price") -> DataFrame:
    """Tumbling bars; ticks later than ``late`` behind the newest are dropped. ``ts`` must be a timestamp."""
    order = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", late).groupBy(F.window("ts", interval).alias("w"), "symbol")
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def stream_ema(bars: DataFrame, span: int = 20) -> DataFrame:
    """EMA of closes by symbol; the state is one number a symbol. Rows of a batch are taken in order of time."""
    a = 2.0 / (span + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for close in rows["close"]:
            last = float(close) if last is None else a * float(close) + (1 - a) * last
            out.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"].to_numpy(), "close": rows["close"].to_numpy(), "ema": out})

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, close double, ema double", "last double", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there and return the memory table; for tests and small replays."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return stream.sparkSession.table(name)


STATE = "seen long, ema double, close double, gain double, loss double, ts timestamp, late long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Indicators(StatefulProcessor):
    """EMA and Wilder's RSI of one symbol: one row of state, however long the series.

    Rows of a batch are taken in order of time. A row at or before the newest one taken is late: it is
    counted, not used. A symbol that is idle for ``idle_hours`` behind the watermark loses its
    state by a timer, and starts anew if it comes back.
    """

    def __init__(self, span: int, w: int, idle_hours: int):
        self.keep, self.w, self.idle = 1 - 2.0 / (span + 1), w, idle_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, ema, before, gain, loss, newest, late = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0.0, 0.0, None, 0)
        frame, out = pd.concat(list(rows)).sort_values("ts", kind="stable"), []
        for ts, close in zip(frame["ts"], frame["close"].astype(float), strict=True):
            if newest is not None and ts <= pd.Timestamp(newest):
                late += 1
                continue
            ema = close if not seen else self.keep * ema + (1 - self.keep) * close
            up, down = (max(close - before, 0.0), max(before - close, 0.0)) if seen else (0.0, 0.0)
            if 0 < seen <= self.w:  # the seed is the mean of the first moves
                gain, loss = gain + up / self.w, loss + down / self.w
            elif seen:
                gain, loss = (gain * (self.w - 1) + up) / self.w, (loss * (self.w - 1) + down) / self.w
            out.append((key[0], ts, close, ema, 100 - 100 / (1 + gain / (loss + EPS)) if seen >= self.w else None))
            seen, before, newest = seen + 1, close, ts
        self.state.update((seen, ema, before, gain, loss, pd.Timestamp(newest).to_pydatetime(), late))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(newest).timestamp() * 1000) + self.idle)
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "ema", "rsi"]).assign(late=late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame, span: int = 20, w: int = 14, late: str = "1 day", idle_hours: int = 24 * 14) -> DataFrame:
    """(symbol, ts, close, ema, rsi, late) of a stream of bars; ``late`` is the count of late rows of the symbol so far.

    Needs the RocksDB state store (``rocks``), and a timestamp ``ts``.
    """
    return bars.withWatermark("ts", late).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=Indicators(span, w, idle_hours), outputStructType="symbol string, ts timestamp, close double, ema double, rsi double, late long", outputMode="Append", timeMode="EventTime")


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Process what is there into Parquet files under ``folder``, with the checkpoint beside them, and read them back."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
