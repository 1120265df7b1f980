"""Labels: events and barriers, forward returns, multi-horizon matrices, volatility-adjusted targets, meta labels, consensus."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import first_from
from ..functions.rolling import EPS, after, before, by_symbol, count_equal, full, high, mean, running, std, trailing, whole
from ..sources.tables import written
from .scan import in_order, moments_chained

TINY = 1e-12


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# ---- events


def time_index_problems(rows: DataFrame) -> DataFrame:
    """Null and repeated times of each symbol; both 0 for a valid index."""
    return rows.groupBy("symbol").agg(F.count_if(F.col("ts").isNull()).alias("n_null"), (F.count("ts") - F.count_distinct("ts")).alias("n_repeated"))


def select_events(rows: DataFrame, min_ret: float = 0.0, vol: str | None = None, ret: str = "ret") -> DataFrame:
    """Rows whose |return| (or, given one, volatility) is over ``min_ret``."""
    return rows.where(F.col(vol) > min_ret if vol else F.abs(ret) > min_ret)


def vertical_barrier(rows: DataFrame, seconds: int, name: str = "t1") -> DataFrame:
    """First time at or after ts + seconds; NULL past the end."""
    return first_from(rows.drop(name), ("symbol",), micros(), micros() + seconds * 1_000_000, F.col("ts"), name)


def event_table(rows: DataFrame, vol: str, up: float = 1.0, down: float = 1.0) -> DataFrame:
    """(symbol, t0, t1, vol, pt, sl): needs ``t1``; events without a vertical barrier or volatility go."""
    return rows.where(F.col("t1").isNotNull() & F.col(vol).isNotNull()).select("symbol", F.col("ts").alias("t0"), "t1", F.col(vol).alias("vol"), (up * F.col(vol)).alias("pt"), (-down * F.col(vol)).alias("sl"))


def greedy(events: DataFrame, keep: Callable[[int, int | None, int | None], bool]) -> DataFrame:
    """Walk each symbol's events in order of t0; ``keep(t0, last kept t0, last kept t1)`` in microseconds decides. One task a symbol."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t0", kind="stable")
        kept, last0, last1 = [], None, None
        for i, (a, b) in enumerate(zip(frame["t0"], frame["t1"], strict=True)):
            t0 = pd.Timestamp(a).value // 1000
            if last0 is None or keep(t0, last0, last1):
                kept.append(i)
                last0, last1 = t0, None if pd.isna(b) else pd.Timestamp(b).value // 1000
        return frame.iloc[kept]

    return events.groupBy("symbol").applyInPandas(run, events.schema)


def _in_order(events: DataFrame) -> DataFrame:
    """Events with their place ``__i`` in their symbol's order of t0 (of t1 on a tie)."""
    return events.withColumn("__i", (F.row_number().over(Window.partitionBy("symbol").orderBy("t0", "t1")) - 1).cast("long"))


def follow(linked: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Rows reached from each symbol's row 0 by its links: ``linked`` has ``__i`` (0, 1, ... by symbol) and ``__j``, a later row or NULL.

    Series are cut into chunks. Where a walk that enters a chunk leaves it is found for every
    row at once, by doubling links inside the chunk. The rows at which chunks are entered
    follow by doubling over those exits, and each chunk marks its own rows from there.
    """
    links = linked.select("symbol", F.floor(F.col("__i") / chunk).alias("__c"), "__i", "__j")
    table = written(links.groupBy("symbol", "__c").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__j"))), lambda x: x["__j"]).alias("js")), "links")
    entries = table.where("__c = 0").select("symbol", F.lit(0).cast("long").alias("__i"))
    if table.where("__c > 0").limit(1).count():
        exits = written(table.mapInArrow(_exits(chunk), "symbol string, __i long, __j long").where("__j is not null"), "exits")
        known = 0
        while True:
            ahead = entries.join(exits, ["symbol", "__i"]).select("symbol", F.col("__j").alias("__i"))
            entries = written(entries.union(ahead).distinct(), "entries")
            found = entries.count()
            if found == known:
                break
            known = found
            far = exits.select("symbol", F.col("__i").alias("__j"), F.col("__j").alias("__to"))
            exits = written(exits.join(far, ["symbol", "__j"]).select("symbol", "__i", F.col("__to").alias("__j")), "exits")
    entered = table.join(entries.select("symbol", F.floor(F.col("__i") / chunk).alias("__c"), F.col("__i").alias("__e")), ["symbol", "__c"])
    kept = entered.select("symbol", "__c", "js", "__e").mapInArrow(_marked(chunk), "symbol string, __i long")
    return linked.join(kept, ["symbol", "__i"]).drop("__i", "__j")


def _local(js: pa.ListScalar, first: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's links (-1 for none), and those inside it by place, a row itself where its link leaves."""
    to = js.values.fill_null(-1).to_numpy(zero_copy_only=False)
    place = np.arange(len(to))
    return to, np.where((to >= 0) & (to < first + len(to)), to - first, place)


def _exits(chunk: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                first = batch.column(1)[r].as_py() * chunk
                to, inside = _local(batch.column(2)[r], first)
                for _ in range(len(to).bit_length()):
                    inside = inside[inside]
                out = to[inside]
                yield pa.record_batch([pa.array([batch.column(0)[r].as_py()] * len(to)), pa.array(np.arange(len(to)) + first), pa.array(out, mask=out < 0)], names=["symbol", "__i", "__j"])

    return run


def _marked(chunk: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                first, at = batch.column(1)[r].as_py() * chunk, batch.column(3)[r].as_py()
                to, _ = _local(batch.column(2)[r], first)
                kept = []
                while 0 <= at < first + len(to):
                    kept.append(at)
                    at = int(to[at - first])
                yield pa.record_batch([pa.array([batch.column(0)[r].as_py()] * len(kept)), pa.array(kept, pa.int64())], names=["symbol", "__i"])

    return run


DAY, LOOKS = 86_400_000_000, 6


def spaced(events: DataFrame, seconds: int, whole_days: bool = False, chunk: int = 100_000) -> DataFrame:
    """Keep events at least so far from the last kept one. Parity drops whole days from the distance; ``whole_days`` counts them.

    Parity looks for the next event whose distance fits within its day: each look skips a day's
    times that are too near. Symbols that need over ``LOOKS`` looks (events at one time of day, for
    days in a row) are walked one by one.
    """
    us, gap = micros("t0"), seconds * 1_000_000
    rows = _in_order(events).withColumns({"__from": us + gap, "__j": F.lit(None).cast("long")})
    if whole_days:
        found = first_from(rows.drop("__j"), ("symbol",), us, F.col("__from"), F.col("__i"), "__j")
        return follow(found.withColumn("__j", F.when(F.col("__j").isNotNull(), F.greatest("__j", F.col("__i") + 1))).drop("__from").transform(_within), chunk)
    if seconds >= 86_400:  # no distance within a day is that large
        return follow(rows.drop("__from"), chunk)
    if seconds <= 0:  # all are kept
        return events
    done = None
    for _ in range(LOOKS):
        found = first_from(rows.drop("__j"), ("symbol",), us, F.col("__from"), F.struct("__i", us.alias("t")), "__n")
        # rows that are through stay in, so that the others find them, but ask for nothing more
        found = found.withColumn("__d", F.col("__n.t") - us)
        fits = F.col("__n").isNull() | (F.pmod("__d", F.lit(DAY)) >= gap)
        found = found.withColumns({"__open": F.col("__from").isNotNull() & ~fits, "__j": F.col("__n.__i")})
        found = written(found, "spacing")
        own = found.where(F.col("__from").isNotNull() & ~F.col("__open")).select("symbol", "__i", "__j")
        done = own if done is None else done.union(own)
        if not found.where("__open").limit(1).count():
            rows = None
            break
        rows = found.withColumn("__from", F.when(F.col("__open"), us + F.floor(F.col("__d") / DAY) * DAY + gap)).select(*events.columns, "__i", "__from", F.lit(None).cast("long").alias("__j"))
    linked = _in_order(events).join(done, ["symbol", "__i"])
    if rows is None:
        return follow(linked, chunk)
    slow = rows.where(F.col("__from").isNotNull()).select("symbol").distinct()
    walked = greedy(events.join(slow, "symbol", "left_semi"), lambda t0, a, _: (t0 - a) // 1_000_000 % 86_400 >= seconds)
    return follow(linked.join(slow, "symbol", "left_anti"), chunk).unionByName(walked)


def _within(linked: DataFrame) -> DataFrame:
    """Links past a symbol's last row go."""
    last = F.max("__i").over(Window.partitionBy("symbol"))
    return linked.withColumn("__j", F.when(F.col("__j") <= last, F.col("__j")))


def without_overlap(events: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Keep events that begin no earlier than the last kept one ends; after one without an end nothing more is kept."""
    found = first_from(_in_order(events), ("symbol",), micros("t0"), micros("t1"), F.col("__i"), "__j")
    # an event that ends at its own beginning is followed by the next one
    return follow(found.withColumn("__j", F.when(F.col("__j").isNotNull(), F.greatest("__j", F.col("__i") + 1))).transform(_within), chunk)


# ---- barriers


def barrier_outcomes(events: DataFrame, bars: DataFrame, first_touch: bool = False, strict: bool = False, bin_seconds: int = 86_400) -> DataFrame:
    """(symbol, t0, t1, t_end, label, ret, pt, sl) for each event.

    The path t0..t1 is an interval join, planned as an equi-join: an event is listed under
    every time bin it spans, a bar under its own. Parity: any touch of the profit barrier
    wins over an earlier stop; ``first_touch`` takes whichever came first. ``strict``
    needs a barrier to be passed. Without a touch the label is the sign of the last return.
    """
    def time_bin(c: Column) -> Column:
        return F.floor(F.unix_seconds(c.cast("timestamp")) / bin_seconds)

    paths = bars.select("symbol", "ts", "close", time_bin(F.col("ts")).alias("bin"))
    # the price at t0 belongs to the bar of that very time
    starts = events.join(bars.select("symbol", F.col("ts").alias("t0"), F.col("close").alias("p0")), ["symbol", "t0"])
    spread = starts.withColumn("bin", F.explode(F.sequence(time_bin(F.col("t0")), time_bin(F.col("t1")))))
    met = spread.join(paths, ["symbol", "bin"]).where(F.col("ts").between(F.col("t0"), F.col("t1")))
    ret = F.try_divide(F.col("close"), F.col("p0")) - 1
    up = ret > F.col("pt") if strict else ret >= F.col("pt")
    down = ret < F.col("sl") if strict else ret <= F.col("sl")
    out = met.groupBy("symbol", "t0", "t1").agg(
        F.min(F.when(up, F.col("ts"))).alias("t_pt"), F.min(F.when(down, F.col("ts"))).alias("t_sl"), F.max("ts").alias("t_last"),
        F.min_by(F.when(up, ret), F.when(up, F.col("ts"))).alias("r_pt"), F.min_by(F.when(down, ret), F.when(down, F.col("ts"))).alias("r_sl"), F.max_by(ret, "ts").alias("r_last"),
        F.first("pt").alias("pt"), F.first("sl").alias("sl"),
    )
    wins = F.col("t_pt").isNotNull()
    if first_touch:
        wins = wins & (F.col("t_sl").isNull() | (F.col("t_pt") <= F.col("t_sl")))
    stop = F.col("t_sl").isNotNull()
    return out.select(
        "symbol", "t0", "t1", F.when(wins, F.col("t_pt")).when(stop, F.col("t_sl")).otherwise(F.col("t_last")).alias("t_end"),
        F.when(wins, F.lit(1.0)).when(stop, F.lit(-1.0)).otherwise(F.signum("r_last")).alias("label"),
        F.when(wins, F.col("r_pt")).when(stop, F.col("r_sl")).otherwise(F.col("r_last")).alias("ret"), "pt", "sl",
    )


def attach(bars: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes at their bars; bars without one have label 0."""
    found = outcomes.select("symbol", F.col("t0").alias("ts"), "t_end", "label", F.col("ret").alias("event_ret"))
    return bars.join(found, ["symbol", "ts"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


def triple_barrier(bars: DataFrame, horizon_seconds: int, up: float = 1.0, down: float = 1.0, span: int = 100, min_ret: float = 0.0, first_touch: bool = False) -> DataFrame:
    """The whole workflow: ewm volatility, events, vertical barriers, outcomes, labels at the bars."""
    rows = bars.withColumn("ret", F.try_divide(F.col("close"), before("close")) - 1)
    rows = moments_chained(in_order(rows), {"vol": ("ret", span)}).drop("__rn").transform(vertical_barrier, horizon_seconds)
    events = event_table(select_events(rows, min_ret, "vol"), "vol", up, down)
    return attach(bars, barrier_outcomes(events, bars, first_touch))


def with_side(rows: DataFrame, side: str) -> DataFrame:
    return rows.withColumn("dir_label", F.col("label") * F.col(side))


# ---- label volatilities (no floors: a negative variance is NULL)


def _root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def label_vols(bars: DataFrame, w: int = 30, span: int = 100, chunk: int = 100_000) -> DataFrame:
    """vol_ewma, vol_parkinson, vol_garman_klass, vol_rogers_satchell, vol_yang_zhang, vol_return."""
    h, lo, c, o = (F.col(n) for n in ("high", "low", "close", "open"))
    rs = F.log(h / c) * F.log(h / o) + F.log(lo / c) * F.log(lo / o)
    rows = bars.withColumns({
        "__ret": F.try_divide(c, before("close")) - 1, "__pk": F.pow(F.log(h / lo), F.lit(2)) / (4 * np.log(2)), "__rs": rs, "__on": F.log(o / before("close")), "__oc": F.log(c / o),
        "__gk": 0.5 * F.pow(F.log(h / lo), F.lit(2)) - (2 * np.log(2) - 1) * F.pow(F.log(c / o), F.lit(2)),
    })
    rows = moments_chained(in_order(rows), {"vol_ewma": ("__ret", span)}, chunk).drop("__rn")
    frame = trailing(w)
    spread = full(F.var_samp("__on").over(frame), "__on", frame, w) + full(F.var_samp("__oc").over(frame), "__oc", frame, w)
    return rows.withColumns({
        "vol_parkinson": _root(mean("__pk", w)), "vol_garman_klass": _root(mean("__gk", w)), "vol_rogers_satchell": _root(mean("__rs", w)),
        "vol_yang_zhang": _root(spread + mean("__rs", w)), "vol_return": std("__ret", w),
    }).drop("__ret", "__pk", "__rs", "__on", "__oc", "__gk")


def quantile_regime(rows: DataFrame, x: str, bins: int = 4, name: str = "vol_regime") -> DataFrame:
    """Quantile bin 0..bins-1 of the series, edges closed on the right."""
    edges = [F.percentile(x, F.lit(i / bins)).over(whole()) for i in range(1, bins)]
    out = F.when(F.col(x).isNull(), None)
    for i, edge in enumerate(edges):
        out = out.when(F.col(x) <= edge, i)
    return rows.withColumn(name, out.otherwise(bins - 1))


# ---- forward returns


def forward_return(h: int, x: str = "close", log: bool = False) -> Column:
    ratio = F.try_divide(after(x, h), F.col(x))
    return F.log(ratio) if log else ratio - 1


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20), log: bool = False) -> DataFrame:
    kind = "fwd_ret_log" if log else "fwd_ret"
    return bars.withColumns({f"{kind}_{h}": forward_return(h, log=log) for h in horizons})


def excess_return(rows: DataFrame, h: int, benchmark: str) -> DataFrame:
    return rows.withColumn(f"excess_ret_{h}", forward_return(h) - forward_return(h, benchmark))


def rolling_forward(bars: DataFrame, last: int = 60) -> DataFrame:
    return bars.withColumns({f"fwd_{h}": forward_return(h) for h in range(1, last + 1)})


def direction(x: Column) -> Column:
    return F.coalesce(F.signum(x), F.lit(0.0))


def trim(rows: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Without the last max(h) rows of each series, whose labels look past its end."""
    left = F.count(F.lit(1)).over(whole()) - F.row_number().over(by_symbol())
    return rows.withColumn("__left", left).where(F.col("__left") >= max(horizons)).drop("__left")


def horizon_matrix(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """ret_h and dir_h for each horizon, and both stacked as arrays."""
    rows = bars.withColumns({f"ret_{h}": forward_return(h) for h in horizons})
    rows = rows.withColumns({f"dir_{h}": direction(F.col(f"ret_{h}")) for h in horizons})
    return rows.withColumns({"ret_stack": F.array(*[f"ret_{h}" for h in horizons]), "dir_stack": F.array(*[f"dir_{h}" for h in horizons])})


def consensus(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sign of the sum of the directions, and the share of the commonest one (the smallest on a tie)."""
    value = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    votes = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    most = F.greatest(*[count_equal(votes, s) for s in (-1.0, 0.0, 1.0)])
    return rows.withColumns({"horizon_consensus": F.signum(value), "horizon_agreement": most / len(columns)})


# ---- volatility-adjusted targets


def vol_adjusted(bars: DataFrame, h: int = 20, vol_window: int = 20, lookback: int = 100, cut: float = 0.5) -> DataFrame:
    """vol_norm_ret, zscore_ret, risk_adj_dir (beyond ±cut, unknown 0), svr_target and dd_adj_ret (less the deepest drawdown of the last h bars)."""
    rows = bars.withColumn("__r", F.try_divide(F.col("close"), before("close")) - 1).withColumn("__f", forward_return(h))
    rows = rows.withColumns({"vol_norm_ret": F.col("__f") / (std("__r", vol_window) + TINY), "__d": F.try_divide(F.max("close").over(running()) - F.col("close"), F.col("close"))})
    return rows.withColumns({
        "zscore_ret": (F.col("__f") - mean("__f", lookback)) / (std("__f", lookback) + TINY),
        "risk_adj_dir": F.when(F.col("vol_norm_ret") > cut, 1).when(F.col("vol_norm_ret") < -cut, -1).otherwise(0),
        "svr_target": F.col("vol_norm_ret"), "dd_adj_ret": F.col("__f") - high("__d", h),
    }).drop("__r", "__f", "__d")


def trend_label(rows: DataFrame, h: int = 20, name: str = "trend_label") -> DataFrame:
    """Sign of the return over the next h bars; NULL where it is unknown."""
    return rows.withColumn(name, F.signum(forward_return(h)))


def vol_trend_label(rows: DataFrame, h: int = 20, vol_window: int = 20, name: str = "vol_trend_label") -> DataFrame:
    rows = rows.withColumn("__r", F.try_divide(F.col("close"), before("close")) - 1)
    return rows.withColumn(name, F.signum(forward_return(h) / (std("__r", vol_window) + EPS))).drop("__r")


def regime_label(rows: DataFrame, regime: str = "TrendRegClass_3", h: int = 20) -> DataFrame:
    """Direction times regime, a regime of 0 counting 1: the sign flips in a downtrend."""
    return rows.withColumn("regime_label", F.signum(forward_return(h)) * F.when(F.col(regime) == 0, 1).otherwise(F.col(regime)))


def entropy_weighted(rows: DataFrame, label: str, entropy: str) -> DataFrame:
    return rows.withColumn("hmm_label", F.col(label) / (1 + F.col(entropy)))


def stability_weighted(rows: DataFrame, label: str, stability: str) -> DataFrame:
    return rows.withColumn("cluster_label", F.col(label) * F.col(stability) / (F.max(stability).over(whole()) + EPS))


def agreement(columns: list[str], values: tuple[float, ...] = (-1.0, 0.0, 1.0)) -> Column:
    """Share of the commonest of ``values`` among the columns, unknown counting 0."""
    votes = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return F.greatest(*[count_equal(votes, s) for s in values]) / len(columns)


def ensemble_sources(rows: DataFrame, columns: list[str]) -> DataFrame:
    """ensemble_vote (sign of the sum), ensemble_strength (the sum) and ensemble_agreement (share of the commonest vote)."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))
    return rows.withColumns({"ensemble_vote": F.signum(total), "ensemble_strength": total, "ensemble_agreement": agreement(columns)})


def ensemble(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sign of the weighted sum (unknown 0), and the share of labels equal to the sign of their plain sum (unknown: not equal)."""
    total = sum((w * F.coalesce(F.col(c), F.lit(0)) for c, w in weights.items()), F.lit(0.0))
    plain = F.signum(sum((F.coalesce(F.col(c), F.lit(0)) for c in weights), F.lit(0)))
    agree = sum((F.when(F.col(c) == plain, 1).otherwise(0) for c in weights), F.lit(0)) / len(weights)
    return rows.withColumns({"ensemble_label": F.signum(total), "ensemble_conf": agree})


# ---- meta labels


def meta_by_equality(rows: DataFrame, label: str = "label", side: str = "side") -> DataFrame:
    """0 where no side was taken, 1 where the label equals it, else -1."""
    taken = F.coalesce(F.col(side), F.lit(0)) != 0
    return rows.withColumn("meta_label", F.when(~taken, 0).when(F.col(label) == F.col(side), 1).otherwise(-1))


def align_sides(events: DataFrame, sides: DataFrame) -> DataFrame:
    """``side`` of (symbol, ts, side) at each event's time, 0 where there is none."""
    found = sides.select("symbol", F.col("ts").alias("t0"), "side")
    return events.join(found, ["symbol", "t0"], "left").withColumn("side", F.coalesce("side", F.lit(0)))


def meta_by_product(rows: DataFrame, label: str = "label", side: str = "side") -> DataFrame:
    """Sign of label * side: a label of 0 gives 0, as no side does."""
    return rows.withColumn("meta_label", F.coalesce(F.signum(F.col(label) * F.col(side)).cast("int"), F.lit(0)))


def label_features(rows: DataFrame, label: str = "label", windows: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """LBL_ columns from past labels: previous value, momentum, consistency, flip and streak."""
    first = F.row_number().over(by_symbol()) <= 1
    rows = rows.withColumns({"__l": before(label), "__p": before(label, 2)})
    # a missing value differs from everything, as in a comparison with NaN
    rows = rows.withColumn("__flip", F.when(first | F.col("__l").isNull() | F.col("__p").isNull() | (F.col("__l") != F.col("__p")), 1).otherwise(0))
    rows = rows.withColumn("__run", F.sum("__flip").over(running()))
    out = {"LBL_prev": F.col("__l"), "LBL_flip": F.col("__flip"), "LBL_streak": F.row_number().over(Window.partitionBy("symbol", "__run").orderBy("ts"))}
    for w in windows:
        frame = trailing(w)
        out[f"LBL_momentum_{w}"] = mean("__l", w)
        most = F.greatest(*[F.count_if(F.col("__l") == v).over(frame) for v in (-1, 0, 1)])
        out[f"LBL_consistency_{w}"] = full(most / w, "__l", frame, w)
    return rows.withColumns(out).drop("__l", "__p", "__flip", "__run")


def correlations(rows: DataFrame, columns: list[str], above: float | None = None) -> DataFrame:
    """(a, b, corr) of all pairs of columns, one aggregate; ``above`` keeps |corr| over it."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = rows.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    turned = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("corr")) for i, (a, b) in enumerate(pairs)]))
    out = sums.select(turned.alias("x")).select("x.*")
    return out.where(F.abs("corr") > above) if above is not None else out


def build(rows: DataFrame, method: str, **options) -> DataFrame:
    """One label by name."""
    methods = {
        "triple_barrier": triple_barrier, "trend": trend_label, "vol_trend": vol_trend_label, "regime": regime_label, "hmm": entropy_weighted, "cluster": stability_weighted,
        "meta": meta_by_equality, "ensemble": ensemble, "forward": forward_returns, "horizon": horizon_matrix, "vol_adjusted": vol_adjusted,
    }
    if method not in methods:
        raise ValueError(f"unknown label method {method}")
    return methods[method](rows, **options)
