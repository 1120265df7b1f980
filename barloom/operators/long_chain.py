"""A Gaussian hidden Markov model of series too long for one task: chunks as operators of an associative chain.

Going over a bar is a matrix: transition times the bar's densities. A chunk of a series is the product
of its bars' matrices, whatever comes before or after it, so each round has two passes of
independent tasks: one gives every chunk's matrix, the ends are chained (a k x k matrix a chunk),
and the second runs forward and backward through each chunk from what enters at its two ends and
adds up the sufficient statistics. The best path is found the same way with maxima of sums in
place of sums of products.

Within a task a chunk is cut once more, into about as many stretches as each has bars; all
stretches take a step together in numpy. The driver holds chunk matrices and models of one group
of series at a time (``GROUP`` chunks).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import EPS, row_id
from ..sources.tables import written

CHUNK = 100_000
GROUP = 50_000
TINY = 1e-300


@dataclass
class GaussianChain:
    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    covs: np.ndarray


def _log_density(x: np.ndarray, model: GaussianChain) -> np.ndarray:
    out = np.empty((len(x), len(model.means)))
    for i, (mu, cov) in enumerate(zip(model.means, model.covs, strict=True)):
        chol = np.linalg.cholesky(cov)
        z = np.linalg.solve(chol, (x - mu).T)
        out[:, i] = -0.5 * (z**2).sum(axis=0) - np.log(np.diag(chol)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def times(v: np.ndarray, m: np.ndarray, best: bool) -> np.ndarray:
    """Rows of v times matrices m; with ``best`` the largest sum instead of the sum of products."""
    if best:
        return (v[..., :, None] + m[..., None, :, :] if v.ndim == m.ndim else v[..., :, None] + m).max(axis=-2)
    return v @ m if v.ndim == m.ndim else (v[..., None, :] @ m)[..., 0, :]


def levelled(v: np.ndarray, axes: tuple[int, ...], best: bool) -> tuple[np.ndarray, np.ndarray]:
    """v scaled so that it neither vanishes nor grows, and the logarithm of the scale."""
    if best:
        top = v.max(axis=axes, keepdims=True)
        return v - top, top.reshape(top.shape[: v.ndim - len(axes)])
    total = np.maximum(v.sum(axis=axes, keepdims=True), TINY)
    return v / total, np.log(total).reshape(total.shape[: v.ndim - len(axes)])


def stretches(ops: np.ndarray, best: bool) -> np.ndarray:
    """(steps, stretches, k, k), filled up with matrices that change nothing."""
    n, k = ops.shape[:2]
    width = max(1, int(np.sqrt(n)))
    count = -(-n // width)
    idle = np.where(np.eye(k, dtype=bool), 0.0, -np.inf) if best else np.eye(k)
    full = np.concatenate([ops, np.broadcast_to(idle, (count * width - n, k, k))])
    return full.reshape(count, width, k, k).swapaxes(0, 1)


def product(ops: np.ndarray, best: bool = False) -> tuple[np.ndarray, float]:
    """The matrix of a whole chunk, scaled, and the logarithm of its scale."""
    steps = stretches(ops, best)
    out, logs = steps[0], np.zeros(steps.shape[1])
    out, logs = levelled(out, (1, 2), best)
    for m in steps[1:]:
        out, more = levelled(times(out, m, best), (1, 2), best)
        logs = logs + more
    whole, log = out[0], float(logs.sum())
    for m in out[1:]:
        whole, more = levelled(times(whole, m, best), (0, 1), best)
        log += float(more)
    return whole, log


def vectors(ops: np.ndarray, enter: np.ndarray, best: bool = False) -> tuple[np.ndarray, float]:
    """The scaled row vector after each step, from ``enter``, and the logarithm of all scales."""
    steps = stretches(ops, best)
    whole = steps[0]
    for m in steps[1:]:
        whole, _ = levelled(times(whole, m, best), (1, 2), best)
    begins = [enter]
    for m in whole[:-1]:
        begins.append(levelled(times(begins[-1], m, best), (0,), best)[0])
    now, log, out = np.array(begins), 0.0, []
    real = (np.arange(len(steps)) + len(steps) * np.arange(steps.shape[1])[:, None]) < len(ops)
    for i, m in enumerate(steps):
        now, more = levelled(times(now, m, best), (1,), best)
        log += float(more[real[:, i]].sum())
        out.append(now)
    return np.stack(out, axis=1).reshape(-1, ops.shape[1])[: len(ops)], log


def backward(ops: np.ndarray, leave: np.ndarray, best: bool = False) -> np.ndarray:
    """The scaled vector that waits after each step, given the one after the last."""
    later, _ = vectors(ops[::-1].swapaxes(1, 2), leave, best)
    return np.concatenate([later[::-1][1:], leave[None]])


def matrices(log_b: np.ndarray, start: np.ndarray, move: np.ndarray, first: bool, best: bool = False) -> np.ndarray:
    """One matrix a bar; the first bar of a series has no transition before it (its start enters)."""
    with np.errstate(divide="ignore"):
        if best:
            out = np.log(move)[None] + log_b[:, None, :]
            if first:
                out[0] = np.where(np.eye(len(move), dtype=bool), log_b[0], -np.inf)
            return out
    b = np.exp(log_b)
    out = move[None] * b[:, None, :]
    if first:
        out[0] = np.diag(b[0])
    return out


def chunk_table(rows: DataFrame, columns: tuple[str, ...], chunk: int) -> DataFrame:
    """One row for each chunk: symbol, chunk, n, x (standardised, bar after bar) and the rows' places, from rows with ``__rn``."""
    clean = {f"__x{i}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(columns)}
    rows = rows.select("symbol", "__rn", *[c.alias(n) for n, c in clean.items()])
    stats = rows.groupBy("symbol").agg(*[x for n in clean for x in (F.avg(n).alias(f"m{n}"), F.stddev_pop(n).alias(f"s{n}"))])
    flat = F.array(*[(F.col(n) - F.col(f"m{n}")) / (F.col(f"s{n}") + EPS) for n in clean])
    each = rows.join(stats, "symbol").select("symbol", F.floor(F.col("__rn") / chunk).alias("chunk"), "__rn", flat.alias("x"))
    held = F.array_sort(F.collect_list(F.struct("__rn", "x"))).alias("h")  # a chunk's bars at most
    return each.groupBy("symbol", "chunk").agg(held).select("symbol", "chunk", F.flatten(F.col("h.x")).alias("x"))


def _model(k: int, f: int, flat: np.ndarray) -> GaussianChain:
    a = k + k * k
    return GaussianChain(flat[:k], flat[k:a].reshape(k, k), flat[a : a + k * f].reshape(k, f), flat[a + k * f :].reshape(k, f, f))


def _flat(model: GaussianChain) -> np.ndarray:
    return np.concatenate([model.start, model.move.ravel(), model.means.ravel(), model.covs.ravel()])


def _chunks(batches: Iterator[pa.RecordBatch], f: int) -> Iterator[tuple[str, int, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].values.to_numpy(zero_copy_only=False).reshape(-1, f)


def _starts(table: DataFrame, f: int, k: int, floor: float) -> dict[str, np.ndarray]:
    """Each series' first model: means of the quantile slices of its first column, one covariance."""
    long = table.select("symbol", F.explode(F.transform(F.sequence(F.lit(0), (F.size("x") / f - 1).cast("int")), lambda i: F.slice("x", i * f + 1, f))).alias("v"))
    edges = long.groupBy("symbol").agg(F.percentile(F.col("v")[0], [i / k for i in range(1, k)]).alias("e"))
    part = F.size(F.filter("e", lambda e: e <= F.col("v")[0]))
    own = long.join(F.broadcast(edges), "symbol").withColumn("part", part)  # a row a series, GROUP at most
    means = own.groupBy("symbol", "part").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(f)]).alias("m")).collect()
    spread = long.groupBy("symbol").agg(F.array(*[F.covar_pop(F.col("v")[i], F.col("v")[j]) for i in range(f) for j in range(f)]).alias("c"), F.array(*[F.avg(F.col("v")[i]) for i in range(f)]).alias("a")).collect()
    by = {(r.symbol, r.part): np.array(r.m) for r in means}
    move = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1))
    return {r.symbol: _flat(GaussianChain(np.full(k, 1 / k), move, np.array([by.get((r.symbol, i), np.array(r.a)) for i in range(k)]), np.array([np.array(r.c).reshape(f, f) + floor * np.eye(f)] * k))) for r in spread}


def _ends(table: DataFrame, models: dict[str, np.ndarray], k: int, f: int, best: bool = False) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """What enters each chunk from before and what waits after it; chunk matrices are chained here."""
    sent = table.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for symbol, chunk, x in _chunks(batches, f):
            model = _model(k, f, sent.value[symbol])
            log_b = _log_density(x, model)
            whole, _ = product(matrices(log_b - log_b.max(axis=1, keepdims=True), model.start, model.move, chunk == 0, best), best)
            yield pa.record_batch([pa.array([symbol]), pa.array([chunk], pa.int64()), pa.array([whole.ravel().tolist()], pa.list_(pa.float64()))], names=["symbol", "chunk", "m"])

    found: dict[str, dict[int, np.ndarray]] = {}
    for r in table.mapInArrow(run, "symbol string, chunk long, m array<double>").collect():  # GROUP rows at most
        found.setdefault(r.symbol, {})[r.chunk] = np.array(r.m).reshape(k, k)
    out = {}
    for symbol, own in found.items():
        start = _model(k, f, models[symbol]).start
        with np.errstate(divide="ignore"):
            enter = np.log(start) if best else start
        leave, after = (np.zeros(k) if best else np.full(k, 1 / k)), {}
        for c in sorted(own, reverse=True):
            after[c] = leave
            leave = levelled(times(leave, own[c].T, best), (0,), best)[0]
        for c in sorted(own):
            out[symbol, c] = (enter, after[c])
            enter = levelled(times(enter, own[c], best), (0,), best)[0]
    return out


def _learn(table: DataFrame, models: dict[str, np.ndarray], k: int, f: int, floor: float) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """One round: new models and the old ones' log likelihoods."""
    sent = table.sparkSession.sparkContext.broadcast((models, _ends(table, models, k, f)))

    def run(batches):
        models, ends = sent.value
        for symbol, chunk, x in _chunks(batches, f):
            model, (enter, leave) = _model(k, f, models[symbol]), ends[symbol, chunk]
            log_b = _log_density(x, model)
            shift = log_b.max(axis=1, keepdims=True)
            ops = matrices(log_b - shift, model.start, model.move, chunk == 0)
            alpha, log = vectors(ops, enter)
            beta = backward(ops, leave)
            gamma = alpha * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            before = np.concatenate([enter[None], alpha[:-1]])
            pairs = before[:, :, None] * ops * beta[:, None, :]
            pairs /= np.maximum(pairs.sum(axis=(1, 2), keepdims=True), TINY)
            pairs = pairs[1 if chunk == 0 else 0 :].sum(axis=0)
            sums = [gamma.sum(axis=0), (gamma.T @ x).ravel(), np.einsum("ti,ta,tb->iab", gamma, x, x).ravel(), pairs.ravel(), gamma[0] if chunk == 0 else np.zeros(k), [log + float(shift.sum())]]
            yield pa.record_batch([pa.array([symbol]), pa.array([np.concatenate(sums).tolist()], pa.list_(pa.float64()))], names=["symbol", "s"])

    size = k + k * f + k * f * f + k * k + k + 1
    sums = table.mapInArrow(run, "symbol string, s array<double>").groupBy("symbol").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("s")).collect()
    new, likelihood = {}, {}
    for r in sums:
        s = np.array(r.s)
        cuts = np.cumsum([k, k * f, k * f * f, k * k, k])
        n, sx, sxx, pairs, first = (s[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True))
        weight = n + 1e-12
        means = sx.reshape(k, f) / weight[:, None]
        moments = sxx.reshape(k, f, f)
        covs = np.array([(moments[i] - np.outer(sx.reshape(k, f)[i], means[i]) - np.outer(means[i], sx.reshape(k, f)[i]) + n[i] * np.outer(means[i], means[i])) / weight[i] + floor * np.eye(f) for i in range(k)])
        pairs = pairs.reshape(k, k) + 1e-12
        new[r.symbol] = _flat(GaussianChain(first / first.sum(), pairs / pairs.sum(axis=1, keepdims=True), means, covs))
        likelihood[r.symbol] = float(s[-1])
    return new, likelihood


def fit_long(table: DataFrame, k: int, f: int, rounds: int = 200, tolerance: float = 1e-4, floor: float = 1e-3) -> dict[str, np.ndarray]:
    """A model for each series of ``table`` (``chunk_table``, written); states by rising mean of the first column. A series stops when its likelihood settles."""
    models, before, open_ = _starts(table, f, k, floor), {}, None
    for _ in range(rounds):
        some = table if open_ is None else table.where(F.col("symbol").isin(open_))
        new, likelihood = _learn(some, models if open_ is None else {s: models[s] for s in open_}, k, f, floor)
        models |= new
        open_ = [s for s in new if abs(likelihood[s] - before.get(s, -np.inf)) >= tolerance]
        before |= likelihood
        if not open_:
            break
    out = {}
    for symbol, flat in models.items():
        m = _model(k, f, flat)
        order = np.argsort(m.means[:, 0])
        out[symbol] = _flat(GaussianChain(m.start[order], m.move[np.ix_(order, order)], m.means[order], m.covs[order]))
    return out


def decode_long(table: DataFrame, models: dict[str, np.ndarray], k: int, f: int, chunk: int) -> DataFrame:
    """(symbol, __rn, state, post): the best path and the posterior of each bar.

    A chunk's last state is the one of the best whole path; the way back through the chunk follows it.
    """
    sent = table.sparkSession.sparkContext.broadcast((models, _ends(table, models, k, f), _ends(table, models, k, f, True)))

    def run(batches):
        models, sums, tops = sent.value
        for symbol, place, x in _chunks(batches, f):
            model = _model(k, f, models[symbol])
            log_b = _log_density(x, model)
            log_b -= log_b.max(axis=1, keepdims=True)
            ops = matrices(log_b, model.start, model.move, place == 0)
            alpha, _ = vectors(ops, sums[symbol, place][0])
            gamma = alpha * backward(ops, sums[symbol, place][1])
            gamma /= gamma.sum(axis=1, keepdims=True)
            ops = matrices(log_b, model.start, model.move, place == 0, True)
            enter, leave = tops[symbol, place]
            score, _ = vectors(ops, enter, True)
            came = (np.concatenate([enter[None], score[:-1]])[:, :, None] + ops).argmax(axis=1)  # from where each state is best reached
            state, at = np.empty(len(x), np.int32), int((score[-1] + leave).argmax())
            for t in range(len(x) - 1, -1, -1):
                state[t] = at
                at = int(came[t, at])
            n = len(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(gamma.ravel()))
            yield pa.record_batch([pa.array([symbol] * n), pa.array(np.arange(n) + place * chunk), pa.array(state), lists], names=["symbol", "__rn", "state", "post"])

    return table.mapInArrow(run, "symbol string, __rn long, state int, post array<double>")


def hidden_states_long(rows: DataFrame, columns: tuple[str, ...], k: int = 3, rounds: int = 200, chunk: int = CHUNK) -> DataFrame:
    """``rows`` (feature table) with HMM_State, HMM_Post, HMM_Trans and HMM_Duration, every series cut into chunks."""
    numbered = rows.withColumn("__rn", row_id().cast("long"))
    table, f, out = written(chunk_table(numbered, columns, chunk), "chain"), len(columns), []
    spark = rows.sparkSession
    sizes = table.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("g", F.floor((F.sum("n").over(Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, 0)) - 1) / GROUP))
    for g in [r.g for r in sizes.select("g").distinct().orderBy("g").collect()]:
        own = [r.symbol for r in sizes.where(F.col("g") == g).collect()]  # GROUP at most
        some = table.where(F.col("symbol").isin(own))
        models = fit_long(some, k, f, rounds)
        held = []
        for symbol, flat in models.items():
            move = _model(k, f, flat).move
            held.append((symbol, move.tolist(), (1 / np.maximum(1 - np.diag(move), 1e-12)).tolist()))
        constants = spark.createDataFrame(held, "symbol string, HMM_Trans array<array<double>>, __stay array<double>")
        out.append(decode_long(some, models, k, f, chunk).join(F.broadcast(constants), "symbol"))
    if not out:
        none = "CAST(NULL AS INT) AS HMM_State", "CAST(NULL AS ARRAY<DOUBLE>) AS HMM_Post", "CAST(NULL AS ARRAY<ARRAY<DOUBLE>>) AS HMM_Trans", "CAST(NULL AS DOUBLE) AS HMM_Duration"
        return rows.selectExpr("*", *none)
    found = out[0]
    for other in out[1:]:
        found = found.unionByName(other)
    whole = numbered.join(found, ["symbol", "__rn"])
    return whole.select(*rows.columns, F.col("state").alias("HMM_State"), F.col("post").alias("HMM_Post"), "HMM_Trans", F.get("__stay", F.col("state")).alias("HMM_Duration"))
