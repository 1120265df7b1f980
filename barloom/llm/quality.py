"""Quality classifier (operator 5): a linear-chain conditional random field over lines.

Each line gets shape features, and those of the line before and after it. The chain has
two states, bad and good. Forward-backward gives each line's probability of good; their
mean, weighted with line lengths, is the document's raw quality, which a logistic curve
turns into the score.

Training takes a bounded sample of labels (``train_docs`` rows of the label table, chosen by
a hash of the id) and all lines of their texts; scoring takes all lines of all texts. Labels
of lines are latent: what is fitted, chain and curve together, is the likelihood of the
document's label as read from the weighted mean of its lines' marginals. Executors compute
each document's gradient through both passes and only sums come to the driver, once for each
step. Lines of all documents advance together, one line a step, so the work is numpy throughout.

Defined cases: null text counts as empty, and an empty text is one empty line and gets a
score; without usable labels every score is 0.5; equal rows each appear; a null doc_id is
passed on and is not held out. Repeated labels each count; of texts that share a labelled id
the least one is trained on. A very long text is one slice in one task, and a step of the
chain for each of its lines. Other columns of the input are ignored (or kept, by
``keep_good``), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, STAGE_BYTES, TextBlock, _byte_table, map_slices, materialize, slices, span_hashes, texts

TRAIN_DOCS = 4000
_UPPER = _byte_table(bytes(range(65, 91)))
_LETTER = _byte_table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_DIGIT = _byte_table(b"0123456789")
_STOP = _byte_table(b".,;:?'\"()-")
_ODD = ~(_LETTER | _DIGIT | _STOP | SPACE)
N_SHAPE = 11
N_FEATURES = 3 * N_SHAPE + 3
N_PARAMETERS = N_FEATURES + 6
#: Steps of the grids that gradients, and their products, are rounded to.
FINE, COARSE = float(1 << 30), float(1 << 16)


def line_features(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x N_FEATURES), line lengths in bytes, and the number of lines of each document."""
    data = block.bytes
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((block.offsets[:-1], breaks + 1)), kind="stable")
    per_doc = np.bincount(block.owner(breaks), minlength=block.n)[: block.n] + 1 if len(breaks) else np.ones(block.n, np.int64)
    first = np.cumsum(per_doc) - per_doc
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = first + per_doc - 1
    ends[last] = block.offsets[1:]
    # a line break at the very end of a text leaves an empty line that begins where the next text does
    length = np.maximum(ends - starts, 0)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=sums[1:])
        return (sums[starts + length] - sums[starts]) / np.maximum(length, 1)

    begin, end = block.runs(~SPACE[data])
    line = np.searchsorted(starts, begin, side="right") - 1
    words = np.bincount(line, minlength=len(starts))
    hashes = span_hashes(data, begin, end)

    def repeats(step: int) -> np.ndarray:
        if len(begin) <= step:
            return np.zeros(len(starts))
        same = (hashes[step:] == hashes[:-step]) & (line[step:] == line[:-step])
        return np.bincount(line[step:][same], minlength=len(starts)) / np.maximum(words, 1)

    shape = np.column_stack([
        np.log1p(length) / 5, np.log1p(words) / 4, np.log1p(length / np.maximum(words, 1)) / 2,
        share(_UPPER), share(_LETTER), share(_DIGIT), share(_STOP), share(_ODD),
        repeats(1), repeats(2), np.minimum(share(_ODD) * 20, 1),
    ])
    before, after = np.zeros_like(shape), np.zeros_like(shape)
    before[1:], after[:-1] = shape[:-1], shape[1:]
    before[first], after[last] = 0, 0
    edge = np.zeros((len(starts), 3))
    edge[:, 0] = 1
    edge[first, 1] = 1
    edge[last, 2] = 1
    return np.hstack([shape, before, after, edge]), length + 1, per_doc


@dataclass(frozen=True)
class Chain:
    """weights: log-odds of good for a line's features; move[i, j]: from state i to j; slope and shift of the score."""

    weights: np.ndarray
    move: np.ndarray
    slope: float = 0.0
    shift: float = 0.0


def _steps(per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling length, their first lines, and how many have a t-th line."""
    order = np.argsort(-per_doc, kind="stable")
    first = (np.cumsum(per_doc) - per_doc)[order]
    alive = len(per_doc) - np.cumsum(np.bincount(per_doc, minlength=per_doc.max() + 1))[: per_doc.max()]
    return order, first, alive


def messages(unary: np.ndarray, move: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with own evidence) and backward (without it) log-odds of good for each line."""
    ahead, back = unary.copy(), np.zeros_like(unary)
    _, first, alive = _steps(per_doc)
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        a = ahead[at - 1]
        ahead[at] += np.logaddexp(move[0, 1], a + move[1, 1]) - np.logaddexp(move[0, 0], a + move[1, 0])
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        b = unary[at] + back[at]
        back[at - 1] = np.logaddexp(move[1, 0], b + move[1, 1]) - np.logaddexp(move[0, 0], b + move[0, 1])
    return ahead, back


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def raw_quality(chain: Chain, features: np.ndarray, length: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals, as log-odds, of each document."""
    ahead, back = messages(features @ chain.weights, chain.move, per_doc)
    first = np.cumsum(per_doc) - per_doc
    good = np.add.reduceat(sigmoid(ahead + back) * length, first) / np.add.reduceat(length, first)
    good = np.clip(good, 1e-6, 1 - 1e-6)
    return np.log(good / (1 - good))


def parameters(chain: Chain) -> np.ndarray:
    return np.concatenate((chain.weights, chain.move.ravel(), [chain.slope, chain.shift]))


def chain_of(theta: np.ndarray) -> Chain:
    return Chain(theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), float(theta[-2]), float(theta[-1]))


def learn(chain: Chain, features: np.ndarray, length: np.ndarray, per_doc: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each document's label and its gradient, document by document.

    The label is read from the length-weighted mean of the lines' marginals; the derivatives
    run back through that mean and through both passes of messages.
    """
    move = chain.move
    unary = (features * chain.weights).sum(axis=1)
    ahead, back = messages(unary, move, per_doc)
    starts = np.cumsum(per_doc) - per_doc
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    part = length / np.add.reduceat(length, starts)[doc]
    p = sigmoid(ahead + back)
    good = np.clip(np.add.reduceat(part * p, starts), 1e-6, 1 - 1e-6)
    raw = np.log(good / (1 - good))
    z = chain.slope * raw + chain.shift
    value = -np.logaddexp(0, np.where(label > 0, -z, z))
    off = label - sigmoid(z)

    to_ahead = (off * chain.slope / (good * (1 - good)))[doc] * part * p * (1 - p)
    to_back = to_ahead.copy()
    into = unary + back
    r1, r0 = sigmoid(ahead + move[1, 1] - move[0, 1]), sigmoid(ahead + move[1, 0] - move[0, 0])
    k1, k0 = sigmoid(into + move[1, 1] - move[1, 0]), sigmoid(into + move[0, 1] - move[0, 0])
    _, first, alive = _steps(per_doc)
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        to_ahead[at - 1] += (r1[at - 1] - r0[at - 1]) * to_ahead[at]
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        to_back[at] += (k1[at] - k0[at]) * to_back[at - 1]
    inner = np.ones(len(unary), bool)
    inner[starts] = False
    i = np.flatnonzero(inner)
    a, b = to_ahead[i], to_back[i - 1]
    moves = np.zeros((len(unary), 4))
    moves[i, 0] = -a * (1 - r0[i - 1]) - b * (1 - k0[i])
    moves[i, 1] = a * (1 - r1[i - 1]) - b * k0[i]
    moves[i, 2] = -a * r0[i - 1] + b * (1 - k1[i])
    moves[i, 3] = a * r1[i - 1] + b * k1[i]
    to_unary = to_ahead
    to_unary[i] += (k1[i] - k0[i]) * b
    grad = np.hstack([
        np.add.reduceat(features * to_unary[:, None], starts), np.add.reduceat(moves, starts),
        (off * raw)[:, None], off[:, None],
    ])
    return value, grad


def sums(rows: DataFrame, chain: Chain) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and summed outer products of the gradients over all of (text, y, n).

    Every document's share is rounded to a fixed grid, so sums of integers are exact and
    don't depend on partitions; only these sums leave the executors.
    """

    def run(batches):
        total = np.zeros(1 + N_PARAMETERS * (1 + N_PARAMETERS), np.int64)
        for whole in batches:
            for batch in slices(whole):
                y, n = (batch.column(k).to_numpy() for k in (1, 2))
                value, grad = learn(chain, *line_features(TextBlock(batch.column(0))), y)
                coarse = np.rint(grad * COARSE).astype(np.int64)
                total[0] += (np.rint(value * FINE).astype(np.int64) * n).sum()
                total[1 : 1 + N_PARAMETERS] += (np.rint(grad * FINE).astype(np.int64) * n[:, None]).sum(axis=0)
                total[1 + N_PARAMETERS :] += ((coarse * n[:, None]).T @ coarse).ravel()
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    total = np.zeros(1 + N_PARAMETERS * (1 + N_PARAMETERS))
    for r in rows.select("text", "y", "n").mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[r.at] = r.value
    return total[0] / FINE, total[1 : 1 + N_PARAMETERS] / FINE, total[1 + N_PARAMETERS :].reshape(N_PARAMETERS, N_PARAMETERS) / COARSE**2


def fit(rows: DataFrame, n: int, rounds: int = 40, decay: float = 1e-3, enough: float = 1e-4) -> Chain:
    """Maximum likelihood of the documents' labels by damped scoring steps, one pass over (text, y, n) a step.

    A step solves with the summed outer products of gradients in place of second derivatives; one that
    doesn't raise the likelihood is taken back and damped more. Lines start with a weak wish to stay alike.
    """
    prior = parameters(Chain(np.zeros(N_FEATURES), np.eye(2) / 2, 1.0, 0.0))

    def look(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, grad, outer = sums(rows, chain_of(theta))
        away = theta - prior
        return value - decay * n * (away @ away) / 2, grad - decay * n * away, outer

    theta, damp = prior, 1e-2
    value, grad, outer = look(theta)
    scale = np.diag(outer)
    for _ in range(rounds):
        # the products vanish where labels are told apart well; their largest so far keeps the damping effective
        scale = np.maximum(scale, np.diag(outer))
        step = np.linalg.solve(outer + np.diag(damp * scale + decay * n), grad)
        tried = theta + step * min(1.0, 2 / np.abs(step).max(initial=1e-9))
        new = look(tried)
        if new[0] > value:
            gain, theta, damp = (new[0] - value) / n, tried, max(damp / 4, 1e-6)
            value, grad, outer = new
            if gain < enough:
                break
        elif damp > 1e3:
            break
        else:
            damp *= 8
    return chain_of(theta)


def held_out(id_col: str = "doc_id"):
    """Held out of training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Chain:
    """Fit on at most ``train_docs`` labelled documents that are not held out."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)").where(~held_out())
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "y").limit(train_docs)
    )

    # of rows that share an id the one with the least text, so that the sample is bounded by its labels;
    # labels that repeat are one row with their number
    chosen = chosen.groupBy("doc_id", "y").agg(F.count("*").alias("n"))
    wanted = texts(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = wanted.join(F.broadcast(chosen), "doc_id").select("text", "y", "n")
    rows = materialize(rows.repartition(docs.sparkSession.sparkContext.defaultParallelism), "training")
    known = {r.y: r.n for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if len(known) < 2:
        return Chain(np.zeros(N_FEATURES), np.zeros((2, 2)))
    return fit(rows, sum(known.values()))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = raw_quality(chain, *line_features(TextBlock(batch.column(1))))
            return pa.record_batch([batch.column(0), pa.array(sigmoid(chain.slope * raw + chain.shift))], names=["doc_id", "score"])

        return work

    out = map_slices(texts(docs), make, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def label_lines(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, line (from 0), n_bytes, good (its probability), label (1 good, 0 bad): one row per line."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            features, length, per_doc = line_features(TextBlock(batch.column(1)))
            ahead, back = messages(features @ chain.weights, chain.move, per_doc)
            doc = np.repeat(np.arange(len(per_doc)), per_doc)
            line = np.arange(len(doc)) - (np.cumsum(per_doc) - per_doc)[doc]
            return pa.record_batch([batch.column(0).take(pa.array(doc)), pa.array(line), pa.array(length - 1), pa.array(sigmoid(ahead + back))], names=["doc_id", "line", "n_bytes", "good"])

        return work

    out = map_slices(texts(docs), make, "doc_id long, line long, n_bytes long, good double")
    return out.withColumn("label", (F.col("good") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents the classifier rejects; the text is judged in place, so nothing is joined."""
    chain = train(docs, labels)
    kept = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, STAGE_BYTES):
                raw = raw_quality(chain, *line_features(TextBlock(batch.column(batch.schema.get_field_index("text")))))
                yield batch.filter(pa.array(sigmoid(chain.slope * raw + chain.shift) >= 0.5))

    return kept.mapInArrow(run, kept.schema)
