"""Softmax gradient boosting over histograms that Spark sums, one level of all classes' trees a job.

Cut points come from quantile sketches, one aggregate for all features. Rows are written once
as bin codes (a byte a feature, 0 for a missing value). For each level every task adds up its
rows' gradients and curvatures by (class, node, feature, bin); Spark sums these histograms,
runs cumulative windows over the bins and keeps each node's best split: only those, at most
classes * 2^depth rows, reach the driver. Missing values go to the side that gains more.
Margins of finished rounds are written anew every ``REFRESH`` rounds, so a level never walks
more trees than that, and a lost executor costs a reread.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

REFRESH = 10
BINS = 64
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def cut_points(rows: DataFrame, x: list[Column], bins: int = BINS, accuracy: int = 10_000) -> list[np.ndarray]:
    """At most ``bins`` - 1 rising cut points of each column, from one pass; missing values don't count."""
    known = [F.when(c.isNotNull() & ~F.isnan(c), c) for c in x]
    found = rows.agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], accuracy).alias(f"c{i}") for i, c in enumerate(known)]).first()
    return [np.unique(np.array(e or [], float)) for e in found]


def codes_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """1 + how many cut points lie below the value, 0 where it is missing."""
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        known = ~np.isnan(x[:, j])
        out[known, j] = 1 + np.searchsorted(e, x[known, j], side="left")
    return out


def leaves_of(codes: np.ndarray, tree: Tree) -> np.ndarray:
    """The node each row ends in; a node is (feature, last bin of the left side, missing to the left, left, right, value, cover)."""
    feature, cut, missing_left, left, right = tree[:5]
    at = np.zeros(len(codes), np.int64)
    live = np.flatnonzero(left[at] >= 0)
    while len(live):
        node = at[live]
        code = codes[live, feature[node]]
        go_left = np.where(code == 0, missing_left[node], code <= cut[node])
        at[live] = np.where(go_left, left[node], right[node])
        live = live[left[at[live]] >= 0]
    return at


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def margins_of(codes: np.ndarray, margins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    out = margins.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += tree[5][leaves_of(codes, tree)]
    return out


def _batch(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, n_features)
    margins = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
    return codes, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False), margins


def histograms(table: DataFrame, n_features: int, classes: int, rounds: list[list[Tree]], growing: list[Tree]) -> DataFrame:
    """(class, node, feature, bin, g, h, n) over all rows, for the nodes that the ``growing`` trees may still split.

    ``table``: codes, y, weight, margins. ``rounds`` are finished trees that the margins lack.
    """

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, y, weight, margins = _batch(batch, n_features)
            p = softmax(margins_of(codes, margins, rounds))
            place = codes + 256 * np.arange(n_features)
            for k in range(classes):
                g, h = weight * (p[:, k] - (y == k)), weight * p[:, k] * (1 - p[:, k])
                node = leaves_of(codes, growing[k])
                for v in np.flatnonzero(np.bincount(node)).tolist():
                    if not np.isnan(growing[k][5][v]):
                        continue  # a leaf already
                    own = node == v
                    flat = place[own].ravel()
                    add = np.array([np.bincount(flat, np.repeat(s[own], n_features), 256 * n_features) for s in (g, h, np.ones(len(g)))])
                    sums[k, v] = sums[k, v] + add if (k, v) in sums else add
        for (k, v), (g, h, n) in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), v, np.int32)), pa.array((at // 256).astype(np.int32)), pa.array((at % 256).astype(np.int32)), pa.array(g[at]), pa.array(h[at]), pa.array(n[at].astype(np.int64))], names=["class", "node", "feature", "bin", "g", "h", "n"])

    parts = table.select("codes", "y", "weight", "margins").mapInArrow(run, "class int, node int, feature int, bin int, g double, h double, n long")
    # a task hands on one row a key, so nothing is left to combine before the shuffle; the windows over bins reuse it
    return parts.repartition("class", "node", "feature").groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def split_gains(hist: DataFrame, smooth: float = 1.0, least: int = 1, least_h: float = 1e-3) -> DataFrame:
    """Every possible split of every node: (class, node, feature, bin, missing_left, gain, gl, hl, nl, gt, ht, nt); one that isn't allowed has no gain."""
    group = Window.partitionBy("class", "node", "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    wide = hist.select("class", "node", "feature", "bin", *[x for s in "ghn" for x in (
        F.sum(F.when(F.col("bin") > 0, F.col(s)).otherwise(0)).over(upto).alias(f"{s}c"), F.sum(F.when(F.col("bin") == 0, F.col(s)).otherwise(0)).over(group).alias(f"{s}m"), F.sum(s).over(group).alias(f"{s}t"))])
    both = wide.withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True)))).where((F.col("nm") > 0) | ~F.col("missing_left"))
    both = both.withColumns({f"{s}l": F.col(f"{s}c") + F.when(F.col("missing_left"), F.col(f"{s}m")).otherwise(0) for s in "ghn"})
    gr, hr, nr = (F.col(f"{s}t") - F.col(f"{s}l") for s in "ghn")
    gain = F.col("gl") ** 2 / (F.col("hl") + smooth) + gr**2 / (hr + smooth) - F.col("gt") ** 2 / (F.col("ht") + smooth)
    allowed = (F.col("bin") > 0) & (F.col("nl") >= least) & (nr >= least) & (F.col("hl") >= least_h) & (hr >= least_h)
    return both.select("class", "node", "feature", "bin", "missing_left", F.when(allowed, gain).alias("gain"), "gl", "hl", "nl", "gt", "ht", "nt")


def best_splits(gains: DataFrame) -> DataFrame:
    """The best allowed split of each (class, node), the first feature and bin on a tie; nulls where none is allowed."""
    best = F.max(F.when(F.col("gain").isNotNull(), F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "missing_left", "gl", "hl", "nl"))).alias("s")
    found = gains.groupBy("class", "node").agg(best, F.first("gt").alias("gt"), F.first("ht").alias("ht"), F.first("nt").alias("nt"))
    return found.select("class", "node", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), "s.missing_left", "s.gain", "s.gl", "s.hl", "s.nl", "gt", "ht", "nt")


class _Growing:
    """One class's tree while it grows; an open node has no value yet."""

    def __init__(self):
        self.nodes = [[0, 0, False, -1, -1, np.nan, 0.0]]

    def tree(self) -> Tree:
        kinds = (np.int64, np.int64, bool, np.int64, np.int64, float, float)
        return tuple(np.array(c, kind) for c, kind in zip(zip(*self.nodes, strict=True), kinds, strict=True))

    def open(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n[3] < 0 and np.isnan(n[5])]


@dataclass
class BoostedModel:
    """Fitted trees by round and class, over codes from ``edges``."""

    edges: list[np.ndarray]
    classes: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return margins_of(codes_of(x, self.edges), np.zeros((len(x), self.classes)), self.rounds)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add probability (vector) and prediction; needs ``features``."""
        edges, classes, rounds = self.edges, self.classes, self.rounds  # plain arrays travel, not the model

        @F.pandas_udf("array<double>")
        def probabilities(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            codes = codes_of(np.array(x.tolist(), float).reshape(len(x), len(edges)), edges)
            return pd.Series(list(softmax(margins_of(codes, np.zeros((len(x), classes)), rounds))))

        scored = rows.withColumn("__p", probabilities(vector_to_array("features")))
        first = F.array_position("__p", F.array_max("__p")) - 1
        return scored.withColumns({"probability": array_to_vector("__p"), "prediction": first.cast("double")}).drop("__p")

    def raw_trees(self, target: int) -> list[tuple]:
        """Trees of one class for contributions: (feature, threshold, missing left, left, right, value, cover)."""
        return [(t[0], np.array([np.append(self.edges[f], np.inf)[c - 1] if left >= 0 else 0.0 for f, c, left in zip(t[0], t[1], t[3], strict=True)]), t[2], t[3], t[4], t[5], t[6]) for t in (r[target] for r in self.rounds)]


@dataclass(frozen=True)
class SoftmaxBoosting:
    """An estimator over ``features`` (vector), ``y`` (0, 1, ...) and ``weight`` (1 if absent)."""

    trees: int = 100
    depth: int = 6
    rate: float = 0.3
    smooth: float = 1.0
    least: int = 1
    bins: int = BINS
    classes: int | None = None

    def fit(self, rows: DataFrame) -> BoostedModel:
        if not 2 <= self.bins <= 255:
            raise ValueError("bins are 2 to 255")
        weight = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
        plain = rows.select(vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"), weight.alias("weight"))
        n_features, most = plain.agg(F.max(F.size("x")), F.max("y")).first()
        if n_features is None:
            raise ValueError("there are no rows to learn from")
        classes = self.classes or most + 1
        edges = cut_points(plain, [F.get("x", i) for i in range(n_features)], self.bins)
        model = BoostedModel(edges, classes)
        table, pending = written(binned(plain, edges, classes), "boosting"), []
        for _ in range(self.trees):
            model.rounds.append(self._round(table, n_features, classes, pending))
            pending.append(model.rounds[-1])
            if len(pending) == REFRESH and len(model.rounds) < self.trees:
                table, pending = written(_refreshed(table, n_features, pending), "boosting"), []
        return model

    def _round(self, table: DataFrame, n_features: int, classes: int, pending: list[list[Tree]]) -> list[Tree]:
        growing = [_Growing() for _ in range(classes)]
        for level in range(self.depth):
            if not any(g.open() for g in growing):
                break
            hist = histograms(table, n_features, classes, pending, [g.tree() for g in growing])
            for s in best_splits(split_gains(hist, self.smooth, self.least)).collect():  # a row for each open node
                nodes = growing[s["class"]].nodes
                node = nodes[s.node]
                node[6] = float(s.nt)
                if s.gain is None or s.gain <= 0:
                    node[5] = self._value(s.gt, s.ht)
                    continue
                node[0], node[1], node[2], node[3], node[4], node[5] = s.feature, s.bin, s.missing_left, len(nodes), len(nodes) + 1, 0.0
                for g, h, n in ((s.gl, s.hl, s.nl), (s.gt - s.gl, s.ht - s.hl, s.nt - s.nl)):
                    nodes.append([0, 0, False, -1, -1, self._value(g, h) if level == self.depth - 1 else np.nan, float(n)])
        for g in growing:
            for i in g.open():  # a class without rows to split
                g.nodes[i][5] = 0.0
        return [g.tree() for g in growing]

    def _value(self, g: float, h: float) -> float:
        return -self.rate * g / (h + self.smooth)


def binned(plain: DataFrame, edges: list[np.ndarray], classes: int) -> DataFrame:
    """(codes, y, weight, margins of zero) from (x, y, weight)."""

    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, len(edges))
            codes = codes_of(x, edges)
            yield pa.record_batch([pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), batch.column(2), pa.array([[0.0] * classes] * batch.num_rows, pa.list_(pa.float64()))], names=["codes", "y", "weight", "margins"])

    return plain.mapInArrow(run, "codes binary, y int, weight double, margins array<double>")


def _refreshed(table: DataFrame, n_features: int, pending: list[list[Tree]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            codes, _, _, margins = _batch(batch, n_features)
            new = margins_of(codes, margins, pending)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1, dtype=np.int32) * new.shape[1]), pa.array(new.ravel()))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), lists], names=["codes", "y", "weight", "margins"])

    return table.select("codes", "y", "weight", "margins").mapInArrow(run, table.schema)


def log_loss(preds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean negative log of the probability given to what came true; classes -1, 0, 1 by p_bear, p_neutral, p_bull."""
    own = F.when(F.col("true") == -1, F.col("p_bear")).when(F.col("true") == 0, F.col("p_neutral")).otherwise(F.col("p_bull"))
    return preds.groupBy(*by).agg(F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias("log_loss"), F.count("*").alias("n"))
