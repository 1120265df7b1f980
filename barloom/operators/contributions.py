"""Exact Shapley values of tree ensembles, in time polynomial in the depth, in Arrow batches.

A leaf's value counts for a set of known features with 1 or 0 for each known feature on its
path (the row passes all of that feature's splits there, or not) and with the share of
training rows that pass for each unknown one. That is a product, so a feature's Shapley value
is the leaf's value times (passes - share) times the integral over t from 0 to 1 of the other
features' (1 - t) share + t passes: a polynomial of the path's length less one, which Gauss-Legendre
points give exactly. Nothing depends on the order of the splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 2048


def tree_paths(tree: tuple) -> list[tuple[float, list[tuple[int, float, list[tuple[float, bool, bool]]]]]]:
    """Each leaf's value and, for each feature on its path, (feature, share of rows that pass, [(threshold, goes left, missing passes)])."""
    feature, threshold, missing_left, left, right, value, cover = tree
    out = []

    def walk(node: int, held: dict[int, tuple[float, list]]) -> None:
        if left[node] < 0:
            out.append((float(value[node]), [(f, share, tests) for f, (share, tests) in held.items()]))
            return
        f = int(feature[node])
        for child, goes_left in ((int(left[node]), True), (int(right[node]), False)):
            if cover[child] <= 0:
                continue  # no training row: such a leaf has no share, whatever is unknown
            share, tests = held.get(f, (1.0, []))
            walk(child, held | {f: (share * float(cover[child]) / float(cover[node]), [*tests, (float(threshold[node]), goes_left, bool(missing_left[node]) == goes_left)])})

    walk(0, {})
    return out


def shapley(x: np.ndarray, paths: list[list], n_features: int) -> tuple[np.ndarray, float]:
    """Contributions (rows, features) summed over trees, and the value with nothing known."""
    out, base = np.zeros((len(x), n_features)), 0.0
    absent = np.isnan(x)
    for leaves in paths:
        for value, held in leaves:
            share = np.array([s for _, s, _ in held])
            base += value * float(share.prod())
            if not held or value == 0.0:
                continue
            passes = np.ones((len(held), len(x)))
            for i, (f, _, tests) in enumerate(held):
                for cut, goes_left, missing in tests:
                    passes[i] *= np.where(absent[:, f], missing, (x[:, f] <= cut) == goes_left)
            points, weights = np.polynomial.legendre.leggauss((len(held) + 1) // 2)
            total = np.zeros((len(held), len(x)))
            for t, w in zip((points + 1) / 2, weights / 2, strict=True):
                each = share[:, None] * (1 - t) + passes * t  # above 0: no share is
                total += w * each.prod(axis=0) / each
            for i, (f, s, _) in enumerate(held):
                out[:, f] += value * (passes[i] - s) * total[i]
    return out, base


def forest_trees(model, target: int) -> list[tuple]:
    """A fitted forest's trees for one class; leaves are class shares over the number of trees."""
    found = []
    for tree in model.trees:
        nodes: list[list] = []

        def walk(node, nodes=nodes) -> int:
            i, counts = len(nodes), list(node.impurityStats().stats())
            cover = sum(counts)
            nodes.append([0, 0.0, False, -1, -1, counts[target] / max(cover, 1e-12) / len(model.trees) if target < len(counts) else 0.0, cover])
            if node.subtreeDepth() > 0:
                split = node.split()
                nodes[i][0], nodes[i][1] = split.featureIndex(), split.threshold()
                nodes[i][3] = walk(node.leftChild())
                nodes[i][4] = walk(node.rightChild())
            return i

        walk(tree._call_java("rootNode"))
        found.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
    return found


def tree_shap(trees: list[tuple], rows: DataFrame, n_features: int, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``keep``, contributions (an array, one for each feature) and base; needs ``features``. The trees travel as plain lists."""
    sent = rows.sparkSession.sparkContext.broadcast([tree_paths(t) for t in trees])
    chosen = rows.select(*keep, vector_to_array("features").alias("__x"))
    schema = ", ".join(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in keep) + ", contributions array<double>, base double"

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                x = np.array(batch.column(len(keep)).to_pylist(), float).reshape(-1, n_features)
                found, base = shapley(x, sent.value, n_features)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n_features), pa.array(found.ravel()))
                yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), lists, pa.array(np.full(len(x), base))], names=[*keep, "contributions", "base"])

    return chosen.mapInArrow(run, schema)


def by_feature(found: DataFrame, names: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, feature, mean_abs, mean, n): one aggregate over the contributions."""
    long = found.select(*by, F.posexplode("contributions").alias("place", "c"))
    named = F.array(*[F.lit(n) for n in names])
    return long.groupBy(*by, F.get(named, F.col("place")).alias("feature")).agg(F.avg(F.abs("c")).alias("mean_abs"), F.avg("c").alias("mean"), F.count("*").alias("n"))


def by_regime(found: DataFrame, names: list[str], regime: str, least: int = 50, top: int | None = 50) -> DataFrame:
    """Mean absolute contribution by (regime, feature): regimes of at least ``least`` rows, the ``top`` features over all rows."""
    each = by_feature(found, names, (regime,)).where(F.col("n") >= least)
    if top is None or top >= len(names):
        return each
    best = by_feature(found, names).orderBy(F.desc("mean_abs"), "feature").limit(top).select("feature")
    return each.join(F.broadcast(best), "feature")  # at most ``top`` rows
