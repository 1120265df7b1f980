"""Softmax boosting and exact contributions, against plain computations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from barloom.operators import boosting as B
from barloom.operators import contributions as S
from barloom.operators import models as M

RNG = np.random.default_rng(11)


def sample(n, missing=0.1):
    x = np.round(RNG.normal(size=(n, 4)), 2)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] ** 2 > 0.8, 2, np.where(x[:, 2] * x[:, 0] > 0.1, 1, 0))
    y = np.where(RNG.random(n) < 0.1, RNG.integers(0, 3, n), y)
    x[RNG.random(x.shape) < missing] = np.nan
    return x, y


@pytest.fixture(scope="module")
def data():
    return sample(600), sample(600)


def frame(spark, x, y):
    return spark.createDataFrame([(i, Vectors.dense(v), float(k), 1.0) for i, (v, k) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], ["row_id", "features", "y", "weight"]).repartition(3)


def plain_fit(x, y, edges, classes, trees, depth, rate, smooth, least=1):
    """The same rule with plain loops."""
    codes = B.codes_of(x, edges)
    margins, rounds = np.zeros((len(x), classes)), []
    for _ in range(trees):
        p, own = B.softmax(margins), []
        for k in range(classes):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
            out = np.zeros(len(x))

            def grow(rows, left, g=g, h=h, out=out):
                best = None
                for f in range(x.shape[1]):
                    for b in range(1, len(edges[f]) + 2):
                        for m in (False, True):
                            c = codes[rows, f]
                            if m and not (c == 0).any():
                                continue
                            if not (c == b).any():
                                continue
                            go = np.where(c == 0, m, c <= b)
                            a, z = rows[go], rows[~go]
                            if len(a) < least or len(z) < least or h[a].sum() < 1e-3 or h[z].sum() < 1e-3:
                                continue
                            gain = sum(g[s].sum() ** 2 / (h[s].sum() + smooth) for s in (a, z)) - g[rows].sum() ** 2 / (h[rows].sum() + smooth)
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, a, z)
                if left and best and best[0] > 0:
                    grow(best[1], left - 1)
                    grow(best[2], left - 1)
                else:
                    out[rows] = -rate * g[rows].sum() / (h[rows].sum() + smooth)

            grow(np.arange(len(x)), depth)
            own.append(out)
        margins = margins + np.array(own).T
        rounds.append(margins)
    return margins


def test_equals_plain_rule(spark, data):
    (x, y), _ = data
    x, y = x[:160], y[:160]
    model = B.SoftmaxBoosting(trees=3, depth=2, bins=8, rate=0.5).fit(frame(spark, x, y))
    want = plain_fit(x, y, model.edges, 3, 3, 2, 0.5, 1.0)
    assert np.allclose(model.margins(x), want, atol=1e-6)


def test_margins_are_the_same_after_a_refresh(spark, data, monkeypatch):
    (x, y), _ = data
    rows = frame(spark, x[:200], y[:200])
    whole = B.SoftmaxBoosting(trees=4, depth=2, bins=8).fit(rows)
    monkeypatch.setattr(B, "REFRESH", 2)
    assert np.allclose(B.SoftmaxBoosting(trees=4, depth=2, bins=8).fit(rows).margins(x), whole.margins(x), atol=1e-6)


def test_beats_one_vs_rest_on_held_out_rows(spark, data):
    (x, y), (tx, ty) = data
    x, tx = np.nan_to_num(x), np.nan_to_num(tx)
    train, test = frame(spark, x, y), frame(spark, tx, ty)
    loss = {}
    for name, estimator in (("softmax", B.SoftmaxBoosting(trees=15, depth=3, rate=0.3, least=3)), ("one_vs_rest", M.boosted(15, 3))):
        preds = M.predict(estimator.fit(train), test, ("row_id",))
        assert preds.count() == len(tx)
        loss[name] = B.log_loss(preds).first().log_loss
    assert loss["softmax"] < loss["one_vs_rest"] and loss["softmax"] < math.log(3) * 0.7, loss


def test_no_rows_and_one_class(spark, data):
    (x, y), _ = data
    rows = frame(spark, x[:20], np.zeros(20, int))
    with pytest.raises(ValueError, match="no rows"):
        B.SoftmaxBoosting(trees=1).fit(rows.limit(0))
    model = B.SoftmaxBoosting(trees=2, depth=2, classes=3).fit(rows)
    got = model.transform(rows).select("prediction").distinct().collect()
    assert [r.prediction for r in got] == [0.0] and model.transform(rows.limit(0)).count() == 0


def expected(tree, x, known, node=0):
    """The tree's value when only ``known`` features are known, by walking both ways otherwise."""
    feature, threshold, missing_left, left, right, value, cover = tree
    if left[node] < 0:
        return value[node]
    f, kids = feature[node], (left[node], right[node])
    if f in known:
        go = missing_left[node] if np.isnan(x[f]) else x[f] <= threshold[node]
        return expected(tree, x, known, kids[0] if go else kids[1])
    return sum(cover[k] / cover[node] * expected(tree, x, known, k) for k in kids)


def by_subsets(trees, x, n):
    out = np.zeros(n)
    for j in range(n):
        others = [f for f in range(n) if f != j]
        for size in range(n):
            for known in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                out[j] += w * sum(expected(t, x, {*known, j}) - expected(t, x, set(known)) for t in trees)
    return out


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_contributions_equal_all_subsets(spark, data, kind):
    (x, y), _ = data
    x = np.nan_to_num(x) if kind == "forest" else x
    rows = frame(spark, x, y)
    if kind == "forest":
        model = M.forest(4, 4).fit(rows)
        trees, value = S.forest_trees(model, 2), {r.row_id: r.probability[2] for r in model.transform(rows).collect()}
    else:
        model = B.SoftmaxBoosting(trees=3, depth=4, bins=16).fit(rows)
        trees, value = model.raw_trees(2), dict(enumerate(model.margins(x)[:, 2]))
    found = S.tree_shap(trees, rows, 4).collect()
    assert len(found) == len(x)
    for r in found:
        assert r.base + sum(r.contributions) == pytest.approx(value[r.row_id], abs=1e-9)
    for r in sorted(found, key=lambda r: r.row_id)[:25]:
        assert np.allclose(r.contributions, by_subsets(trees, x[r.row_id], 4), atol=1e-9)


def test_table_by_regime(spark, data):
    (x, y), _ = data
    rows = frame(spark, np.nan_to_num(x), y).withColumn("regime", (F.col("row_id") % 3).cast("int")).where("regime < 2 or row_id < 60")
    trees = S.forest_trees(M.forest(3, 3).fit(rows), 1)
    found = S.tree_shap(trees, rows, 4, ("row_id", "regime")).persist()
    got = {(r.regime, r.feature): r for r in S.by_regime(found, list("abcd"), "regime", 50, 2).collect()}
    want = found.toPandas()
    assert {g for g, _ in got} == {0, 1} and len({f for _, f in got}) == 2
    for (g, f), r in got.items():
        mine = np.array([c["abcd".index(f)] for c in want[want.regime == g].contributions])
        assert r.n == len(mine) and r.mean_abs == pytest.approx(np.abs(mine).mean())
