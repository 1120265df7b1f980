"""The chunked hidden Markov model gives what the serial one gives."""

import numpy as np
import pytest

from barloom.operators import long_chain as C
from barloom.operators import unsupervised as U

RNG = np.random.default_rng(4)


def series(n):
    state = np.cumsum(RNG.random(n) < 0.03) % 3
    return np.column_stack([RNG.normal(size=n) * (0.5 + state) + state, RNG.normal(size=n) + 2 * state, RNG.normal(size=n)])


@pytest.mark.parametrize("n", [1, 2, 3, 17, 400])
def test_vectors_equal_a_plain_loop(n):
    ops = RNG.random((n, 3, 3))
    enter, leave = np.array([0.2, 0.3, 0.5]), np.array([0.5, 0.1, 0.4])
    for best in (False, True):
        m = np.log(ops) if best else ops
        got, log = C.vectors(m, np.log(enter) if best else enter, best)
        v, logs = (np.log(enter) if best else enter), 0.0
        for t in range(n):
            v = (v[:, None] + m[t]).max(axis=0) if best else v @ m[t]
            scale = v.max() if best else v.sum()
            v, logs = (v - scale, logs + scale) if best else (v / scale, logs + np.log(scale))
            assert np.allclose(got[t], v)
        assert log == pytest.approx(logs)
        whole, more = C.product(m, best)
        end = ((np.log(enter)[:, None] + whole).max(axis=0) if best else enter @ whole)
        assert np.allclose(end - end.max() if best else end / end.sum(), got[-1])
        later = C.backward(m, np.log(leave) if best else leave, best)
        w = np.log(leave) if best else leave
        for t in range(n - 1, -1, -1):
            assert np.allclose(later[t] - later[t].max() if best else later[t] / later[t].sum(), w - w.max() if best else w / w.sum())
            w = (m[t] + w[None, :]).max(axis=1) if best else m[t] @ w


@pytest.fixture(scope="module")
def table(spark):
    x = {"a": series(730), "b": series(260)}
    rows = [(s, i, *map(float, v)) for s, m in x.items() for i, v in enumerate(m)]
    return x, spark.createDataFrame(rows, "symbol string, __rn long, p double, q double, r double").repartition(3)


def test_fit_and_path_equal_the_serial_form(spark, table):
    x, rows = table
    chunks = C.written(C.chunk_table(rows, ("p", "q", "r"), 100), "test")
    assert chunks.count() == 8 + 3
    models = C.fit_long(chunks, 3, 3, rounds=6)
    found = C.decode_long(chunks, models, 3, 3, 100).toPandas().sort_values(["symbol", "__rn"])
    for s, m in x.items():
        z = (m - m.mean(axis=0)) / (m.std(axis=0) + U.EPS)
        want = U.fit_chain(z, 3, 6)
        assert np.allclose(models[s], C._flat(want), atol=1e-6)
        log_b = U._log_density(z, want)
        mine = found[found.symbol == s]
        assert (mine["__rn"].to_numpy() == np.arange(len(z))).all()
        assert (mine["state"].to_numpy() == U.viterbi(log_b, want)).all()
        assert np.allclose(np.array(mine["post"].tolist()), U._forward_backward(log_b, want)[0], atol=1e-6)


def test_series_of_both_kinds(spark, sf):
    from barloom.plans.registry import hourly

    bars = hourly(spark, sf).where("symbol in ('click', 'view') or symbol >= 's'")
    sizes = sorted(r["count"] for r in bars.groupBy("symbol").count().collect())
    a = U.hidden_states(bars, rounds=3).toPandas()
    b = U.hidden_states(bars, rounds=3, chunk=(sizes[0] + sizes[-1]) // 2).toPandas()
    key = ["symbol", "ts"]
    a, b = (t.sort_values(key).reset_index(drop=True) for t in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    assert (a["HMM_State"] == b["HMM_State"]).all() and np.allclose(a["HMM_Duration"], b["HMM_Duration"], rtol=1e-5)
    assert np.allclose(np.array(a["HMM_Post"].tolist()), np.array(b["HMM_Post"].tolist()), atol=1e-6)


def test_no_rows(spark, table):
    assert C.hidden_states_long(table[1].withColumnRenamed("__rn", "ts").limit(0), ("p", "q", "r")).count() == 0
