"""Ranked search against a plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("barloom.llm.queries")

from barloom.llm import lexical
from tests.llm.test_operators import LOW, awkward, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(LOW) for t in TERM.findall(text or "")]


def plain(rows, items, k):
    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in queries.items():
        scored = []
        for d, c, size in docs:
            m = 100 - 50 + (50 * size * n) // total
            scored.append((-sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c), d is None, d or 0))
        out += [(item, r, None if missing else d, -s) for r, (s, missing, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return awkward() + [(None, "market price of no id", "x")] + [(300 + i, sentence(rng, rng.randrange(5, 90)), "x") for i in range(120)]


ITEMS = [(1, "The market price, token3 secret5"), (2, None), (3, "nothing_here zzz"), (4, "É é 日本 the"), (5, "one two three four of and price7 river8 stone9"), (5, "stone1 light2"), (None, "open close"), (7, "a"), (8, "")]


@pytest.mark.parametrize(("k", "shard", "block"), [(50, 4 << 20, 8 << 20), (3, 400, 20), (1, 2000, 8 << 20)])
def test_equals_plain(spark, rows, k, shard, block):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in lexical.search(docs, items, k, shard, block).collect()), key=str)
    assert got == plain([(d, t) for d, t, _ in rows], ITEMS, k)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, lexical.math.floor(1000 * math.log(4 / 3)) * (10**9 // 3000))]


def test_bounds_prune_without_loss():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, lists = int(rng.integers(1, 60)), []
        for _ in range(int(rng.integers(1, 9))):
            docs = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
            lists.append((docs, rng.integers(0, int(rng.integers(2, 50)), len(docs))))
        bounds = np.array([s.max() for _, s in lists])
        order = np.argsort(bounds, kind="stable")
        want = np.zeros(n, np.int64)
        for docs, shares in lists:
            want[docs] += shares
        least, k = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        if bounds.sum() < least:
            continue
        live, score = lexical.max_score([lists[i] for i in order], bounds[order], n, least, k)
        assert (want[live] == score).all()
        edge = np.sort(want)[::-1][:k].min() if n >= k else 0  # all that tie with the k-th stay
        assert set(np.flatnonzero(want >= max(least, edge, 1))) <= set(live.tolist())


def test_norms_beyond_64_bits():
    sizes = np.array([10**8, 3])
    assert lexical.norms(sizes, 10**11, 10**13).tolist() == [50 + 50 * 10**8 * 10**11 // 10**13, 50 + 50 * 3 * 10**11 // 10**13]
