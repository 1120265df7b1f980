"""Operator 4: scores against a plain computation over the classes found, and every word's class against its gain."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from barloom.llm import class_model

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(21)
    kinds = [[f"{c}{i}" for i in range(30)] for c in ("noun", "verb", "det", "adj")]
    pick = lambda k: kinds[k][min(int(rng.expovariate(0.15)), 29)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(1, 14)) for w in (pick(2), pick(3), pick(0), pick(1)))) for i in range(260)]
    rows += [(900, None), (901, ""), (902, "Never SEEN before"), (903, "det1 det1 det1"), (None, "det2 noun3"), (5, rows[5][1])]
    rows += [(1000 + i, f"only{i} det1 here{i} noun2") for i in range(20)]
    return rows


def tokens(text):
    return [t.translate(LOW) for t in re.findall(r"[^ \t-\r]+", text or "")]


@pytest.mark.parametrize("head,moved,classes", [(40, 12, 4), (10_000, 60, 6), (5, 3, 3)])
def test_scores_match_plain_computation(spark, monkeypatch, head, moved, classes):
    rows = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    ends = sum(not held(i) for i, _ in rows)
    models = []
    monkeypatch.setattr(class_model, "model_of", lambda *a, _m=class_model.model_of: models.append((a, _m(*a))) or models[-1][1])
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.defaultdict(list)
    for r in class_model.score(frame, head, moved, classes).collect():
        got[r.doc_id].append(r)
    (table, mass, types, n, v, _), model = models[0]
    assert n == sum(counts.values()) + ends and v == len(counts) + 1
    assert mass.sum() == n and types.sum() == v  # every training word has a class
    assert table.sum() == n
    # after any token the probabilities of all words, the end and an unknown word sum to one
    for before in range(classes + 2):
        words = sum(10 ** model.move[before, k] * (mass[k] + 0.5 * types[k]) / 10 ** model.room[k] for k in range(classes + 1))
        assert words + 10 ** model.new[before] == pytest.approx(1)
    # a plain pass over the texts, with the classes read back from the written sequences
    seqs = {}
    _, filled = class_model.learn(frame.select("doc_id", "text"), head, moved, classes)
    for r in filled.collect():
        seqs.setdefault(r.doc_id, list(bytes(r.seq)))
    of = {}
    for i, t in rows:
        for w, k in zip(tokens(t), seqs[i]):
            assert of.setdefault(w, k) == k
            assert (k == class_model.OPEN) == (counts[w] == 0)
    share = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * (classes + 1))
    move = (table + class_model.PULL * share) / (table.sum(axis=1, keepdims=True) + class_model.PULL)
    members = collections.Counter(of[w] for w in counts)
    own = collections.Counter()
    for w, c in counts.items():
        own[of[w]] += c
    own[classes], members[classes] = ends, 1
    wide = [own[k] + 0.5 * (members[k] + 1) for k in range(classes + 1)]
    loose = np.array([share[k] * 0.5 / wide[k] for k in range(classes + 1)])
    after_new = loose / loose.sum() @ move
    for i, t in rows:
        total, before = 0.0, move[classes]
        for w in tokens(t):
            if counts[w]:
                total += math.log10(before[of[w]] * (counts[w] + 0.5) / wide[of[w]])
                before = move[of[w]]
            else:
                total += math.log10(sum(before[k] * 0.5 / wide[k] for k in range(classes + 1)))
                before = after_new
        total += math.log10(before[classes] * (ends + 0.5) / wide[classes])
        assert any(r.score == pytest.approx(total, abs=1e-6) for r in got[i])
    kept = [r for x in got.values() for r in x if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept)


def test_best_class_is_that_of_the_full_likelihood():
    rng = np.random.default_rng(4)
    classes, size = 5, 7
    table = rng.poisson(20, (size, size)).astype(float)
    words, near = 40, rng.poisson(0.8, (40, 2, size)) + 0.0
    near[near.sum(axis=(1, 2)) == 0, 0, 0] = 1
    w, s, c = np.nonzero(near)
    found = class_model.Gains(table, classes).best(w, s, c, near[w, s, c])

    def likelihood(t):
        return class_model._xlogx(t).sum() - class_model._xlogx(t.sum(axis=0)).sum() - class_model._xlogx(t.sum(axis=1)).sum()

    for i in range(words):
        gains = []
        for k in range(classes):
            t = table.copy()
            t[:, k] += near[i, 0]
            t[k] += near[i, 1]
            a, b = likelihood(t), likelihood(table)
            gains.append(a - b)
        assert max(gains) - gains[found[i]] < 1.5  # the class's own cell is counted from both sides apart
