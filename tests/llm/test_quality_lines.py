"""Training takes all lines of a sampled document."""

import pytest

pytest.importorskip("barloom.llm.queries")

from barloom.llm import quality


def test_training_sees_lines_past_the_first_400(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, n: seen.append((sorted(r.text.count("\n") + 1 for r in rows.collect()), n)))
    text = lambda n: "\n".join(f"line {k} of a text." for k in range(n))
    docs = spark.createDataFrame([(i, text(450 if i % 2 else 3)) for i in range(40)], "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int"))
    lines, n = seen[0]
    assert max(lines) == 450 and len(lines) == n > 20 and set(lines) == {3, 450}


def test_gradient_matches_differences():
    import numpy as np
    import pyarrow as pa

    from barloom.llm.common import TextBlock

    rng = np.random.default_rng(5)
    texts = ["Good words here.\n%% || 42\nMore of it", "||", "", "a b a b\n\n%%%%\nEnd. 7", "x\ny"]
    lines = quality.line_features(TextBlock(pa.array(texts)))
    label = np.array([1, 0, 1, 0, 1])
    theta = np.concatenate((rng.normal(0, 0.5, quality.N_FEATURES + 4), [1.4, -0.3]))
    value, grad = quality.learn(quality.chain_of(theta), *lines, label)
    assert np.allclose(value, np.log(np.where(label > 0, 1, -1) * quality.sigmoid(1.4 * quality.raw_quality(quality.chain_of(theta), *lines) - 0.3) + (label == 0)))
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-5
        up, down = (quality.learn(quality.chain_of(theta + d), *lines, label)[0] for d in (step, -step))
        assert np.allclose(grad[:, k], (up - down) / 2e-5, atol=1e-6), k


def test_sums_do_not_depend_on_partitions(spark):
    import numpy as np

    rows = spark.createDataFrame([(f"line {i}\n%% || {i % 7}\n" * (i % 5), i % 2, 1 + i % 3) for i in range(300)], "text string, y int, n long")
    chain = quality.chain_of(np.random.default_rng(2).normal(0, 0.4, quality.N_PARAMETERS))
    one, many = quality.sums(rows.coalesce(1), chain), quality.sums(rows.repartition(7), chain)
    assert one[0] == many[0] and (one[1] == many[1]).all() and (one[2] == many[2]).all()


def test_documents_of_two_halves_get_two_kinds_of_lines(spark):
    """Trained on documents' labels alone, lines of a good and of a bad half are told apart, in either order."""
    import random

    rng = random.Random(8)
    words = ["river", "stone", "letter", "garden", "window", "paper", "morning"]
    good = lambda: " ".join(rng.choice(words) for _ in range(11)).capitalize() + "."
    bad = lambda: " | ".join(rng.choice(words) + "%%" for _ in range(5))
    text = lambda share, n: "\n".join(good() if rng.random() < share else bad() for _ in range(n))
    rows = [(i, text(0.85 if i % 2 else 0.15, rng.randrange(4, 12))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = quality.train(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int"))
    mixed = [(k, "\n".join([*(good() for _ in range(6)), *(bad() for _ in range(6))] if k % 2 else [*(bad() for _ in range(6)), *(good() for _ in range(6))])) for k in range(20)]
    out = quality.label_lines(spark.createDataFrame(mixed, "doc_id long, text string"), chain).collect()
    assert len(out) == 240 and all(r.n_bytes == len(mixed[r.doc_id][1].split("\n")[r.line].encode()) for r in out)
    right = sum(r.label == int((r.line < 6) == (r.doc_id % 2 == 1)) for r in out)
    assert right >= 0.95 * len(out), right


def test_score_matches_plain_forward_backward(spark):
    """Scores from features, weights and moves by products of plain probabilities, line after line."""
    import math
    import random

    import numpy as np
    import pyarrow as pa

    from barloom.llm import quality
    from barloom.llm.common import TextBlock

    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice(["good", "words", "%%", "||", "Here", "42"]) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 6))) for _ in range(30)] + ["", None]
    weights = np.random.default_rng(1).normal(0, 0.6, quality.N_FEATURES)
    move = np.array([[0.7, -0.4], [-0.2, 0.9]])
    chain = quality.Chain(weights, move, 1.3, -0.2)
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect()}
    for i, text in enumerate(texts):
        features, length, _ = quality.line_features(TextBlock(pa.array([text], pa.string())))
        assert length.tolist() == [len(line.encode()) + 1 for line in (text or "").split("\n")]
        local = [(1.0, math.exp(float(f @ weights))) for f in features]
        n, ahead, back = len(local), [local[0]], [(1.0, 1.0)]
        for t in range(1, n):
            ahead.append(tuple(sum(ahead[-1][a] * math.exp(move[a, b]) for a in (0, 1)) * local[t][b] for b in (0, 1)))
        for t in range(n - 1, 0, -1):
            back.insert(0, tuple(sum(math.exp(move[a, b]) * local[t][b] * back[0][b] for b in (0, 1)) for a in (0, 1)))
        good = [ahead[t][1] * back[t][1] / sum(ahead[t][k] * back[t][k] for k in (0, 1)) for t in range(n)]
        raw = sum(g * w for g, w in zip(good, length.tolist())) / sum(length.tolist())
        raw = min(max(raw, 1e-6), 1 - 1e-6)
        assert abs(got[i] - 1 / (1 + math.exp(-(1.3 * math.log(raw / (1 - raw)) - 0.2)))) < 1e-9


def test_training_with_repeated_ids_and_labels(spark):
    from barloom.llm import quality

    docs = spark.createDataFrame([(i % 40, f"line of text {i % 40}\nand %% || {i % 3}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    first = {(r.doc_id, r.score) for r in quality.classify(docs, labels).collect()}
    assert first == {(r.doc_id, r.score) for r in quality.classify(docs.repartition(5), labels.repartition(3)).collect()}
