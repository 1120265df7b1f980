"""Models over split tables: cross-validated and walk-forward classifiers, multi-target runs, blends, stacking, importances."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import auc_one_vs_rest, scores
from .splits import as_pairs, walk_forward

SIDE_BY_SIDE = 4
DEALT = 100_000  # rows that are dealt anew together


def assembled(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """``features`` vector and ``y`` (0, 1, 2 for -1, 0, 1); incomplete rows are left out."""
    ready = rows.na.drop(subset=[*features, label]).withColumn("y", (F.col(label) + 1).cast("double"))
    return VectorAssembler(inputCols=features, outputCol="features").transform(ready)


def balanced(rows: DataFrame, label: str = "y", name: str = "weight") -> DataFrame:
    """Weights n / (classes * class count), from one small aggregate."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"), F.count("*").alias("__c"))
    table = counts.crossJoin(total).select(label, (F.col("__t") / (F.col("__c") * F.col("__n"))).alias(name))
    return rows.join(F.broadcast(table), label)


def agreement_weight(rows: DataFrame, agreement: str) -> DataFrame:
    return rows.withColumn("weight", 0.5 + 0.5 * F.coalesce(F.col(agreement), F.lit(0.0)))


def forest(trees: int = 100, depth: int = 6, least: int = 3, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed)


def logistic(reg: float = 0.01) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=reg, maxIter=50)


def boosted(rounds: int = 20, depth: int = 3, seed: int = 42) -> OneVsRest:
    """Boosted trees are two-class here, so one model a class: the stand-in for boosting libraries."""
    return OneVsRest(classifier=GBTClassifier(featuresCol="features", labelCol="y", maxIter=rounds, maxDepth=depth, seed=seed), featuresCol="features", labelCol="y")


def perceptron(n_features: int, hidden: tuple[int, ...] = (64, 32), seed: int = 42) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="y", layers=[n_features, *hidden, 3], maxIter=50, seed=seed)


def _probabilities(scored: DataFrame) -> dict[str, Column]:
    if "probability" in scored.columns:
        p = vector_to_array("probability")
        size = F.size(p)
        return {n: F.when(size >= i, F.get(p, i - 1)).otherwise(0.0) for i, n in enumerate(("p_bear", "p_neutral", "p_bull"), 1)}
    raw = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x)))
    total = F.aggregate(raw, F.lit(1e-12), lambda s, x: s + x)
    return {n: F.coalesce(F.get(raw, i), F.lit(0.0)) / total for i, n in enumerate(("p_bear", "p_neutral", "p_bull"))}


def predict(model, rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    scored = model.transform(rows)
    return scored.select(*keep, (F.col("y") - 1).cast("int").alias("true"), (F.col("prediction") - 1).cast("int").alias("pred"), *[c.alias(n) for n, c in _probabilities(scored).items()])


def out_of_fold(rows: DataFrame, splits: DataFrame, estimator: Estimator, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Predictions of every split's test rows by a model of its training rows; ``rows`` has row_id, features, y, weight.

    Splits are a handful; their fits run side by side, ``SIDE_BY_SIDE`` at a time, each of them distributed.
    """

    def one(part: tuple[int, DataFrame, DataFrame]) -> DataFrame:
        split, train, test = part
        model = estimator.fit(rows.join(train, "row_id"))
        return predict(model, rows.join(test, "row_id"), keep).withColumn("split_id", F.lit(split))

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return reduce(DataFrame.union, list(pool.map(one, as_pairs(splits))))


def cross_validated(rows: DataFrame, splits: DataFrame, estimator: Estimator) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and their scores by split."""
    preds = out_of_fold(rows, splits, estimator)
    return preds, scores(preds, ("split_id",))


def multi_target(rows: DataFrame, features: list[str], targets: list[str], estimator: Estimator) -> dict[str, object]:
    """One fitted model a target."""
    return {t: estimator.fit(balanced(assembled(rows, features, t))) for t in targets}


def agreement(rows: DataFrame, primary: str, others: list[str]) -> DataFrame:
    """Add ``agreement``: the share of other labels (missing ones count as 0) that equal the primary one."""
    same = [F.coalesce((F.coalesce(F.col(c), F.lit(0)) == F.col(primary)).cast("double"), F.lit(0.0)) for c in others]
    return rows.withColumn("agreement", sum(same, F.lit(0.0)) / len(others))


def target_scores(rows: DataFrame, features: list[str], targets: list[str], estimator: Estimator, primary: str, others: list[str]) -> DataFrame:
    """(target, accuracy, n) of a model a target on the rows that have all of them, and of the primary target with rows weighted by agreement.

    In-sample accuracies, as published; a model each, fitted side by side.
    """
    ready = agreement(rows.na.drop(subset=targets), primary, others)

    def one(job: tuple[str, str]) -> DataFrame:
        name, target = job
        known = assembled(ready, features, target)
        known = agreement_weight(known, "agreement") if name != target else known.withColumn("weight", F.lit(1.0))
        right = (F.col("prediction") == F.col("y")).cast("double")
        return estimator.fit(known).transform(known).agg(F.avg(right).alias("accuracy"), F.count("*").alias("n")).select(F.lit(name).alias("target"), "accuracy", "n")

    jobs = [(t, t) for t in targets] + [(f"{primary} weighted by agreement", primary)]
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return reduce(DataFrame.union, list(pool.map(one, jobs)))


def blend(parts: dict[str, DataFrame], key: str = "row_id") -> DataFrame:
    """Predictions of several models side by side: <model>_pred and <model>_p_*, with ``true``."""
    out = None
    for name, preds in parts.items():
        one = preds.select(key, *(["true"] if out is None else []), F.col("pred").alias(f"{name}_pred"), *[F.col(p).alias(f"{name}_{p}") for p in ("p_bear", "p_neutral", "p_bull")])
        out = one if out is None else out.join(one, key)
    return out


def stacked(parts: dict[str, DataFrame], key: str = "row_id", splits: DataFrame | None = None) -> DataFrame:
    """Logistic regression over the out-of-fold probabilities of the base models; scored out of fold when given splits."""
    wide = blend(parts, key)
    columns = [c for c in wide.columns if "_p_" in c]
    ready = balanced(assembled(wide, columns, "true")).persist()
    if splits is not None and key == "row_id":
        return out_of_fold(ready, splits, logistic())
    return predict(logistic().fit(ready), ready, (key,))


def walk_forward_regimes(rows: DataFrame, frame, estimator: Estimator, spans: DataFrame, regimes: tuple[str, ...] = ("reversion", "balanced", "momentum")) -> DataFrame:
    """Out-of-sample predictions of each walk-forward regime of a timeframe, with ``regime`` and ``split_id``.

    spans: (row_id, t0, t1); a regime whose windows are longer than the data gives no rows.
    """
    parts = []
    for name in regimes:
        train, test, step = frame.walk(name)
        table = walk_forward(spans, train, test, step)
        if table.limit(1).count():
            parts.append(out_of_fold(rows, table, estimator).withColumn("regime", F.lit(name)))
    if not parts:
        raise ValueError("no walk-forward window fits the data")
    return reduce(DataFrame.union, parts)


def regime_scores(preds: DataFrame) -> DataFrame:
    """Accuracy, macro F1, count, and mean one-vs-rest AUC of each regime."""
    each = auc_one_vs_rest(preds, ("regime",)).groupBy("regime").agg(F.avg("auc").alias("auc"))
    return scores(preds, ("regime",)).join(each, "regime")


def meta_model(preds: DataFrame, share: float = 0.7, keep: float = 0.5) -> DataFrame:
    """Rows of ``preds`` (with confidence, entropy, pred_vol) and ``meta_prob``: how likely the prediction is right.

    ``meta_prob`` is out of sample: the model learns from the first ``share`` of each
    series and scores the rest, of which the likeliest ``keep`` are marked ``kept``.
    """
    columns = ["confidence", "entropy", "pred_vol"]
    rows = preds.na.drop(subset=columns).withColumn("y", (F.col("pred") == F.col("true")).cast("double")).withColumn("weight", F.lit(1.0))
    place = F.percent_rank().over(Window.partitionBy("symbol").orderBy("ts"))
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(rows.withColumn("__place", place)).persist()
    model = logistic().fit(ready.where(F.col("__place") < share))
    late = model.transform(ready.where(F.col("__place") >= share)).withColumn("meta_prob", F.get(vector_to_array("probability"), 1))
    late = late.select(*preds.columns, "meta_prob")
    edge = late.agg(F.percentile("meta_prob", F.lit(1 - keep)).alias("__e"))
    return late.crossJoin(F.broadcast(edge)).withColumn("kept", F.col("meta_prob") >= F.col("__e")).drop("__e")


def permutation_importance(model, rows: DataFrame, features: list[str], repeats: int = 20, seed: int = 42) -> DataFrame:
    """(feature, importance, deviation): accuracy lost when one column is dealt anew.

    Rows fall into random groups of about ``DEALT`` (one group, if there are fewer rows), anew
    for each repeat. A group numbers its rows in two random orders, and joining one numbering
    with the other deals the column anew; all repeats of a feature are one job.
    """
    base, n = model.transform(rows).agg(F.avg((F.col("prediction") == F.col("y")).cast("double")), F.count("*")).first()
    spark = rows.sparkSession
    # rows are told apart by what they hold: equal rows may change places, and a rerun in another order deals the same
    named = rows.select("y", *features).withColumn("__u", F.xxhash64("y", *features))
    groups = max(1, -(-n // DEALT))
    out = []
    for j, f in enumerate(features):
        dealt = []
        for r in range(repeats):
            salts = [F.lit(3 * (seed + 1000 * j + r) + i) for i in range(3)]
            placed = named.withColumn("__g", F.pmod(F.xxhash64("__u", salts[0]), F.lit(groups)))
            one, two = (F.row_number().over(Window.partitionBy("__g").orderBy(F.xxhash64("__u", salt), "__u")) for salt in salts[1:])
            placed = placed.withColumns({"__k": one, "__to": two})
            other = placed.select("__g", F.col("__to").alias("__k"), F.col(f).alias("__new"))
            dealt.append(placed.join(other, ["__g", "__k"]).withColumn(f, F.col("__new")).drop("__new", "__g", "__k", "__to", "__u").withColumn("__rep", F.lit(r)))
        every = VectorAssembler(inputCols=features, outputCol="features").transform(reduce(DataFrame.union, dealt))
        lost = model.transform(every).groupBy("__rep").agg((F.lit(base) - F.avg((F.col("prediction") == F.col("y")).cast("double"))).alias("d"))
        row = lost.agg(F.avg("d"), F.stddev_pop("d")).first()
        out.append((f, float(row[0]), float(row[1])))
    return spark.createDataFrame(out, "feature string, importance double, deviation double")


def path_contributions(model, rows: DataFrame, n_features: int, target: int, key: str = "row_id", limit: int | None = None) -> DataFrame:
    """(key, feature index, contribution): how each split on a row's way through each tree moves the class probability, averaged over the trees.

    The forest travels as plain arrays; rows are walked in Arrow batches.
    """
    trees = [_tree_arrays(t, target) for t in model.trees]
    sent = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, n_features)
            total = np.zeros((len(x), n_features))
            for feature, threshold, left, right, value in sent.value:
                at = np.zeros(len(x), np.int64)
                live = np.flatnonzero(left[at] >= 0)
                while len(live):
                    node = at[live]
                    go = np.where(x[live, feature[node]] <= threshold[node], left[node], right[node])
                    np.add.at(total, (live, feature[node]), value[go] - value[node])
                    at[live] = go
                    live = live[left[go] >= 0]
            total /= len(sent.value)
            n = len(x)
            yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(n), n_features))), pa.array(np.tile(np.arange(n_features, dtype=np.int32), n)), pa.array(total.ravel())], names=[key, "feature", "contribution"])

    chosen = rows.select(F.col(key).cast("long").alias(key), vector_to_array("features").alias("x"))
    if limit:
        chosen = chosen.orderBy(F.xxhash64(key)).limit(limit)
    return chosen.mapInArrow(run, f"{key} long, feature int, contribution double")


def _tree_arrays(tree, target: int):
    import numpy as np

    feature, threshold, left, right, value = [], [], [], [], []

    def walk(node) -> int:
        i = len(feature)
        counts = list(node.impurityStats().stats())
        feature.append(0)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        value.append(counts[target] / max(sum(counts), 1e-12) if target < len(counts) else 0.0)
        if node.subtreeDepth() > 0:
            split = node.split()
            feature[i], threshold[i] = split.featureIndex(), split.threshold()
            left[i] = walk(node.leftChild())
            right[i] = walk(node.rightChild())
        return i

    walk(tree._call_java("rootNode"))
    return tuple(np.array(a) for a in (feature, threshold, left, right, value))


