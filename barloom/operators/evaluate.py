"""Evaluation of predictions: confusion, scores, AUC, curves, calibration, Brier parts, stability, interactions, effect sizes.

Predictions are (true, pred) with class probabilities p_bear, p_neutral, p_bull for the
classes -1, 0, 1, and whatever groups them (fold, regime, window).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import count_equal
from ..functions.running import running_sums, unit_bins

CLASSES = (-1, 0, 1)


def confusion(preds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return preds.groupBy(*by, "true", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(preds: DataFrame) -> DataFrame:
    """One row a true class, one column a predicted one."""
    return preds.groupBy("true").pivot("pred", list(CLASSES)).count().na.fill(0)


def class_scores(preds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class, 0 where undefined; from the confusion counts, so one small shuffle."""
    n = confusion(preds, by)
    support = n.groupBy(*by, F.col("true").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    called = n.groupBy(*by, F.col("pred").alias("class")).agg(F.sum("n").alias("called"))
    both = support.join(called, [*by, "class"], "full").na.fill(0, ["support", "hits", "called"])
    precision, recall = (F.coalesce(F.try_divide("hits", c), F.lit(0.0)) for c in ("called", "support"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return both.select(*by, "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def scores(preds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, macro F1 over the classes seen, and support-weighted precision, recall, F1."""
    each = class_scores(preds, by)
    n = F.sum("support")
    return each.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("recall") * F.col("support")), n).alias("accuracy"), F.avg("f1").alias("f1_macro"), F.try_divide(F.sum(F.col("precision") * F.col("support")), n).alias("precision_weighted"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), n).alias("f1_weighted"), n.alias("n"),
    )


def auc(preds: DataFrame, score: str, positive: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums, ties sharing their mean rank.

    Rows are first counted by distinct score; the ordered sums over scores run bin by bin
    (balanced for scores from 0 to 1, right for any).
    """
    counts = preds.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    below = running_sums(counts, "s", {"below": F.col("neg")}, by, here=False, bin_of=unit_bins(F.col("s")))
    return below.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def auc_one_vs_rest(preds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of each class, and their mean."""
    long = preds.select(*by, "true", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(p).alias("p")) for c, p in zip(CLASSES, ("p_bear", "p_neutral", "p_bull"), strict=True)])).alias("x"))
    return auc(long.select(*by, "x.class", "x.p", "true"), "p", F.col("true") == F.col("class"), (*by, "class"))


def roc_curve(preds: DataFrame, score: str, positive: Column) -> DataFrame:
    """(threshold, tpr, fpr, precision): cumulative counts down the distinct scores, bin by bin."""
    counts = preds.groupBy(F.col(score).alias("threshold")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    totals = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    rows = running_sums(counts, "threshold", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True, bin_of=unit_bins(F.col("threshold"))).crossJoin(F.broadcast(totals))
    return rows.select("threshold", F.try_divide("tp", "all_pos").alias("tpr"), F.try_divide("fp", "all_neg").alias("fpr"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"))


def rolling_error(preds: DataFrame, w: int = 50, by: tuple[str, ...] = ("symbol",), per_class: bool = False) -> DataFrame:
    """Share of misses in a full window; ``per_class``: over each true class's own rows, a third of the window and one value being enough."""
    miss = (F.col("pred") != F.col("true")).cast("double")
    keys = (*by, "true") if per_class else by
    size = max(1, w // 3) if per_class else w
    frame = Window.partitionBy(*keys).orderBy("ts").rowsBetween(-(size - 1), 0)
    need = 1 if per_class else size
    return preds.withColumn("rolling_error", F.when(F.count(F.lit(1)).over(frame) >= need, F.avg(miss).over(frame)))


def error_by(preds: DataFrame, key: str) -> DataFrame:
    return preds.groupBy(key).agg(F.avg((F.col("pred") != F.col("true")).cast("double")).alias("error"), F.count("*").alias("n"))


def calibration(preds: DataFrame, prob: str, positive: Column, bins: int = 10, right_closed: bool = False) -> DataFrame:
    """Uniform bins of a probability: mean prediction, share of positives, count."""
    p = F.col(prob)
    bin_ = F.greatest(F.lit(1), F.ceil(p * bins)) - 1 if right_closed else F.least(F.floor(p * bins), F.lit(bins - 1))
    return preds.groupBy(bin_.cast("int").alias("bin")).agg(F.avg(p).alias("mean_prob"), F.avg(positive.cast("double")).alias("share"), F.count("*").alias("n"))


def brier(preds: DataFrame, prob: str, positive: Column, bins: int = 10) -> DataFrame:
    """Brier score and its parts: reliability, resolution, uncertainty."""
    rows = preds.select(F.col(prob).alias("p"), positive.cast("double").alias("y"))
    whole = rows.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg("y").alias("base"), F.count("*").alias("total"))
    each = calibration(rows, "p", F.col("y"), bins, True)
    parts = each.crossJoin(F.broadcast(whole)).agg(
        F.first("brier").alias("brier"), F.sum(F.col("n") / F.col("total") * F.pow(F.col("mean_prob") - F.col("share"), 2)).alias("reliability"),
        F.sum(F.col("n") / F.col("total") * F.pow(F.col("share") - F.col("base"), 2)).alias("resolution"), F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    )
    return parts


def probability_shape(preds: DataFrame) -> DataFrame:
    """Mean entropy (bits), sharpness (mean largest probability), over-confidence of misses, and the gap between confidence and accuracy."""
    probs = ("p_bear", "p_neutral", "p_bull")
    entropy = -sum((F.col(p) * F.log2(F.col(p) + 1e-12) for p in probs), F.lit(0.0))
    top, miss = F.greatest(*probs), F.col("pred") != F.col("true")
    return preds.agg(F.avg(entropy).alias("entropy"), F.avg(top).alias("sharpness"), F.avg(F.when(miss, top)).alias("overconfidence"), (F.avg(top) - F.avg((~miss).cast("double"))).alias("confidence_gap"))


def feature_stability(rows: DataFrame, features: list[str], target: str, fold: str) -> DataFrame:
    """(feature, mean_corr, std_corr): correlation with the target inside each fold, then over folds."""
    long = rows.select(fold, F.col(target).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("z"))
    each = long.groupBy(fold, "z.feature").agg(F.corr("z.x", "y").alias("c"))
    return each.groupBy("feature").agg(F.avg("c").alias("mean_corr"), F.stddev_samp("c").alias("std_corr"), F.count("c").alias("n_folds"))


def target_correlations(rows: DataFrame, features: list[str], target: str, k: int | None = None) -> DataFrame:
    """(feature, corr), strongest first if ``k`` asks for a top list: one aggregate over the table."""
    sums = rows.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    out = sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("corr")) for f in features])).alias("x")).select("x.*")
    return out.orderBy(F.desc(F.abs("corr")), "feature").limit(k) if k else out


#: Prefixes that name a feature's group, in order; a name that has none goes by what it contains.
GROUP_PREFIXES = ("TA_", "VOL_", "MOM_", "REGIME_", "LBL_", "RET_", "PRICE_", "RSI", "MACD", "BB_", "ATR", "ADX", "OBV", "VWAP")
GROUP_PARTS = (("regime", "REGIME"), ("vol", "VOL"), ("ret", "RET"))


def feature_group(name: Column) -> Column:
    upper = F.upper(name)
    out = None
    for prefix in GROUP_PREFIXES:
        test, group = upper.startswith(prefix), F.lit(prefix.rstrip("_"))
        out = F.when(test, group) if out is None else out.when(test, group)
    for part, group in GROUP_PARTS:
        out = out.when(F.lower(name).contains(part), F.lit(group))
    return out.otherwise("OTHER")


def group_correlations(found: DataFrame) -> DataFrame:
    """(group, n_features, mean_corr, std_corr, mean_abs_corr) of (feature, corr); features without a correlation don't count."""
    there = found.where("corr is not null and not isnan(corr)")
    return there.groupBy(feature_group(F.col("feature")).alias("group")).agg(F.count("*").alias("n_features"), F.avg("corr").alias("mean_corr"), F.stddev_samp("corr").alias("std_corr"), F.avg(F.abs("corr")).alias("mean_abs_corr"))


def label_correlations(rows: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """(feature, label, corr) of all features with all labels, one aggregate over the table."""
    pairs = [(f, y) for f in features for y in labels]
    sums = rows.agg(*[F.corr(F.col(f).cast("double"), F.col(y).cast("double")).alias(f"c{i}") for i, (f, y) in enumerate(pairs)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(y).alias("label"), F.col(f"c{i}").alias("corr")) for i, (f, y) in enumerate(pairs)])).alias("x")).select("x.*")


def consensus_features(found: DataFrame) -> DataFrame:
    """(feature, mean_abs_corr, std_corr, n_labels): strong across labels by the mean, tied to some of them by the deviation."""
    return found.where("corr is not null and not isnan(corr)").groupBy("feature").agg(F.avg(F.abs("corr")).alias("mean_abs_corr"), F.stddev_samp("corr").alias("std_corr"), F.count("*").alias("n_labels"))


def weak_features(found: DataFrame, limit: float = 0.02) -> DataFrame:
    """Features whose absolute correlation stays under ``limit``, with their share of all."""
    there = found.where("corr is not null and not isnan(corr)")
    total = there.agg(F.count("*").alias("__n"), F.count_if(F.abs("corr") < limit).alias("__k"))
    return there.where(F.abs("corr") < limit).crossJoin(F.broadcast(total)).select("feature", "corr", (F.col("__k") / F.col("__n")).alias("share"))


def uncorrelated(rows: DataFrame, features: list[str], limit: float = 0.95) -> list[str]:
    """Features kept when, in order, each that correlates over the limit with a kept one goes."""
    from .labels import correlations

    high = {(r["a"], r["b"]) for r in correlations(rows, features, limit).collect()}
    kept: list[str] = []
    for f in features:
        if not any((k, f) in high for k in kept):
            kept.append(f)
    return kept


# ---- interactions and effect sizes


def dependence(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(beta, r2, t, n): y on standardised x."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).cast("double")
    out = rows.agg((F.regr_slope(y, x) * F.sqrt(F.regr_sxx(y, x) / n)).alias("beta"), F.regr_r2(y, x).alias("r2"), n.alias("n"))
    t = F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2"))) * F.signum("beta")
    return out.withColumn("t", t)


def t_tail(t: float, df: float) -> float:
    """Two-sided probability of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def quartile_effect(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Cohen's d of y between the top and bottom quarter of x, with both means and counts."""
    edges = rows.agg(F.percentile(x, F.lit(0.25)).alias("q1"), F.percentile(x, F.lit(0.75)).alias("q3"))
    marked = rows.crossJoin(F.broadcast(edges)).withColumns({"low": F.when(F.col(x) <= F.col("q1"), F.col(y)), "high": F.when(F.col(x) >= F.col("q3"), F.col(y))})
    n1, n4, v1, v4 = F.count("low"), F.count("high"), F.var_samp("low"), F.var_samp("high")
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n4 - 1) * v4, n1 + n4 - 2))
    return marked.agg(F.avg("low").alias("mean_low"), F.avg("high").alias("mean_high"), F.try_divide(F.avg("high") - F.avg("low"), pooled).alias("cohens_d"), n1.alias("n_low"), n4.alias("n_high"))


def conditional_effects(rows: DataFrame, features: list[str], values: dict[str, str]) -> DataFrame:
    """(x, given, effect_low, effect_high, strength): mean contribution of x where ``given`` is below and above its median, for each ordered pair.

    Medians are one aggregate, sent to the rows; all pairs are one more aggregate.
    """
    medians = rows.agg(*[F.percentile(f, F.lit(0.5)).alias(f"__m_{f}") for f in features])
    every = rows.crossJoin(F.broadcast(medians))
    pairs = [(a, b) for a in features for b in features if a != b]
    sums = every.agg(*[x for i, (a, b) in enumerate(pairs) for x in (
        F.avg(F.when(F.col(b) <= F.col(f"__m_{b}"), F.col(values[a]))).alias(f"l{i}"), F.avg(F.when(F.col(b) > F.col(f"__m_{b}"), F.col(values[a]))).alias(f"h{i}"))])
    out = sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("given"), F.col(f"l{i}").alias("effect_low"), F.col(f"h{i}").alias("effect_high")) for i, (a, b) in enumerate(pairs)])).alias("z")).select("z.*")
    return out.withColumn("strength", F.abs(F.col("effect_high") - F.col("effect_low")))


# ---- combining models


def vote(rows: DataFrame, columns: list[str], name: str = "vote") -> DataFrame:
    """Commonest class, the smallest on a tie."""
    votes = F.array(*[F.col(c).cast("int") for c in columns])
    counts = [F.struct(count_equal(votes, s).alias("n"), F.lit(-s).alias("m")) for s in CLASSES]
    return rows.withColumn(name, -F.greatest(*counts)["m"])


def mean_probability(rows: DataFrame, models: list[str]) -> DataFrame:
    return rows.withColumns({f"ensemble_{p}": sum((F.col(f"{m}_{p}") for m in models), F.lit(0.0)) / len(models) for p in ("p_bear", "p_neutral", "p_bull")})


def best_by_regime(rows: DataFrame, models: list[str], regime: str) -> DataFrame:
    """Each regime's most accurate model (the first by name on a tie) and its prediction on every row."""
    long = rows.select(regime, "true", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in sorted(models)])).alias("x"))
    acc = long.groupBy(regime, "x.model").agg(F.avg((F.col("x.p") == F.col("true")).cast("double")).alias("accuracy"))
    best = acc.groupBy(regime).agg(F.min(F.struct((-F.col("accuracy")).alias("a"), "model")).alias("b")).select(regime, F.col("b.model").alias("best_model"))
    pick = F.coalesce(*[F.when(F.col("best_model") == m, F.col(m)) for m in models])
    return rows.join(F.broadcast(best), regime).withColumn("regime_pred", pick)


def meta_features(preds: DataFrame, w: int = 20) -> DataFrame:
    """Confidence, entropy, and the rolling deviation of the predictions."""
    probs = ("p_bear", "p_neutral", "p_bull")
    frame = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(w - 1), 0)
    pred = F.col("pred").cast("double")
    return preds.withColumns({
        "confidence": F.greatest(*probs), "entropy": -sum((F.col(p) * F.log(F.col(p) + 1e-12) for p in probs), F.lit(0.0)), "pred_vol": F.when(F.count(pred).over(frame) == w, F.stddev_samp(pred).over(frame)),
    })


def keep_confident(rows: DataFrame, prob: str, share: float = 0.7) -> DataFrame:
    """Rows whose probability is at least the (1 - share) quantile."""
    edge = rows.agg(F.percentile(prob, F.lit(1 - share)).alias("__e"))
    return rows.crossJoin(F.broadcast(edge)).where(F.col(prob) >= F.col("__e")).drop("__e")
