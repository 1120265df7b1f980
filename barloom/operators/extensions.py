"""Signal extensions: reversion, conviction, divergence, risk size, regime filter, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import before, flag

MODELS = ("rf", "xgb", "lgb", "logit", "mlp")
BULL, BEAR = "ensemble_prob_bull", "ensemble_prob_bear"


def reversion(rows: DataFrame, lookback: int = 10, extreme: float = 0.75, move: float = 0.005, price: str = "price") -> DataFrame:
    """Long where the bear probability is extreme but the price hasn't dropped, short the other way round."""
    rows = rows.withColumn("price_pct_change", F.try_divide(F.col(price), before(price, lookback)) - 1)
    change = F.col("price_pct_change")
    rows = rows.withColumns({"reversion_long": flag((F.col(BEAR) > extreme) & (change > -move)), "reversion_short": flag((F.col(BULL) > extreme) & (change < move))})
    rows = rows.withColumn("reversion_signal", F.col("reversion_long") - F.col("reversion_short"))
    s = F.col("reversion_signal")
    return rows.withColumn("reversion_strength", F.when(s == 1, F.col(BEAR) + change).when(s == -1, F.col(BULL) - change).otherwise(0.0))


def conviction(rows: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Bull less bear probability of each model and the ensemble, agreement share, and zones closed on the right (exactly -1: NULL)."""
    there = [m for m in models if {f"{m}_prob_bull", f"{m}_prob_bear"} <= set(rows.columns)]
    rows = rows.withColumns({f"{m}_conviction": F.col(f"{m}_prob_bull") - F.col(f"{m}_prob_bear") for m in there} | {"ensemble_conviction": F.col(BULL) - F.col(BEAR)})
    if there:
        bulls, bears = (sum((flag(F.col(f"{m}_conviction") * s > 0) for m in there), F.lit(0)) for s in (1, -1))
        rows = rows.withColumns({"models_bullish": bulls, "models_bearish": bears})
        rows = rows.withColumn("conviction_agreement", F.greatest("models_bullish", "models_bearish") / len(there))
    c = F.col("ensemble_conviction")
    zone = F.when((c <= -1) | (c > 1), None).when(c <= -0.3, "Strong Bear").when(c <= -0.1, "Moderate Bear").when(c <= 0.1, "Neutral").when(c <= 0.3, "Moderate Bull").when(c <= 1, "Strong Bull")
    return rows.withColumn("conviction_zone", zone)


def divergences(rows: DataFrame, lookback: int = 5, prob: float = 0.55, move: float = 0.003, price: str = "price") -> DataFrame:
    rows = rows.withColumn("price_return", F.try_divide(F.col(price), before(price, lookback)) - 1)
    r = F.col("price_return")
    rows = rows.withColumns({"bearish_divergence": F.coalesce((F.col(BEAR) > prob) & (r > move), F.lit(False)), "bullish_divergence": F.coalesce((F.col(BULL) > prob) & (r < -move), F.lit(False))})
    return rows.withColumn("divergence_intensity", F.when(F.col("bearish_divergence"), F.col(BEAR) * r).when(F.col("bullish_divergence"), -F.col(BULL) * r).otherwise(0.0))


def risk_size(rows: DataFrame, base: float = 1.0, penalty: float = 0.5, bonus: float = 0.3, least: float = 0.1, most: float = 2.0) -> DataFrame:
    """Size less for opposing probability, more for conviction over 0.4 (if there is a conviction column), inside [least, most]."""
    if "signal" not in rows.columns:
        rows = rows.withColumn("signal", F.signum("ensemble_conviction") if "ensemble_conviction" in rows.columns else F.lit(0.0))
    strength = F.abs("ensemble_conviction") if "ensemble_conviction" in rows.columns else F.lit(0.0)
    rows = rows.withColumns({"opposing_prob": F.when(F.col("signal") == 1, F.col(BEAR)).when(F.col("signal") == -1, F.col(BULL)).otherwise(0.5), "conviction_strength": strength})
    extra = F.when(F.col("conviction_strength") > 0.4, (F.col("conviction_strength") - 0.4) * bonus).otherwise(0.0)
    rows = rows.withColumn("position_size", F.least(F.greatest(base - F.col("opposing_prob") * penalty + extra, F.lit(least)), F.lit(most)))
    return rows.withColumn("sized_signal", F.col("signal") * F.col("position_size"))


def regime_filter(rows: DataFrame, rules: DataFrame | None = None, regime: str = "Regime_Combo", long_bear_max: float = 0.4, short_bull_max: float = 0.4) -> DataFrame:
    """Longs need a low bear, shorts a low bull probability; ``rules`` (regime, allow_longs, allow_shorts) can forbid more."""
    signal = F.col("signal")
    out = F.when((signal == 1) & (F.col(BEAR) < long_bear_max), 1).when((signal == -1) & (F.col(BULL) < short_bull_max), -1).otherwise(0)
    rows = rows.withColumn("filtered_signal", out)
    if rules is not None:
        rows = rows.join(F.broadcast(rules.withColumnRenamed("regime", regime)), regime, "left")
        banned = ((signal == 1) & ~F.coalesce("allow_longs", F.lit(True))) | ((signal == -1) & ~F.coalesce("allow_shorts", F.lit(True)))
        rows = rows.withColumn("filtered_signal", F.when(banned, 0).otherwise(F.col("filtered_signal"))).drop("allow_longs", "allow_shorts")
    return rows.withColumn("was_filtered", signal != F.col("filtered_signal"))


def run_all(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Every extension. Sizing sees the plain input, so it gives no conviction bonus."""
    sized = risk_size(rows.drop("ensemble_conviction")).drop("ensemble_conviction")
    return sized.transform(reversion).transform(conviction).transform(divergences).transform(lambda d: regime_filter(d, rules))


def summary(rows: DataFrame, key: str) -> DataFrame:
    """Rows, mean conviction and mean size of each value of ``key``."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.avg("ensemble_conviction").alias("mean_conviction"), F.avg("position_size").alias("mean_size"))
