"""Whole feature modules in one plan, against the joined oracles of the panels that their columns have.

Columns whose panel shows a safe form (a smaller ``min_periods``, the level before the bar) while the
module keeps the published one are left to their panels: traps, fractal lines, tail and skew
volatility, and the runs of the combined regime.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calendar, regimes, structure, trend, volatility
from .registry import ORACLES, PANELS, hourly, query

def module(name: str, build: Callable[[DataFrame], DataFrame], panels: list[str]) -> None:
    """Register a module's columns as far as ``panels`` have them; each column is rounded as its panel is."""
    owner: dict[str, str] = {}
    for panel in panels:
        for c in PANELS[panel][0]:
            owner.setdefault(c, panel)
    used = [p for p in panels if p in owner.values()]
    tables = " JOIN ".join(f"({ORACLES[p]}) t{i}" + (" USING (symbol, ts)" if i else "") for i, p in enumerate(used))
    columns = ", ".join(f't{used.index(p)}."{c}"' for c, p in owner.items())

    def run(spark, d: str) -> DataFrame:
        rows = build(hourly(spark, d))
        return rows.select("symbol", "ts", *[(F.round(F.col(c).cast("double"), PANELS[p][1]) + F.lit(0.0)).alias(c) for c, p in owner.items()])

    query(name, f"SELECT symbol, ts, {columns} FROM {tables}")(run)


MODULES: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {
    "structure_module": (structure.add_structure, ["swings", "support_resistance", "pos_in_range", "ranges", "session_range", "candles", "breakouts", "compression", "impulse", "rejection", "structure_regime"]),
    "volatility_module": (volatility.add_volatility, [
        "ewma_vol", "parkinson", "garman_klass", "rogers_satchell", "yang_zhang", "vol_of_vol", "vol_cluster", "shock_recovery", "up_down_vol", "bipower_jump", "extreme_move", "vol_kurtosis", "vol_convexity", "vol_transforms",
    ]),
    "trend_module": (lambda bars: trend.add_trend(trend.prelim(bars)), [
        "sma_panel", "wma_panel", "hma", "stochastic", "roc", "williams_r", "cmo", "ultimate", "awesome", "reg_slope", "reg_r2", "reg_deviation", "curvature", "acceleration", "slope_flip", "dpo", "persistence", "noise_ratio", "vol_adjusted_slope",
        "trend_strength", "local_extrema", "extension", "bb_width", "trend_consistency", "ema", "rsi", "tema", "kama", "trix", "tsi", "divergence", "true_range_atr",
    ]),
    "calendar_module": (calendar.add_calendar, ["calendar_fields", "calendar_one_hots", "turn_of_month", "holiday_distance", "seasonal_return"]),
    "regimes_module": (lambda bars: regimes.add_regimes(volatility.ewma(trend.prelim(bars))), ["ewma_vol", "true_range_atr", "trend_regime", "vol_regime"]),
}

for _name, (_build, _panels) in MODULES.items():
    module(_name, _build, _panels)
