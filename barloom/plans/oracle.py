"""Small builder for oracle SQL: steps of named expressions over the fixture's bars, one CTE each."""

from __future__ import annotations

FIXTURE = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
    arg_min(100.0 + value, ts) AS open, max(100.0 + value) AS high, min(100.0 + value) AS low, arg_max(100.0 + value, ts) AS close, count(*) AS volume
  FROM events GROUP BY 1, 2),
s0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM bars)"""

#: the same bars of all events as one series
FIXTURE_ALL = """bars AS (
  SELECT 'ALL' AS symbol, date_trunc('hour', ts) AS ts,
    first(100.0 + value ORDER BY ts, event_id) AS open, max(100.0 + value) AS high, min(100.0 + value) AS low, last(100.0 + value ORDER BY ts, event_id) AS close, count(*) AS volume
  FROM events GROUP BY 2),
s0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM bars)"""

W = "PARTITION BY symbol ORDER BY ts"
RUN = f"({W} ROWS UNBOUNDED PRECEDING)"
ALL = "(PARTITION BY symbol)"


def fr(w: int, end: str = "CURRENT ROW") -> str:
    return f"({W} ROWS BETWEEN {w - 1} PRECEDING AND {end})"


def roll(call: str, x: str, w: int) -> str:
    """``call`` over a full trailing frame of w non-null x."""
    return f"CASE WHEN count({x}) OVER {fr(w)} = {w} THEN {call} OVER {fr(w)} END"


def avg(x: str, w: int) -> str:
    return roll(f"avg({x})", x, w)


def std(x: str, w: int) -> str:
    return roll(f"stddev_samp({x})", x, w)


def top(x: str, w: int) -> str:
    return roll(f"max({x})", x, w)


def bottom(x: str, w: int) -> str:
    return roll(f"min({x})", x, w)


def total(x: str, w: int) -> str:
    return roll(f"sum({x})", x, w)


def slope(x: str, w: int) -> str:
    return roll(f"regr_slope({x}, rn)", x, w)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({W})"


RET = {"r": f"close / ({lag('close')}) - 1"}
TR = {"tr": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"}


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def sql(*steps: dict[str, str], out: dict[str, str] | list[str], digits: int = 6, keys: tuple[str, ...] = ("symbol", "ts"), where: str = "", more: str = "", source: str = "") -> str:
    """Steps add columns to the bars; ``out`` are the rounded result columns (name: expression over the last step)."""
    ctes = [FIXTURE + more]
    for i, step in enumerate(steps):
        ctes.append(f"s{i + 1} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM s{i})")
    named = out if isinstance(out, dict) else {n: n for n in out}
    columns = [*keys, *(f'round(CAST({e} AS DOUBLE), {digits}) + 0.0 AS "{n}"' for n, e in named.items())]
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {', '.join(columns)} FROM {source or f's{len(steps)}'} {where}"
