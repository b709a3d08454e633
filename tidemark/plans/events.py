"""Signals built on other plans: crossings, signed candles, divergence, classified gaps."""

from __future__ import annotations

from dataclasses import replace

from tidemark.functions.expressions import CUM, KEY, lag, over, roll, sma, xdn, xup
from tidemark.plans.indicators import PLANS
from tidemark.plans.staged import Plan

BEFORE = f"({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
LATER = "(PARTITION BY symbol ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
NEUTRAL = ("doji", "doji_long_legged", "spinning_top")


def then(name: str, *layers: dict[str, str]) -> Plan:
    """The named plan with further layers; the last one's columns, as they are, are the result."""
    base = PLANS[name]
    return replace(base, out=list(layers[-1]), stages=[*base.stages, *layers], flags=True)


def crossing(name: str, prefix: str, a: str, b: str, kinds: tuple[str, str] = ("bull_cross", "bear_cross"), also: str = "true") -> Plan:
    """Where column a of the named plan crosses b, up and down."""
    up, down = (f"{prefix}_{k}" for k in kinds)
    return then(name, {up: f"{xup(a, b)} AND coalesce({also}, false)", down: f"{xdn(a, b)} AND coalesce({also}, false)"})


def candle_signals() -> Plan:
    directed = [c[3:] for c in PLANS["candles"].out if c[3:] not in NEUTRAL]
    out = {f"candle_{c}": f"is_{c}" for c in directed}
    for c in NEUTRAL:
        out |= {f"candle_{c}_after_{side}": f"is_{c} AND coalesce({side}_1, false)" for side in ("up", "down")}
    return then("candles", out)


def divergence(bars: int = 3, lookback: int = 60) -> Plan:
    """A swing of the close is confirmed ``bars`` bars later; RSI goes the other way by 2 points since the swing before."""
    layers: list[dict[str, str]] = [{"n": f"row_number() OVER ({KEY})", "at_c": lag("close", bars), "at_r": lag("rsi", bars), "lo": roll("min", "close", 2 * bars + 1), "hi": roll("max", "close", 2 * bars + 1)}]
    sides = {"bull": ("lo", "<", ">", "+ 2", "< 40"), "bear": ("hi", ">", "<", "- 2", "> 60")}
    layers.append({f"{s}_{k}": f"CASE WHEN at_c = {x[0]} THEN {v} END" for s, x in sides.items() for k, v in (("c", "at_c"), ("r", "at_r"), ("n", "n"))})
    layers.append({f"{s}_{k}0": f"max_by({s}_{k}, CASE WHEN {s}_{k} IS NOT NULL THEN n END) OVER {BEFORE}" for s in sides for k in "crn"})
    layers.append({f"rsi_{s}_divergence": f"coalesce({s}_n - {s}_n0 <= {lookback} AND {s}_c {x[1]} {s}_c0 AND {s}_r {x[2]} {s}_r0 {x[3]} AND {s}_r0 {x[4]}, false)" for s, x in sides.items()})
    return then("rsi", *layers)


def gap_kinds() -> Plan:
    """Bars that leave a gap: exhaustion, breakaway, runaway or common, by what was known on the bar before; filled if a later bar closes it."""
    adx = PLANS["adx"]
    first = {**adx.stages[0], "c1": lag("close"), "h1": lag("high"), "l1": lag("low"), "s20": lag("ma20"), "s50": lag("ma50"), "hh": over("max", "high", -20, -1), "ll": over("min", "low", -20, -1)}
    second = {**adx.stages[1], "u": "CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0D) END", "d": "CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0D) END", "side": "CASE WHEN low > h1 THEN 1 WHEN high < l1 THEN -1 END"}
    third = {**adx.stages[2], "rsi": "CASE WHEN ed = 0 THEN 100D ELSE 100 - 100 / (1 + eu / ed) END"}
    known = {"a1": lag("et"), "r1": lag("rsi"), "x1": lag("adx"), "edge": "CASE side WHEN 1 THEN h1 WHEN -1 THEN l1 END", "low_later": f"min(low) OVER {LATER}", "high_later": f"max(high) OVER {LATER}"}
    over_done = "side * (c1 - s20) > 3 * a1 OR CASE side WHEN 1 THEN r1 > 70 ELSE r1 < 30 END"
    clears = "CASE side WHEN 1 THEN low > hh ELSE high < ll END AND x1 < 25"
    trend = "side * (c1 - s50) > 0 AND side * (s20 - s50) > 0"
    kind = {"kind": f"CASE WHEN side IS NULL THEN NULL WHEN {over_done} THEN 'exhaustion' WHEN {clears} THEN 'breakaway' WHEN {trend} THEN 'runaway' ELSE 'common' END"}
    out = {"gap_kind": "kind", "gap_side": "side", "gap_bias": "CASE WHEN kind = 'exhaustion' THEN -side ELSE side END", "gap_edge": "edge", "gap_filled": "CASE side WHEN 1 THEN coalesce(low_later <= edge, false) WHEN -1 THEN coalesce(high_later >= edge, false) END"}
    ema = {2: adx.ema[1] | {"eu": ("u", 1 / 14, 14), "ed": ("d", 1 / 14, 14)}, 4: adx.ema[3]}
    return Plan(list(out), [{"ma20": sma("close", 20), "ma50": sma("close", 50)}, first, second, third, adx.stages[3], known, kind, out], ema, flags=True)


def trend_age() -> Plan:
    """Bars since the close last crossed its 50-bar average."""
    return then("regime", {"n": f"row_number() OVER ({KEY})", "side": "CASE WHEN close > s50 THEN 1 WHEN close <= s50 THEN -1 END"}, {"turned": f"CASE WHEN side <> {lag('side')} THEN n END"}, {"age": f"CAST(n - max(turned) OVER {CUM} AS BIGINT)"})


EVENTS: dict[str, Plan] = {
    "adx_signals": crossing("adx", "adx", "plus_di", "minus_di", ("di_bull", "di_bear"), "adx > 25"),
    "adx_trend": then("adx", {"position": "CASE WHEN adx > 25 AND plus_di > minus_di THEN 1D WHEN adx > 25 AND minus_di > plus_di THEN -1D ELSE 0D END"}),
    "aroon_signals": crossing("aroon", "aroon", "up", "down"),
    "trix_signals": crossing("trix", "trix", "trix", "signal"),
    "kst_signals": crossing("kst", "kst", "kst", "signal"),
    "tsi_signals": crossing("tsi", "tsi", "tsi", "signal"),
    "candle_signals": candle_signals(),
    "rsi_divergence": divergence(),
    "gap_kinds": gap_kinds(),
    "trend_age": trend_age(),
}
