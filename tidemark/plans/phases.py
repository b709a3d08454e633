"""Market phases by name, and positions in a pair of symbols."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions.expressions import lag, roll, sma
from tidemark.operators import recursive, strategies
from tidemark.plans.indicators import TR

#: Bars of a range and of the leg before it; the choppiness from which bars are a range.
RANGE, LEG, CHOPPY = 20, 120, 55

_PHASE = """CASE WHEN mean IS NULL THEN NULL
 WHEN chop > {choppy} AND leg < 0 THEN 'accumulation' WHEN chop > {choppy} AND leg > 0 THEN 'distribution'
 WHEN dow = -1 AND close < mean THEN 'markdown' WHEN dow = 1 AND close > mean THEN 'markup' ELSE 'transition' END"""


def wyckoff(bars: DataFrame) -> DataFrame:
    """(symbol, time, phase) of each bar.

    A choppy range is accumulation after a falling leg, distribution after a
    rising one; otherwise the Dow state on its side of the 50-bar average is
    markup or markdown, and the rest transition. Null until there is an average.
    """
    width = f"{roll('max', 'high', RANGE)} - {roll('min', 'low', RANGE)}"
    x = recursive.with_states(bars, "dow").selectExpr("symbol", "time", "high", "low", "close", "dow", f"{TR} AS tr")
    x = x.selectExpr("*", f"{width} AS width", f"{roll('sum', 'tr', RANGE)} AS path", f"{sma('close', 50)} AS mean", f"{lag('close', RANGE)} / {lag('close', RANGE + LEG)} - 1 AS leg")
    x = x.selectExpr("*", f"CASE WHEN width > 0 AND path > 0 THEN 100 * log10(path / width) / log10({RANGE}D) END AS chop")
    return x.selectExpr("symbol", "time", _PHASE.format(choppy=CHOPPY) + " AS phase")


_SPREAD = """
WITH p AS (SELECT a.time, ln(a.close) AS x, ln(b.close) AS y FROM {bars} a JOIN {bars} b ON a.time = b.time WHERE a.symbol = {first} AND b.symbol = {second}),
h AS (SELECT *, CASE WHEN count(x) OVER w = {n} THEN covar_samp(x, y) OVER w / nullif(var_samp(y) OVER w, 0) END AS beta FROM p WINDOW w AS (ORDER BY time ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)),
s AS (SELECT time, beta, x - beta * y AS spread FROM h)
SELECT {first} AS a, {second} AS b, time, beta, CASE WHEN count(spread) OVER w = {n} THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END AS z
FROM s WINDOW w AS (ORDER BY time ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)"""


def pairs(bars: DataFrame, first: str, second: str, n: int = 60, enter: float = 2.0, leave: float = 0.5) -> DataFrame:
    """(a, b, time, z, side, weight_a, weight_b): a trade in the spread of the two symbols' log closes.

    The hedge ratio and the spread's z-score trail by ``n`` bars that both
    symbols have. The spread is bought below -enter until z is above -leave,
    sold above enter until below leave; weights add up to a gross of 1. Flat
    (weights 0) until there is a z-score. One pair's bars are one task.
    """
    spread = bars.sparkSession.sql(_SPREAD, bars=bars, first=first, second=second, n=n, back=n - 1)

    def positions(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("time", kind="stable")
        z = x["z"].astype(float)
        side = strategies.state(z < -enter, z > -leave, z > enter, z < leave)
        gross = 1 + x["beta"].astype(float).abs()
        return x.assign(side=side, weight_a=(side / gross).fillna(0.0), weight_b=(-side * x["beta"].astype(float) / gross).fillna(0.0))

    schema = "a string, b string, time date, beta double, z double, side double, weight_a double, weight_b double"
    return spread.groupBy("a", "b").applyInPandas(positions, schema).drop("beta")
