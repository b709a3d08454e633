"""Scorecards: what follows each signal, against what follows any bar, with p values over all tests.

Signals, forward returns and excursions are layers of one plan over the bars, so
that bars are made once and nothing is joined to them. A symbol's base rates are
windows over it; assets are pooled after each one's own base is taken off.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import KEY, lead, over
from tidemark.functions.statistics import bh_adjust, student_p
from tidemark.plans.indicators import PLANS
from tidemark.sources.bars import DAILY_SQL, daily_bars

HORIZONS = (5, 10, 20)
#: Bars from a kept event to the next, events that a test needs, level of a test.
GAP, LEAST, LEVEL = 5, 15, 0.05
#: Names of signals that mean a fall.
SHORT = "down|bear|death|_ob_"


def _card(horizons: tuple[int, ...]):
    """The signal plan with bar numbers, forward returns and adverse excursions as further columns."""
    base = PLANS["signals"]
    ahead = {f"r{h}": f"{lead('close', h)} / close - 1" for h in horizons} | {f"lo{h}": over("min", "low", 1, h) for h in horizons} | {f"hi{h}": over("max", "high", 1, h) for h in horizons}
    hurt = {f"mae_long{h}": f"CASE WHEN lo{h} IS NOT NULL AND atr14 IS NOT NULL THEN greatest(0D, (close - lo{h}) / atr14) END" for h in horizons}
    hurt |= {f"mae_short{h}": f"CASE WHEN hi{h} IS NOT NULL AND atr14 IS NOT NULL THEN greatest(0D, (hi{h} - close) / atr14) END" for h in horizons}
    first, *rest, last = base.stages
    ema = base.ema | {1: base.ema[1] | {"atr14": ("tr", 1 / 14, 14)}}
    out = ["n", *[f"r{h}" for h in horizons], *hurt, *base.out]
    return replace(base, out=out, stages=[first | ahead | {"n": f"row_number() OVER ({KEY})"}, *rest, last | hurt], ema=ema)


CARD = _card(HORIZONS)


def fired(bars: DataFrame, *carry: str) -> DataFrame:
    """(symbol, signal, n) of every bar on which a signal fires, with its symbol's columns named in ``carry`` as they are and base rates by horizon."""
    x, own = CARD.spark(bars), W.partitionBy("symbol")
    rates = {}
    for h in HORIZONS:
        r = F.col(f"r{h}")
        rates |= {f"base{h}": F.avg(r).over(own), f"up{h}": F.avg((r > 0).cast("double")).over(own), f"dn{h}": F.avg((r < 0).cast("double")).over(own)}
    x = x.withColumns(rates).where(F.array_contains(F.array(*PLANS["signals"].out), True))
    return x.unpivot(["symbol", "n", *[f"r{h}" for h in HORIZONS], *rates, *carry], PLANS["signals"].out, "signal", "fired").where("fired").drop("fired")


def declustered(events: DataFrame, gap: int = GAP) -> DataFrame:
    """Of each symbol's events of a signal those at least ``gap`` bars after the one kept before.

    The first event after a pause of ``gap`` bars is always kept, so the choice
    is made within runs of close events; a run is one fold.
    """
    run = W.partitionBy("symbol", "signal").orderBy("n")
    fresh = F.coalesce(F.col("n") - F.lag("n").over(run) >= gap, F.lit(True)).cast("int")
    rest = [c for c in events.columns if c not in ("symbol", "signal", "n")]
    runs = events.withColumn("_run", fresh).withColumn("_run", F.sum("_run").over(run)).groupBy("symbol", "signal", "_run").agg(F.array_sort(F.collect_list(F.struct("n", *rest))).alias("x"))
    take = lambda kept, e: F.when((F.size(kept) == 0) | (e["n"] - F.try_element_at(kept, F.lit(-1))["n"] >= gap), F.concat(kept, F.array(e))).otherwise(kept)
    return runs.select("symbol", "signal", F.explode(F.aggregate("x", F.slice("x", 1, 0), take)).alias("e")).select("symbol", "signal", "e.*")


def _by_horizon(events: DataFrame, columns: dict[str, str]) -> DataFrame:
    parts = [F.struct(F.lit(h).alias("horizon"), *[F.col(f"{c}{h}").alias(k) for k, c in columns.items()]) for h in HORIZONS]
    return events.select("symbol", "signal", F.explode(F.array(*parts)).alias("e")).select("symbol", "signal", "e.*").where("r IS NOT NULL")


def scorecard_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal's events at each horizon: count, hit rate, mean, median and edge over the symbol's own base rate."""
    x = _by_horizon(fired(daily_bars(spark, sf_dir)), {"r": "r", "base": "base"})
    return x.groupBy("signal", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("up_rate"), F.round(F.avg("r"), 5).alias("mean"), F.round(F.percentile("r", F.lit(0.5)), 7).alias("median"), F.round(F.avg(F.col("r") - F.col("base")), 5).alias("edge"),
    )


def tested(events: DataFrame, least: int = LEAST, level: float = LEVEL) -> DataFrame:
    """The table of tests of events that bear r, base, up, down, mae_long and mae_short by (signal, horizon).

    Returns count in the signal's direction. p is that of a t test of the
    returns less their symbol's base; p_adj corrects over all tests of at least
    ``least`` events. A signal that never fires has no row.
    """
    short = F.col("signal").rlike(SHORT)
    side = F.when(short, -1.0).otherwise(1.0)
    x = events.withColumns({"dir": side.cast("int"), "g": F.col("r") * side, "e": (F.col("r") - F.col("base")) * side, "bh": F.when(short, F.col("down")).otherwise(F.col("up")), "mae": F.when(short, F.col("mae_short")).otherwise(F.col("mae_long"))})
    gains, losses = F.sum(F.when(F.col("g") > 0, F.col("g")).otherwise(0.0)), -F.sum(F.when(F.col("g") < 0, F.col("g")).otherwise(0.0))
    s = x.groupBy("signal", "dir", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("assets"), F.avg((F.col("g") > 0).cast("double")).alias("hit"), F.avg("bh").alias("base_hit"), F.avg("g").alias("mean"), F.percentile("g", F.lit(0.5)).alias("median"),
        F.avg(F.col("g") - F.col("e")).alias("base_mean"), F.avg("e").alias("edge"), F.stddev_samp("e").alias("sd"), (gains / F.when(losses > 0, losses)).alias("pf"), F.avg("mae").alias("mae_atr"),
    )
    t = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("edge") / (F.col("sd") / F.sqrt("n")))
    s = s.withColumn("t", t).withColumn("p", F.coalesce(student_p(F.col("t"), F.col("n") - 1), F.when((F.col("n") > 1) & (F.col("edge") != 0), 0.0)))
    s = bh_adjust(s.withColumn("_q", F.when(F.col("n") >= least, F.col("p"))), "_q", "p_adj").drop("_q", "sd")
    return s.withColumn("verdict", _verdict(least, level))


def _verdict(least: int, level: float) -> Column:
    return (
        F.when(F.col("n") < least, "too few").when((F.col("p_adj") < level) & (F.col("edge") > 0), "edge").when(F.col("p_adj") < level, "anti-edge").when(F.col("p") < level, "raw only").otherwise("no edge")
    )


def scorecard_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at least GAP bars apart, pooled over the symbols, tested against their symbols' own base rates."""
    hurt = [f"mae_{s}{h}" for s in ("long", "short") for h in HORIZONS]
    events = declustered(fired(daily_bars(spark, sf_dir), *hurt))
    x = tested(_by_horizon(events, {"r": "r", "base": "base", "up": "up", "down": "dn", "mae_long": "mae_long", "mae_short": "mae_short"}))
    return x.select("signal", "dir", "horizon", "n", "assets", "verdict", *[F.round(c, d).alias(c) for c, d in (("hit", 6), ("base_hit", 6), ("mean", 6), ("median", 7), ("base_mean", 6), ("edge", 6), ("t", 4), ("p", 5), ("p_adj", 5), ("pf", 4), ("mae_atr", 4))])


def signal_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (signal, horizon) of all events, none left out for closeness, with raw and adjusted p."""
    x = _by_horizon(fired(daily_bars(spark, sf_dir)), {"r": "r", "base": "base"})
    e = x.groupBy("signal", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("r") - F.col("base")).alias("edge"), F.stddev_samp(F.col("r") - F.col("base")).alias("sd"))
    e = e.withColumn("p", student_p(F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("edge") / (F.col("sd") / F.sqrt("n"))), F.col("n") - 1))
    return bh_adjust(e, "p").select("signal", "horizon", "n", F.round("p", 5).alias("p"), F.round("p_adj", 5).alias("p_adj"))


QUERIES = {"scorecard_native": scorecard_native, "scorecard_tested": scorecard_tested, "bh_adjust": signal_tests}

_LONG = f"l AS (SELECT * FROM (UNPIVOT ({CARD.sql(DAILY_SQL)}) ON {', '.join(PLANS['signals'].out)} INTO NAME signal VALUE fired))"
_BASE = "b AS (SELECT symbol, " + ", ".join(f"avg(r{h}) AS base{h}, avg(CASE WHEN r{h} > 0 THEN 1.0::DOUBLE WHEN r{h} IS NOT NULL THEN 0 END) AS up{h}, avg(CASE WHEN r{h} < 0 THEN 1.0::DOUBLE WHEN r{h} IS NOT NULL THEN 0 END) AS dn{h}" for h in HORIZONS) + " FROM l WHERE signal = 'golden_cross' GROUP BY symbol)"
#: The t distribution's tail by Simpson's rule on 2000 strips.
_TAIL = """v AS (SELECT s.*, (n - 1)::DOUBLE AS f FROM s),
z AS (SELECT signal, horizon, sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(1 + power(abs(t) * i / 2000.0, 2) / f, -(f + 1) / 2)) * any_value(abs(t)) / 6000 * exp(any_value(lgamma((f + 1) / 2) - lgamma(f / 2))) / sqrt(any_value(f) * pi()) AS area
 FROM v, range(0, 2001) AS g(i) WHERE t IS NOT NULL GROUP BY signal, horizon),
p AS (SELECT v.*, coalesce(1 - 2 * area, CASE WHEN n > 1 AND edge <> 0 THEN 0.0 END) AS p FROM v LEFT JOIN z ON v.signal = z.signal AND v.horizon = z.horizon)"""


def _adjusted(least: int) -> str:
    return f"""a AS (SELECT signal, horizon, least(1.0, min(p * m / k) OVER (ORDER BY p DESC, signal DESC, horizon DESC)) AS p_adj FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, signal, horizon) AS k FROM p WHERE n >= {least} AND p IS NOT NULL))"""


def _wide(rows: str, *columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {rows}.symbol, signal, {h} AS horizon, r{h} AS r, base{h} AS base, " + ", ".join(f"{c}{h} AS {c}" for c in ("up", "dn", *columns)) + f" FROM {rows} JOIN b ON {rows}.symbol = b.symbol WHERE r{h} IS NOT NULL" for h in HORIZONS)


ORACLE = {
    "scorecard_native": f"""
WITH {_LONG}, {_BASE}, f AS (SELECT * FROM l WHERE fired), x AS ({_wide('f')})
SELECT signal, horizon, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS up_rate, round(avg(r), 5) AS mean, round(quantile_cont(r, 0.5), 7) AS median, round(avg(r - base), 5) AS edge FROM x GROUP BY signal, horizon""",
    "bh_adjust": f"""
WITH {_LONG}, {_BASE}, f AS (SELECT * FROM l WHERE fired), x AS ({_wide('f')}),
s AS (SELECT *, CASE WHEN n > 1 AND sd > 0 THEN edge / (sd / sqrt(n)) END AS t FROM (SELECT signal, horizon, count(*) AS n, avg(r - base) AS edge, stddev_samp(r - base) AS sd FROM x GROUP BY signal, horizon)),
{_TAIL}, {_adjusted(2)}
SELECT p.signal, p.horizon, n, CASE WHEN t IS NOT NULL THEN round(p, 5) END AS p, round(p_adj, 5) AS p_adj FROM p LEFT JOIN a ON p.signal = a.signal AND p.horizon = a.horizon""",
    "scorecard_tested": f"""
WITH {_LONG}, {_BASE}, k AS (SELECT symbol, signal, unnest(list_reduce(list_sort(list(n)), lambda kept, x: CASE WHEN len(kept) = 0 OR x - kept[-1] >= {GAP} THEN list_append(kept, x) ELSE kept END, CAST([] AS BIGINT[]))) AS n FROM l WHERE fired GROUP BY symbol, signal),
f AS (SELECT l.* FROM l JOIN k ON l.symbol = k.symbol AND l.signal = k.signal AND l.n = k.n), x AS ({_wide('f', 'mae_long', 'mae_short')}),
y AS (SELECT *, CASE WHEN regexp_matches(signal, '{SHORT}') THEN -1 ELSE 1 END AS dir FROM x),
w AS (SELECT signal, dir, horizon, symbol, r * dir AS g, (r - base) * dir AS e, CASE WHEN dir < 0 THEN dn ELSE up END AS bh, CASE WHEN dir < 0 THEN mae_short ELSE mae_long END AS mae FROM y),
s AS (SELECT *, CASE WHEN n > 1 AND sd > 0 THEN edge / (sd / sqrt(n)) END AS t FROM (SELECT signal, dir, horizon, count(*) AS n, count(DISTINCT symbol) AS assets, avg(CASE WHEN g > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit, avg(bh) AS base_hit, avg(g) AS mean, quantile_cont(g, 0.5) AS median, avg(g - e) AS base_mean, avg(e) AS edge, stddev_samp(e) AS sd,
 sum(CASE WHEN g > 0 THEN g ELSE 0 END) / nullif(-sum(CASE WHEN g < 0 THEN g ELSE 0 END), 0) AS pf, avg(mae) AS mae_atr FROM w GROUP BY signal, dir, horizon)),
{_TAIL}, {_adjusted(LEAST)}
SELECT p.signal, dir, p.horizon, n, assets, CASE WHEN n < {LEAST} THEN 'too few' WHEN p_adj < {LEVEL} AND edge > 0 THEN 'edge' WHEN p_adj < {LEVEL} THEN 'anti-edge' WHEN p < {LEVEL} THEN 'raw only' ELSE 'no edge' END AS verdict,
 round(hit, 6) AS hit, round(base_hit, 6) AS base_hit, round(mean, 6) AS mean, round(median, 7) AS median, round(base_mean, 6) AS base_mean, round(edge, 6) AS edge, round(t, 4) AS t, round(p, 5) AS p, round(p_adj, 5) AS p_adj, round(pf, 4) AS pf, round(mae_atr, 4) AS mae_atr
FROM p LEFT JOIN a ON p.signal = a.signal AND p.horizon = a.horizon""",
}
