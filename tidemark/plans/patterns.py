"""Chart patterns: geometry over each symbol's last zigzag pivots, then the closes that resolve it.

Pivots come from the zigzag pass. The shapes are expressions over a pivot and
the five before it in one window; each detection meets only the bars up to its
own time limit, by an equi-join on (symbol, bar number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import recursive
from tidemark.sources.bars import smoothed_bars

BACK = 5


def _line(x0: Column, p0: Column, x1: Column, p1: Column):
    """(slope, the line as a function) through two points."""
    slope = (p1 - p0) / (x1 - x0)
    return slope, lambda at: p0 + slope * (at - x0)


def _found(pattern: Column, bias: Column, start: Column, up: Column, up_slope: Column, low: Column, low_slope: Column, height: Column, wait: Column) -> Column:
    return F.struct(pattern.alias("pattern"), bias.cast("int").alias("bias"), start.alias("start"), up.alias("up"), up_slope.alias("up_slope"), low.alias("low"), low_slope.alias("low_slope"), height.alias("height"), wait.cast("int").alias("wait"))


def _clip(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _shapes() -> list[Column]:
    """The shapes that end at a pivot (columns x0..x5 bars, p0..p5 prices, k0 kind, det, need, need1, calm, under); null where there is none."""
    x, p = [F.col(f"x{m}") for m in range(BACK + 1)], [F.col(f"p{m}") for m in range(BACK + 1)]
    k, det, tol, zero = F.col("k0"), F.col("det"), F.col("need") / 2, F.lit(0.0)
    top = [v * k for v in p]  # bottoms turned into tops
    name = lambda a, b: F.when(k > 0, F.lit(a)).otherwise(F.lit(b))
    sides = lambda a, b: (F.when(k > 0, a).otherwise(b), F.when(k > 0, b).otherwise(a))

    tops, necks = [top[4], top[2], top[0]], [top[3], top[1]]
    neck, peak = F.least(*necks) * k, F.greatest(*tops) * k
    up, low = sides(peak, neck)
    triple = (F.greatest(*tops) - F.least(*tops) <= tol) & (top[5] < F.least(*necks))
    out_triple = _found(name("triple_top", "triple_bottom"), -k, x[4], up, zero, low, zero, F.abs((p[4] + p[2] + p[0]) / 3 - neck), _clip(x[0] - x[4], 10, 60))

    slope, at = _line(x[3], p[3], x[1], p[1])
    shoulder, inner = F.least(top[4], top[0]), F.greatest(*necks)
    heads = (top[2] > F.greatest(top[4], top[0]) + tol) & (F.abs(top[4] - top[0]) <= F.greatest(2 * tol, 0.35 * (top[2] - inner))) & (shoulder > inner) & (top[5] < F.least(*necks))
    (up, low), (us, ls) = sides(p[2], at(det)), sides(zero, slope)
    out_heads = _found(name("head_shoulders", "inverse_head_shoulders"), -k, x[4], up, us, low, ls, F.abs(p[2] - at(x[2])), _clip(x[0] - x[4], 10, 60))

    double = (F.abs(top[2] - top[0]) <= tol) & (top[3] < top[1]) & (x[0] - x[2]).between(5, 150)
    up, low = sides(F.greatest(top[2], top[0]) * k, p[1])
    out_double = _found(name("double_top", "double_bottom"), -k, x[2], up, zero, low, zero, F.abs((p[0] + p[2]) / 2 - p[1]), _clip(x[0] - x[2], 10, 60))
    family = F.when(triple, out_triple).when(heads, out_heads).when(double, out_double)

    span = x[0] - x[4]
    (own_slope, own), (far_slope, far) = _line(x[4], p[4], x[0], p[0]), _line(x[3], p[3], x[1], p[1])
    high_slope, low_slope = sides(own_slope, far_slope)
    high_at, low_at = lambda i: sides(own(i), far(i))[0], lambda i: sides(own(i), far(i))[1]
    before, now = high_at(x[4]) - low_at(x[4]), high_at(det) - low_at(det)
    way = lambda d: F.when(F.abs(d) <= tol, 0).when(d > 0, 1).otherwise(-1)
    up_way, low_way = way(high_slope * span), way(low_slope * span)
    kind = lambda a, b: (up_way == a) & (low_way == b)
    closing = now < 0.85 * before
    label = F.when(kind(0, 1), "ascending_triangle").when(kind(-1, 0), "descending_triangle").when(kind(-1, 1), "symmetrical_triangle").when(kind(0, 0), "rectangle").when(closing & kind(1, 1), "rising_wedge").when(closing & kind(-1, -1), "falling_wedge")
    bias = F.when(label.isin("ascending_triangle", "falling_wedge"), 1).when(label.isin("descending_triangle", "rising_wedge"), -1).otherwise(0)
    fits = (span >= 10) & (F.abs(p[2] - own(x[2])) <= tol) & (before > 0) & (now > 0) & label.isNotNull()
    meeting = F.when(fits, _found(label, bias, x[4], high_at(det), high_slope, low_at(det), low_slope, before, _clip(span, 10, 60)))

    pole, bull = F.abs(p[1] - p[2]), k < 0
    up, low = F.when(bull, p[1]).otherwise(p[0]), F.when(bull, p[0]).otherwise(p[1])
    label = F.concat(F.when(bull, "bull_").otherwise("bear_"), F.when(F.col("calm"), "pennant").otherwise("flag"))
    flag = F.when(flag_shape(), _found(label, -k, x[2], up, zero, low, zero, pole, F.lit(15)))

    depth = (p[3] + p[1]) / 2 - p[2]
    cup = F.when(cup_shape() & (F.col("under") >= 0.25), _found(F.lit("cup_handle"), F.lit(1), x[3], p[1], zero, p[0], zero, depth, _clip(2 * (x[0] - x[1]), 10, 40)))
    return [family, meeting, flag, cup]


def flag_shape() -> Column:
    x, p = [F.col(f"x{m}") for m in range(3)], [F.col(f"p{m}") for m in range(3)]
    pole = F.abs(p[1] - p[2])
    return (pole >= 2 * F.col("need1")) & (x[1] - x[2]).between(1, 15) & (F.abs(p[1] - p[0]) / pole <= 0.5) & (x[0] - x[1]).between(2, 20)


def cup_shape() -> Column:
    x, p = [F.col(f"x{m}") for m in range(4)], [F.col(f"p{m}") for m in range(4)]
    depth, width, tol = (p[3] + p[1]) / 2 - p[2], x[1] - x[3], F.col("need") / 2
    return (F.col("k0") == -1) & (depth > 0) & (F.abs(p[1] - p[3]) <= 2 * tol) & width.between(20, 400) & (p[1] - p[0] <= 0.5 * depth) & (x[0] - x[1] <= width / 2)


def chart_patterns(bars: DataFrame) -> DataFrame:
    """One row per detection: symbol, pattern, bias, direction, status, bars first, last, detected and resolved, breakout, target, invalidation.

    A pattern is confirmed by a close beyond its boundary on the side of its
    bias (either side without one), failed by one beyond the other, expired
    after its time limit, else pending. A detection that a newer one of its
    kind overlaps while unresolved is left out. Bars are numbered from 0.
    """
    numbered = bars.withColumn("n", (F.row_number().over(W.partitionBy("symbol").orderBy("time")) - 1).cast("int"))
    w = W.partitionBy("symbol").orderBy("det", "x")
    pivots = recursive.rows_of(bars, recursive.pivots, "x int, p double, k int, det int, need double, need_pivot double", {})
    back = {f"{c}{m}": F.lag(c, m).over(w) for m in range(BACK + 1) for c in "xp"}
    piv = pivots.select("symbol", "det", "need", F.col("k").alias("k0"), F.lag("need_pivot", 1).over(w).alias("need1"), *[v.alias(c) for c, v in back.items()])

    # what the shapes need of the bars between two pivots
    flags = piv.where(flag_shape()).select("symbol", "det", "x0", "x1", F.explode(F.sequence("x1", "x0")).alias("n"), F.lit(None).cast("double").alias("level"))
    cups = piv.where(cup_shape()).select("symbol", "det", "x0", F.col("x3").alias("x1"), F.explode(F.sequence("x3", "x1")).alias("n"), (F.col("p2") + ((F.col("p3") + F.col("p1")) / 2 - F.col("p2")) / 3).alias("level"))
    met = flags.union(cups).join(numbered.select("symbol", "n", "high", "low", "close"), ["symbol", "n"])
    later = F.col("n") - F.col("x1") >= F.floor((F.col("x0") - F.col("x1") + 1) / 2)
    spread = F.when(F.col("level").isNull(), F.col("high") - F.col("low"))
    facts = met.groupBy("symbol", "det", "x0").agg(
        F.coalesce((F.count(spread) >= 4) & (F.avg(F.when(later, spread)) < 0.75 * F.avg(F.when(~later, spread))), F.lit(False)).alias("calm"),
        F.avg(F.when(F.col("level").isNotNull(), (F.col("close") < F.col("level")).cast("double"))).alias("under"),
    )
    known = piv.join(facts, ["symbol", "det", "x0"], "left")
    found = known.select("symbol", "det", F.col("x0").alias("last"), F.explode(F.array(*_shapes())).alias("s")).where("s is not null").select("symbol", "det", "last", "s.*")

    ends = numbered.groupBy("symbol").agg(F.max("n").alias("end"))
    found = found.join(ends, "symbol")
    closes = found.withColumn("n", F.explode(F.sequence("det", F.least(F.col("end"), F.col("det") + F.col("wait"))))).join(numbered.select("symbol", "n", "close"), ["symbol", "n"])
    gone = F.col("n") - F.col("det")
    beyond = closes.withColumns({"u": F.col("up") + F.col("up_slope") * gone, "l": F.col("low") + F.col("low_slope") * gone})
    key = ["symbol", "pattern", "det", "last"]
    first = lambda hit, line: F.min(F.when(hit, F.struct("n", F.col(line).alias("at"))))
    hits = beyond.groupBy(*key).agg(first(F.col("close") > F.col("u"), "u").alias("above"), first(F.col("close") < F.col("l"), "l").alias("below"))
    out = found.join(hits, key, "left")
    never = 1 << 30
    up, low = F.coalesce("above.n", F.lit(never)), F.coalesce("below.n", F.lit(never))
    side = F.when(up < low, 1).when(low < up, -1)
    resolved = F.when(side.isNotNull(), F.least(up, low)).when(F.col("det") + F.col("wait") < F.col("end"), F.col("det") + F.col("wait"))
    status = F.when(side.isNull(), F.when(F.col("det") + F.col("wait") < F.col("end"), "expired").otherwise("pending")).when((F.col("bias") == 0) | (side == F.col("bias")), "confirmed").otherwise("failed")
    out = out.withColumns({"status": status, "resolved": resolved, "side": side})
    sure = F.col("status") == "confirmed"
    out = out.withColumn("direction", F.when(sure, F.col("side")).otherwise(F.col("bias")))
    breakout = F.when(sure, F.when(F.col("side") > 0, F.col("above.at")).otherwise(F.col("below.at"))).when(F.col("bias") > 0, F.col("up")).when(F.col("bias") < 0, F.col("low"))
    newer = W.partitionBy("symbol", "pattern").orderBy("det", "last")
    out = out.withColumns({"breakout": breakout, "next_start": F.lead("start").over(newer), "next_det": F.lead("det").over(newer)})
    overlapped = (F.col("next_start") < F.col("last")) & (F.col("resolved").isNull() | (F.col("resolved") > F.col("next_det")))
    out = out.where(~F.coalesce(overlapped, F.lit(False)))
    target = F.when(F.col("direction") != 0, F.col("breakout") + F.col("direction") * F.col("height"))
    invalid = F.when(F.col("bias") > 0, F.col("low")).when(F.col("bias") < 0, F.col("up"))
    return out.select("symbol", "pattern", "bias", "direction", "status", F.col("start").alias("first"), "last", F.col("det").alias("detected"), "resolved", F.round("breakout", 6).alias("breakout"), F.round(target, 6).alias("target"), F.round(invalid, 6).alias("invalidation"))


def chart_pattern_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_patterns(smoothed_bars(spark, sf_dir))


def chart_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bar on which each chart pattern was confirmed, and the side it broke to."""
    bars = smoothed_bars(spark, sf_dir)
    numbered = bars.select("symbol", "time", (F.row_number().over(W.partitionBy("symbol").orderBy("time")) - 1).cast("int").alias("resolved"))
    sure = chart_patterns(bars).where("status = 'confirmed'")
    return sure.join(numbered, ["symbol", "resolved"]).select("symbol", F.col("time").cast("string").alias("time"), "pattern", "direction")


QUERIES = {"chart_patterns": chart_pattern_rows, "chart_signals": chart_signals}
