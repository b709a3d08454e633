"""Tails and corrections of tests, as column expressions and joins."""

from __future__ import annotations

from math import log, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scratch import Rounds

#: Steps of the continued fraction: some square roots of the degrees of freedom are needed.
STEPS = 400
TINY = 1e-300
#: Buckets of a p value for each power of two.
FINE = 64


def _log_gamma_half(z: Column) -> Column:
    """ln gamma(z + 1/2) - ln gamma(z) for z > 0: a series in 1/z, eight steps up where it converges fast."""
    up = z + 8
    series = F.log(up) / 2 - 1 / (8 * up) + 1 / (192 * F.pow(up, F.lit(3))) - 1 / (640 * F.pow(up, F.lit(5))) + 17 / (14336 * F.pow(up, F.lit(7)))
    for k in range(8):
        series = series + F.log(z + k) - F.log(z + k + 0.5)
    return series


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from the front, its two running quotients kept off zero."""
    far = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    d0 = 1 / far(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def half(s: dict, k: Column) -> dict:
        c, d = far(1 + k / s["c"]), 1 / far(1 + k * s["d"])
        return {"c": c, "d": d, "h": s["h"] * c * d}

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")
        out = half({k: s[k] for k in "cdh"}, m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)))
        out = half(out, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m)))
        return F.struct(*[out[k].alias(k) for k in "cdh"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])


def student_p(t: Column, degrees: Column) -> Column:
    """Two-sided p value of a t statistic: the regularised incomplete beta function at degrees / (degrees + t^2). Null without both or below one degree."""
    v, square = degrees.cast("double"), t * t
    a, half = v / 2, F.lit(0.5)
    x, y = v / (v + square), square / (v + square)
    front = F.exp(_log_gamma_half(a) - log(sqrt(pi)) + a * F.log(x) + F.log(y) / 2)
    p = F.when(x < (a + 1) / (a + 2.5), front * _fraction(a, half, x) / a).otherwise(1 - 2 * front * _fraction(half, a, y))
    return F.when((v >= 1) & (square == 0), F.lit(1.0)).when((v >= 1) & t.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def bh_adjust(df: DataFrame, p: str, out: str = "p_adj") -> DataFrame:
    """The rows with Benjamini-Hochberg adjusted p values; null ones stay null and count in no family.

    Equal values are counted first. Values are dealt out in buckets by their
    logarithm; ranks and the running minimum from the top are taken within a
    bucket and carried over through one row for each bucket, of which there are
    at most FINE for each power of two. The rows are written first: a value
    computed twice could differ in its last bit and miss its own rank.
    """
    df, q = Rounds(df.sparkSession, "tests").save(df, "rows"), F.col(p)
    values = df.where(q.isNotNull()).groupBy(q.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.when(F.col("_p") == 0, F.lit(-(1 << 20))).otherwise(F.floor(F.log2("_p") * FINE)).cast("int"))
    every = W.orderBy("_b")
    counts = values.groupBy("_b").agg(F.sum("_n").alias("_size"))
    counts = counts.select("_b", F.coalesce(F.sum("_size").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_below"), F.sum("_size").over(W.partitionBy()).alias("_all"))
    own = W.partitionBy("_b").orderBy("_p")
    ranked = values.join(counts, "_b").withColumn("_q", F.col("_p") * F.col("_all") / (F.col("_below") + F.sum("_n").over(own)))
    least = ranked.groupBy("_b").agg(F.min("_q").alias("_least"))
    later = least.select("_b", F.min("_least").over(every.rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    done = ranked.join(later, "_b").select("_p", F.least(F.lit(1.0), F.min("_q").over(own.rowsBetween(0, W.unboundedFollowing)), "_later").alias(out))
    return df.join(done, q == F.col("_p"), "left").drop("_p")
