"""Significance of a return series: Sharpe ratios, their probability, block bootstrap and permutation."""

from __future__ import annotations

from collections.abc import Iterator
from math import e, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EULER = 0.5772156649015329
NORMAL = NormalDist()
#: Trials that one task takes at a time.
CHUNK = 50


def expected_best(trials: int, variance: float) -> float:
    """The largest Sharpe ratio, per period, to be expected of so many trials without an edge."""
    if trials <= 1:
        return 0.0
    return sqrt(variance) * ((1 - EULER) * NORMAL.inv_cdf(1 - 1 / trials) + EULER * NORMAL.inv_cdf(1 - 1 / (trials * e)))


def moments(returns: DataFrame, key: str, r: str) -> DataFrame:
    """(key, n, mean, sd, skew, kurt): sample values, the kurtosis raw."""
    x, n = F.col(r), F.col("n")
    m = returns.where(x.isNotNull()).groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)) + 3
    return m.select(key, "n", "mean", "sd", skew.alias("skew"), kurt.alias("kurt"))


def sharpe_stats(returns: DataFrame, key: str = "strategy", r: str = "net", periods: int = 252, trials: int = 1) -> DataFrame:
    """(key, n, sharpe, psr, dsr) for each series: the annual Sharpe ratio, the probability that the true one is positive, and that it exceeds the best of ``trials`` without an edge.

    A series of fewer than 3 returns, or without variance, has null for all three.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ratio = (b["mean"] / b["sd"].where(b["sd"] > 0)).where(b["n"] > 2)
            spread = np.sqrt(np.maximum(1 - b["skew"] * ratio + (b["kurt"] - 1) / 4 * ratio**2, 1e-12))
            beyond = {"psr": 0.0, "dsr": [expected_best(trials, 1 / n) for n in b["n"]]}
            out = {k: ((ratio - v) * np.sqrt(b["n"] - 1) / spread).map(NORMAL.cdf, na_action="ignore") for k, v in beyond.items()}
            yield pd.DataFrame({key: b[key], "n": b["n"], "sharpe": ratio * sqrt(periods), **out})

    return moments(returns, key, r).mapInPandas(run, f"{key} string, n long, sharpe double, psr double, dsr double")


def resampled(x: np.ndarray, rng: np.random.Generator, block: int) -> np.ndarray:
    """A stationary bootstrap sample: runs of consecutive values, wrapped round, of geometric length with mean ``block``."""
    n = len(x)
    fresh = rng.random(n) < 1 / block
    fresh[0] = True
    run = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    return x[(rng.integers(n, size=len(begin))[run] + np.arange(n) - begin[run]) % n]


def _trials(series: DataFrame, n: int) -> DataFrame:
    chunks = series.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // CHUNK))))
    return chunks.repartition("key", "chunk")


def bootstrap_sharpe(returns: DataFrame, key: str = "strategy", r: str = "net", at: str = "time", n: int = 500, block: int = 20, periods: int = 252, seed: int = 0) -> DataFrame:
    """(key, ci_low, ci_high, p_le_0): 5th and 95th percentile of the resampled Sharpe ratios (population deviation), and how many are not above 0.

    Series travel as one array each, once for each chunk of trials; those of
    fewer than two blocks give no row.
    """
    rows = returns.where(F.col(r).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct(at, r)))[r].alias("x")).where(F.size("x") >= 2 * block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, x, chunk in zip(b["key"], b["x"], b["chunk"], strict=True):
                rng, x = np.random.default_rng([seed, int(chunk)]), np.asarray(x, float)
                drawn = [resampled(x, rng, block) for _ in range(min(CHUNK, n - chunk * CHUNK))]
                yield pd.DataFrame({"key": name, "s": [s.mean() / s.std() * sqrt(periods) if s.std() else 0.0 for s in drawn]})

    s = _trials(rows, n).mapInPandas(run, "key string, s double")
    return s.groupBy(F.col("key").alias(key)).agg(F.percentile("s", F.lit(0.05)).alias("ci_low"), F.percentile("s", F.lit(0.95)).alias("ci_high"), F.avg((F.col("s") <= 0).cast("double")).alias("p_le_0"), F.count(F.lit(1)).alias("trials"))


def permutation_p(held: DataFrame, key: str = "strategy", n: int = 500, periods: int = 252, seed: int = 0) -> DataFrame:
    """(key, real, p): how often market rows in random order do as well with the weights held.

    ``held`` is (key, time, weights array, moves array, net), symbols in one
    order. The real Sharpe ratio is after costs, permuted ones are before.
    """
    rows = held.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct("time", "weights", "moves", "net"))).alias("x"))
    rows = rows.select("key", F.transform("x", lambda v: v["weights"]).alias("w"), F.transform("x", lambda v: v["moves"]).alias("m"), F.transform("x", lambda v: v["net"]).alias("net"))
    ratio = lambda v: float(v.mean() / v.std(ddof=1) * sqrt(periods)) if len(v) > 1 and v.std(ddof=1) > 0 else -np.inf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, w, m, net, chunk in zip(b["key"], b["w"], b["m"], b["net"], b["chunk"], strict=True):
                rng, w, m = np.random.default_rng([seed, int(chunk)]), np.stack(w), np.stack(m)
                real, count = ratio(np.asarray(net, float)), min(CHUNK, n - chunk * CHUNK)
                beats = sum(ratio((w * m[rng.permutation(len(m))]).sum(axis=1)) >= real for _ in range(count))
                yield pd.DataFrame({"key": [name], "real": [real], "beats": [beats], "n": [count]})

    s = _trials(rows, n).mapInPandas(run, "key string, real double, beats long, n long")
    return s.groupBy(F.col("key").alias(key)).agg(F.first("real").alias("real"), ((F.sum("beats") + 1) / (F.sum("n") + 1)).alias("p"))
