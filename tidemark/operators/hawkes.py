"""Self-exciting model of extreme moves: the branching ratio over trailing windows, by seeded Metropolis chains.

Events come from the bars natively and are dealt to every window that they lie
in. A (symbol, window, chain) is one row with its events' times, at most a
window's bars; tasks run rows side by side, a step of all their chains at once.
The likelihood is a recursion from event to event, so a step costs time in
proportion to a row's events. A row's random numbers depend on its symbol,
window, chain and the seed alone, so a rerun or another partitioning gives the
same chains. Draws are rows again, summed up natively.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows whose chains run side by side.
SIDE = 256


@dataclass(frozen=True)
class Spec:
    """Windows in bars, chains in steps; decay bounds are means of the kernel in bars."""

    sigma_window: int = 60
    k_sigma: float = 2.0
    fit_window: int = 250
    horizon: int = 5
    every: int = 63
    decay: tuple[float, float] = (1.0, 60.0)
    iters: int = 4000
    burn: int = 1000
    step: float = 0.3
    chains: int = 1
    seed: int = 0


def log_likelihood(mu: np.ndarray, n: np.ndarray, beta: np.ndarray, t: np.ndarray, count: np.ndarray, end: float) -> np.ndarray:
    """For each row of event times ``t`` (ascending, the first ``count`` real): rate mu + n beta sum exp(-beta (s - t_i)) on [0, end]."""
    total, excited = -mu * end, np.zeros(len(mu))
    for k in range(t.shape[1]):
        real = k < count
        if k:
            excited = np.exp(-beta * (t[:, k] - t[:, k - 1])) * (1 + excited)
        total = total + np.where(real, np.log(mu + n * beta * excited) - n * (1 - np.exp(-beta * (end - t[:, k]))), 0.0)
    return total


def chains(t: np.ndarray, count: np.ndarray, keys: list[str], spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """(draws, accepted) of rows of event times: draws of (log mu, logit n, log beta) after the burn-in, by row, and the share of steps taken.

    Flat on log mu; n uniform on (0, 1); log beta uniform within the decay bounds.
    """
    end, rows = float(spec.fit_window), len(t)
    low, high = np.log(1 / spec.decay[1]), np.log(1 / spec.decay[0])
    draw = [np.random.default_rng([spec.seed, zlib.crc32(k.encode())]) for k in keys]
    moves = np.stack([r.standard_normal((spec.iters, 3)) for r in draw]) * spec.step
    chance = np.log(np.stack([r.random(spec.iters) for r in draw]))

    def value(z: np.ndarray) -> np.ndarray:
        n, beta = 1 / (1 + np.exp(-z[:, 1])), np.exp(np.clip(z[:, 2], low, high))
        inside = (z[:, 2] >= low) & (z[:, 2] <= high)
        return np.where(inside, log_likelihood(np.exp(z[:, 0]), n, beta, t, count, end) - np.logaddexp(0, -z[:, 1]) - np.logaddexp(0, z[:, 1]), -np.inf)

    z = np.column_stack([np.log(np.maximum(count, 1) / end * 0.5), np.zeros(rows), np.full(rows, (low + high) / 2)])
    now, out, taken = value(z), np.empty((rows, spec.iters - spec.burn, 3)), np.zeros(rows)
    for i in range(spec.iters):
        ahead = z + moves[:, i]
        then = value(ahead)
        go = chance[:, i] < then - now
        z, now = np.where(go[:, None], ahead, z), np.where(go, then, now)
        if i >= spec.burn:
            out[:, i - spec.burn] = z
            taken += go
    return out, taken / max(spec.iters - spec.burn, 1)


def windows(bars: DataFrame, spec: Spec) -> DataFrame:
    """(symbol, j, time, events, log_rv1, log_rv4, y): each evaluation bar with the times, in bars, of the extreme moves in its window."""
    own = W.partitionBy("symbol").orderBy("time")
    r = bars.select("symbol", "time", (F.row_number().over(own) - 1).alias("i"), F.log(F.col("close") / F.lag("close").over(own)).alias("r"))
    past = own.rowsBetween(-spec.sigma_window, -1)
    sigma = F.when(F.count("r").over(past) == spec.sigma_window, F.stddev_samp("r").over(past))
    level = lambda a, b: F.sqrt(F.sum(F.col("r") * F.col("r")).over(own.rowsBetween(a, b)))
    h, start = spec.horizon, spec.sigma_window + spec.fit_window + 1
    r = r.withColumns({"hit": F.coalesce(F.abs("r") > spec.k_sigma * sigma, F.lit(False)), "log_rv1": F.log(level(1 - h, 0)), "log_rv4": F.log(level(1 - 4 * h, 0) / 2), "y": F.log(level(1, h)), "last": F.max("i").over(W.partitionBy("symbol"))})
    grid = r.where((F.col("i") >= start) & (F.col("i") < F.col("last") + 1 - h) & ((F.col("i") - start) % spec.every == 0)).select("symbol", ((F.col("i") - start) / spec.every).cast("int").alias("j"), "time", "log_rv1", "log_rv4", "y")
    first = F.greatest(F.ceil((F.col("i") - start) / spec.every), F.lit(0)).cast("int")
    final = F.floor((F.col("i") + spec.fit_window - 1 - start) / spec.every).cast("int")
    dealt = r.where("hit").where(final >= first).select("symbol", "i", F.explode(F.sequence(first, final)).alias("j"))
    within = (F.col("i") - (start + F.col("j") * spec.every - spec.fit_window)).cast("double")
    events = dealt.groupBy("symbol", "j").agg(F.array_sort(F.collect_list(within)).alias("events"))
    return grid.join(events, ["symbol", "j"], "left").withColumn("events", F.coalesce("events", F.array().cast("array<double>")))


def posterior(bars: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """A row for each (symbol, evaluation bar): n_mean, n_lo, n_hi (5th and 95th percentile), p_n_gt_0_5, mu_mean, decay_bars, accept, events and the bar's own measures."""
    base = windows(bars, spec)
    rows = base.select("symbol", "j", "events", F.explode(F.sequence(F.lit(0), F.lit(spec.chains - 1))).alias("chain"))
    rows = rows.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "j", "chain")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), SIDE):
                part = f.iloc[a : a + SIDE]
                count = part["events"].map(len).to_numpy()
                t = np.full((len(part), max(int(count.max()), 1)), float(spec.fit_window))
                for k, x in enumerate(part["events"]):
                    t[k, : len(x)] = x
                keys = [f"{s}:{j}:{c}" for s, j, c in zip(part["symbol"], part["j"], part["chain"], strict=True)]
                draws, accept = chains(t, count, keys, spec)
                yield pd.DataFrame({"symbol": part["symbol"], "j": part["j"], "accept": accept, "n": list(1 / (1 + np.exp(-draws[:, :, 1]))), "mu": list(np.exp(draws[:, :, 0])), "decay": list(np.exp(-draws[:, :, 2]))})

    drawn = rows.mapInPandas(run, "symbol string, j int, accept double, n array<double>, mu array<double>, decay array<double>")
    flat = drawn.select("symbol", "j", "accept", F.explode(F.arrays_zip("n", "mu", "decay")).alias("d")).select("symbol", "j", "accept", "d.*")
    out = flat.groupBy("symbol", "j").agg(
        F.avg("n").alias("n_mean"), F.percentile("n", F.lit(0.05)).alias("n_lo"), F.percentile("n", F.lit(0.95)).alias("n_hi"), F.avg((F.col("n") > 0.5).cast("double")).alias("p_n_gt_0_5"),
        F.avg("mu").alias("mu_mean"), F.percentile("decay", F.lit(0.5)).alias("decay_bars"), F.avg("accept").alias("accept"),
    )
    return base.select("symbol", "j", "time", F.size("events").alias("events"), "log_rv1", "log_rv4", "y").join(out, ["symbol", "j"])
