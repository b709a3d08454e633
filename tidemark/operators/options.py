"""Black-Scholes-Merton values, greeks and implied volatilities as Arrow-batched functions of columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ERF = np.vectorize(math.erf, otypes=[float])


def _cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(x / math.sqrt(2)))


def price(s, k, t, r, sigma, q=0.0, call=True) -> np.ndarray:
    """Value; without time or volatility the discounted intrinsic value."""
    s, k, t, sigma, call = np.broadcast_arrays(*(np.asarray(x, float) for x in (s, k, t, sigma)), np.asarray(call, bool))
    live = (t > 0) & (sigma > 0)
    root = np.where(live, sigma * np.sqrt(np.maximum(t, 1e-12)), 1.0)
    d1 = (np.log(s / k) + (r - q + sigma**2 / 2) * t) / root
    forward, strike = s * np.exp(-q * t), k * np.exp(-r * t)
    sign = np.where(call, 1.0, -1.0)
    return np.where(live, sign * (forward * _cdf(sign * d1) - strike * _cdf(sign * (d1 - root))), np.maximum(sign * (forward - strike), 0))


def greeks(s, k, t, r, sigma, q=0.0, call=True) -> dict[str, np.ndarray]:
    """delta, gamma, vega and rho (per unit), theta (per year), vanna and charm (changes of delta by volatility and by year).

    Without time or volatility delta is 1, -1 or 0 by what the option ends as, the rest 0.
    """
    s, k, t, sigma, call = np.broadcast_arrays(*(np.asarray(x, float) for x in (s, k, t, sigma)), np.asarray(call, bool))
    live, sign = ~((t <= 0) | (sigma <= 0)), np.where(call, 1.0, -1.0)
    t, sigma = np.where(t > 0, t, 1.0), np.where(sigma <= 0, 1.0, sigma)
    root = sigma * np.sqrt(t)
    d1 = (np.log(s / k) + (r - q + sigma**2 / 2) * t) / root
    d2 = d1 - root
    carry, disc = np.exp(-q * t), np.exp(-r * t)
    spread = carry * np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)
    in_spot, in_strike = sign * carry * _cdf(sign * d1), sign * k * disc * _cdf(sign * d2)
    drift = spread * (2 * (r - q) * t - d2 * root) / (2 * t * root)
    value = {
        "gamma": spread / (s * root),
        "vega": s * spread * np.sqrt(t),
        "theta": -s * spread * sigma / (2 * np.sqrt(t)) + q * s * in_spot - r * in_strike,
        "rho": t * in_strike,
        "vanna": -spread * d2 / sigma,
        "charm": q * in_spot - drift,
    }
    ended = np.where(call, (s > k).astype(float), -(s < k).astype(float))
    return {"delta": np.where(live, in_spot, ended)} | {name: np.where(live, v, 0.0) for name, v in value.items()}


def implied(value, s, k, t, r, q=0.0, call=True, lo: float = 1e-4, hi: float = 5.0) -> np.ndarray:
    """The volatility in [lo, hi] of a value, by bisection of all rows at once; null outside the bounds."""
    value, s, k, t = (np.asarray(x, float) for x in (value, s, k, t))
    a, b = np.full(value.shape, lo), np.full(value.shape, hi)
    ok = (t > 0) & (value > price(s, k, t, r, a, q, call)) & (value < price(s, k, t, r, b, q, call))
    for _ in range(60):
        mid = (a + b) / 2
        high = price(s, k, t, r, mid, q, call) > value
        a, b = np.where(high, a, mid), np.where(high, mid, b)
    return np.where(ok, (a + b) / 2, np.nan)


def with_greeks(chain: DataFrame, spot: Column, years: Column, rate: float = 0.04, mid: str = "mid") -> DataFrame:
    """A chain (kind, strike, mid) with iv, delta, gamma, vega, theta, rho, vanna and charm."""

    @F.pandas_udf("iv double, delta double, gamma double, vega double, theta double, rho double, vanna double, charm double")
    def value(kind: pd.Series, k: pd.Series, m: pd.Series, s: pd.Series, t: pd.Series) -> pd.DataFrame:
        call = (kind == "C").to_numpy()
        iv = implied(m, s, k, t, rate, 0.0, call)
        with np.errstate(all="ignore"):
            return pd.DataFrame({"iv": iv, **greeks(s.to_numpy(), k.to_numpy(), t.to_numpy(), rate, iv, 0.0, call)})

    return chain.withColumn("_g", value("kind", "strike", mid, spot, years)).select(*chain.columns, "_g.*")
