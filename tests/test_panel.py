"""Driscoll-Kraay against numpy with a dummy for each symbol."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.panel import driscoll_kraay


def _numpy(df, lags):
    df = df.dropna().sort_values("time")
    x = np.column_stack([df[["u", "v"]].to_numpy(), pd.get_dummies(df.symbol, dtype=float).to_numpy()])
    y = df.y.to_numpy()
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    h = pd.DataFrame(x * (y - x @ b)[:, None]).groupby(df.time.to_numpy()).sum().to_numpy()
    s = h.T @ h
    for m in range(1, lags + 1):
        g = h[m:].T @ h[:-m]
        s += (1 - m / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(x.T @ x)
    return b[:2], np.sqrt(np.diag(inv @ s @ inv))[:2]


@pytest.mark.parametrize("lags", [0, 1, 5])
def test_against_numpy(spark, lags):
    r = np.random.default_rng(2)
    frames = []
    for k, s in enumerate("ABC"):
        t = np.sort(r.choice(300, 200, replace=False))  # dates differ by symbol
        u, v = np.cumsum(r.normal(0, 1, 200)), r.normal(0, 1, 200)
        frames.append(pd.DataFrame({"symbol": s, "time": t, "u": u, "v": v, "y": 0.5 * u - v + 3 * k + np.cumsum(r.normal(0, 0.3, 200))}))
    df = pd.concat(frames, ignore_index=True)
    df.loc[::17, "v"] = np.nan
    rows = spark.createDataFrame([tuple(None if x != x else x for x in t) for t in df.itertuples(index=False)], "symbol string, time long, u double, v double, y double")
    got = {x.term: x for x in driscoll_kraay(rows, "y", ["u", "v"], lags).collect()}
    beta, se = _numpy(df, lags)
    for k, c in enumerate("uv"):
        assert got[c].beta == pytest.approx(beta[k], rel=1e-9) and got[c].se == pytest.approx(se[k], rel=1e-9) and got[c].t == pytest.approx(beta[k] / se[k], rel=1e-9)
    assert got["u"].n == len(df.dropna())


def test_no_rows(spark):
    rows = spark.createDataFrame([("A", 1, None, 1.0)], "symbol string, time long, u double, y double")
    assert [tuple(x) for x in driscoll_kraay(rows, "y", ["u"], 2).collect()] == [("u", None, None, None, 0)]
