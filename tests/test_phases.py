"""Phases and pair positions against plain pandas."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.recursive import dow_state
from tidemark.operators.strategies import state
from tidemark.plans import phases


@pytest.fixture(scope="module")
def bars():
    r = np.random.default_rng(11)
    out = []
    for s in ("P", "Q"):
        close = 100 * np.exp(np.cumsum(r.normal(0, 0.01, 500) + 0.004 * np.sin(np.arange(500) / 40)))
        spread = np.abs(r.normal(0, 0.6, 500)) + 0.1
        out.append(pd.DataFrame({"symbol": s, "time": pd.date_range("2020-01-01", periods=500).date, "open": close, "high": close + spread, "low": close - spread, "close": close, "volume": 1.0}))
    return pd.concat(out)


def test_phases(spark, bars):
    got = phases.wyckoff(spark.createDataFrame(bars)).toPandas().sort_values(["symbol", "time"])
    seen = set()
    for s, b in bars.groupby("symbol"):
        b = b.reset_index(drop=True)
        was = b["close"].shift()
        tr = pd.concat([b["high"] - b["low"], (b["high"] - was).abs(), (b["low"] - was).abs()], axis=1).max(axis=1)
        chop = 100 * np.log10(tr.rolling(20).sum() / (b["high"].rolling(20).max() - b["low"].rolling(20).min())) / np.log10(20)
        mean, leg, dow = b["close"].rolling(50).mean(), b["close"].shift(20) / b["close"].shift(140) - 1, dow_state(b)["dow"]
        expect = []
        for i in range(len(b)):
            if np.isnan(mean[i]):
                expect.append(None)
            elif chop[i] > 55 and leg[i] != 0 and not np.isnan(leg[i]):
                expect.append("accumulation" if leg[i] < 0 else "distribution")
            elif abs(dow[i]) == 1 and (b["close"][i] - mean[i]) * dow[i] > 0:
                expect.append("markup" if dow[i] > 0 else "markdown")
            else:
                expect.append("transition")
        assert [x if isinstance(x, str) else None for x in got[got["symbol"] == s]["phase"]] == expect
        seen |= set(expect)
    assert {"markup", "markdown", "transition"} <= seen and seen & {"accumulation", "distribution"}


def test_pairs(spark, bars):
    got = phases.pairs(spark.createDataFrame(bars), "P", "Q", n=30, enter=1.5).toPandas().sort_values("time").reset_index(drop=True)
    x, y = (np.log(bars[bars["symbol"] == s]["close"].reset_index(drop=True)) for s in ("P", "Q"))
    beta = x.rolling(30).cov(y) / y.rolling(30).var()
    spread = x - beta * y
    z = (spread - spread.rolling(30).mean()) / spread.rolling(30).std()
    np.testing.assert_allclose(got["z"].astype(float), z, rtol=1e-6, atol=1e-8)
    side = state(z < -1.5, z > -0.5, z > 1.5, z < 0.5)
    assert got["side"].tolist() == side.tolist() and set(side) == {-1.0, 0.0, 1.0}
    on = side != 0
    np.testing.assert_allclose(got["weight_a"].abs() + got["weight_b"].abs(), on.astype(float), atol=1e-9)
    np.testing.assert_allclose(got["weight_b"][on], (-side * beta / (1 + beta.abs()))[on], rtol=1e-6)


def test_no_common_bars(spark, bars):
    assert phases.pairs(spark.createDataFrame(bars), "P", "none").count() == 0
