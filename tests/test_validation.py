import numpy as np
import pandas as pd
import pytest

from tidemark.operators import validation


@pytest.fixture(scope="module")
def returns(spark):
    r = np.random.default_rng(3)
    rows = [(k, t, float(x)) for k, mu in (("good", 0.002), ("none", 0.0)) for t, x in enumerate(r.normal(mu, 0.01, 400))]
    rows += [("short", 0, 0.1), ("flat", 0, 0.0), ("flat", 1, 0.0), ("flat", 2, 0.0), ("good", 1000, None)]
    return spark.createDataFrame(rows, "strategy string, time int, net double")


def test_moments_are_sample_values(returns):
    got = validation.moments(returns, "strategy", "net").toPandas().set_index("strategy")
    for k in ("good", "none"):
        x = returns.where(f"strategy = '{k}'").toPandas()["net"].dropna()
        np.testing.assert_allclose(got.loc[k, ["n", "mean", "sd", "skew", "kurt"]].astype(float), [len(x), x.mean(), x.std(), x.skew(), x.kurt() + 3], rtol=1e-9)


def test_sharpe_probabilities(returns):
    got = validation.sharpe_stats(returns, trials=10).toPandas().set_index("strategy")
    x = returns.where("strategy = 'good'").toPandas()["net"].dropna()
    assert got.loc["good", "sharpe"] == pytest.approx(x.mean() / x.std() * np.sqrt(252))
    assert got.loc["good", "psr"] > 0.95 and got.loc["good", "dsr"] < got.loc["good", "psr"]
    assert got.loc[["short", "flat"], ["sharpe", "psr", "dsr"]].isna().all(axis=None)


def test_bootstrap_covers_all_trials_and_repeats(returns):
    one, two = (validation.bootstrap_sharpe(returns, n=120).toPandas().sort_values("strategy").reset_index(drop=True) for _ in range(2))
    pd.testing.assert_frame_equal(one, two)
    assert one["strategy"].tolist() == ["good", "none"] and (one["trials"] == 120).all()
    assert (one["ci_low"] < one["ci_high"]).all() and one["p_le_0"][0] < one["p_le_0"][1]


def test_resample_keeps_runs():
    x = np.arange(1000.0)
    got = validation.resampled(x, np.random.default_rng(1), 20)
    assert 0.9 < np.mean((np.diff(got) == 1) | (np.diff(got) == -999)) < 0.99


def test_permutation_finds_timing(spark):
    r = np.random.default_rng(5)
    move = r.normal(0, 0.01, 300)
    rows = [(k, t, [float(w)], [float(m)], float(w * m)) for k, ws in (("seer", np.sign(move)), ("coin", r.choice([-1.0, 1.0], 300))) for t, (w, m) in enumerate(zip(ws, move, strict=True))]
    got = validation.permutation_p(spark.createDataFrame(rows, "strategy string, time int, weights array<double>, moves array<double>, net double"), n=100).toPandas().set_index("strategy")
    assert got.loc["seer", "p"] == pytest.approx(1 / 101) and got.loc["coin", "p"] > 0.02
