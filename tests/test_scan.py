"""Native exponential averages against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import scan

SPECS = {"fast": ("x", 0.5, 0), "mid": ("x", 1 / 14, 14), "slow": ("x", 2 / 201, 200), "other": ("z", 2 / 27, 26)}


def _frame(seed, n, holes):
    r = np.random.default_rng(seed)
    x = 5e4 * np.exp(np.cumsum(r.normal(0, 0.02, n)))
    z = r.normal(0, 1, n)
    z[:7] = np.nan
    if holes:
        x[r.random(n) < 0.2] = np.nan
        x[n // 3 : n // 3 + 40] = np.nan
        z[::2] = np.nan
    return pd.DataFrame({"symbol": f"s{seed}{holes}", "time": pd.date_range("2020-01-01", periods=n), "x": x, "z": z, "_n": np.arange(n)})


@pytest.fixture(scope="module")
def frames():
    return pd.concat([_frame(1, 3000, False), _frame(2, 3000, True), _frame(3, 1, False), _frame(4, 20, True), _frame(5, 10, False).assign(x=np.nan)])


def _want(frames, c):
    x, weight, warm = SPECS[c]
    return frames.groupby("symbol", group_keys=False)[x].apply(lambda s: s.ewm(alpha=weight, adjust=False, min_periods=warm).mean())


def _spark(spark, frames):
    df = spark.createDataFrame(frames)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "z")}).withColumn("_n", F.lit("kept"))


@pytest.mark.parametrize("longest", [scan.LONGEST, 64])
def test_averages_against_pandas(spark, frames, monkeypatch, longest):
    monkeypatch.setattr(scan, "LONGEST", longest)
    df = _spark(spark, frames).drop("_n")
    got = scan.averages(df, SPECS).toPandas().sort_values(["symbol", "time"])
    frames = frames.sort_values(["symbol", "time"])
    for c in SPECS:
        np.testing.assert_allclose(got[c].to_numpy(float), _want(frames, c).to_numpy(float), rtol=1e-12, atol=1e-12)


def test_averages_by_chunk_against_pandas(spark, frames):
    """Chunks of 10 to 130 days: each a task's unit of its own; rows without a value have none."""
    df = _spark(spark, frames).drop("_n")
    frames = frames.sort_values(["symbol", "time"])
    for days in (10, 130):
        got = scan.averages_by_chunk(df, SPECS, F.floor(F.unix_date(F.to_date("time")) / days)).toPandas().sort_values(["symbol", "time"])
        for c, (x, _, _) in SPECS.items():
            np.testing.assert_allclose(got[c].to_numpy(float), _want(frames, c).where(frames[x].notna()).to_numpy(float), rtol=1e-12, atol=1e-12)


def test_weights_are_checked(spark, frames):
    with pytest.raises(ValueError):
        scan.averages(_spark(spark, frames).drop("_n"), {"y": ("x", 1.0, 0)})
