"""Earnings calls by literal texts, and risk parity against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calls
from tidemark.plans import parity

CALL = """We raised our outlook for 2025. Revenue grew.
We cut our full-year view before we raised guidance. Our guidance is unchanged. Guidance was discussed.
Operator: we will now begin.
First question: will AI demand grow? AI ai prices."""


def test_guidance(spark):
    rows = [(0, CALL), (1, "We withdrew guidance. We raised guidance."), (2, "Our outlook is on track."), (3, ""), (4, None), (5, "We raised guidance. We lowered our outlook.")]
    got = {r.k: r for r in calls.guidance(spark.createDataFrame(rows, "k int, t string"), "t", "k").collect()}
    assert [got[k].guidance for k in range(6)] == ["mixed", "withdraw", "reaffirm", "none", "none", "mixed"]
    assert [got[k].guidance_score for k in range(6)] == [0.0, -1.0, 0.0, None, None, 0.0]
    assert (got[0].g_raise, got[0].g_lower, got[0].g_reaffirm, got[0].g_withdraw, got[0].g_mention) == (1, 1, 1, 0, 1)


def test_call_metrics(spark):
    got = {r.k: r for r in calls.call_metrics(spark.createDataFrame([(0, CALL), (1, None)], "k int, t string"), "t", "k").collect()}
    assert (got[0].topics["AI"], got[0].topics["demand"], got[0].topics["pricing"], got[0].topics["guidance"]) == (2, 1, 1, 4)
    cut = CALL.rindex("\n", 0, CALL.index("we will now"))
    assert got[0].qa_share == pytest.approx((len(CALL) - cut) / len(CALL), abs=1e-6)
    assert (got[1].n_words, got[1].fls_per1k, got[1].fls_sentence_share, got[1].qa_share) == (0, None, None, None)


def test_split_qa(spark):
    df = spark.createDataFrame([(CALL,), ("no marker here",), ("",)], "t string").select(calls.split_qa(F.col("t")).alias("p"))
    got = [(r.p.remarks, r.p.questions) for r in df.collect()]
    cut = CALL.rindex("\n", 0, CALL.index("we will now"))
    assert got == [(CALL[:cut], CALL[cut:]), ("no marker here", None), ("", None)]


def test_risk_parity(spark):
    r = np.random.default_rng(2)
    days = pd.bdate_range("2020-01-01", periods=200)
    panel = pd.DataFrame({s: 100 * np.exp(np.cumsum(r.normal(0, v, 200))) for s, v in (("a", 0.01), ("b", 0.02), ("c", 0.04))}, index=days)
    long = panel.stack().rename("close").reset_index().set_axis(["time", "symbol", "close"], axis=1)
    long["time"] = long["time"].dt.date
    got = parity.risk_parity(spark.createDataFrame(long), n=60).toPandas().pivot(index="time", columns="symbol", values="weight")
    rets, want, held = panel.pct_change(), [], np.zeros(3)
    for i, d in enumerate(days):
        if i >= 60 and (d + pd.offsets.BDay(1)).month != d.month:
            cov = rets.iloc[i - 59 : i + 1].cov().to_numpy()
            held = np.ones(3) / 3
            for _ in range(200):
                risk = held * (cov @ held)
                held = held * np.sqrt(risk.mean() / risk)
                held = held / held.sum()
        want.append(held)
    np.testing.assert_allclose(got.to_numpy(), np.array(want), atol=2e-6)
    assert got.to_numpy()[-1].min() > 0
