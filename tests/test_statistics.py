"""Tails and corrections against numeric integration and loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.statistics import bh_adjust, student_p


def _numeric(t, v, n=400_001):
    """1 less the integral of the density from -t to t."""
    x = np.linspace(0, abs(t), n)
    f = np.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
    h = x[1] - x[0]
    return 1 - 2 * h / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())


def test_student_p(spark):
    cases = [(t, v) for v in (1, 2, 3, 14, 29, 500, 7000) for t in (0.01, 0.5, -1.0, 1.96, 2.7, -4.0, 8.0)]
    df = spark.createDataFrame([(float(t), v) for t, v in cases] + [(0.0, 5), (None, 5), (1.0, 0), (1.0, None), (2.144787, 14)], "t double, v int")
    got = [x.p for x in df.select(student_p(F.col("t"), F.col("v")).alias("p")).collect()]
    for (t, v), p in zip(cases, got, strict=False):
        assert p == pytest.approx(_numeric(t, v), abs=1e-11)
    assert got[len(cases) : -1] == [1.0, None, None, None] and got[-1] == pytest.approx(0.05, abs=1e-6)  # a tabulated value
    far = spark.createDataFrame([(12.0, 40)], "t double, v int").select(student_p(F.col("t"), F.col("v")).alias("p")).first().p
    assert far == pytest.approx(7.13e-15, rel=0.01)  # small tails are not rounded away


def _loop(p):
    known = sorted(x for x in p if x is not None)
    m, out, low = len(known), {}, 1.0
    for k in range(m, 0, -1):
        low = min(low, known[k - 1] * m / k)
        out.setdefault(known[k - 1], low)
    return out


@pytest.mark.parametrize("n", [0, 1, 300])
def test_bh_adjust(spark, n):
    r = np.random.default_rng(n)
    p = [float(x) for x in r.random(n) ** 3] + [0.04] * min(n, 50) + [0.0, 1.0, 1.0][:n] + [None] * 3
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    want = _loop(p)
    got = {x.k: x for x in bh_adjust(df, "p").collect()}
    assert len(got) == len(p)
    for k, x in enumerate(p):
        assert got[k].p == x and (got[k].p_adj is None if x is None else got[k].p_adj == pytest.approx(want[x], abs=1e-15))
