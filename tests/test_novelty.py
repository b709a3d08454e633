"""Novelty of titles against a plain loop, and its tasks by the number of pairs."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import text as T


def _loop(rows):
    sets, out = {k: set(re.findall(T.TOKEN, (t or "").lower())) for k, _, _, t in rows}, {}
    for k, s, at, _ in rows:
        near = [len(sets[k] & sets[j]) / math.sqrt(len(sets[k]) * len(sets[j])) for j, s0, at0, _ in rows if s0 == s and (at0, j) < (at, k) and at - at0 <= 5 * 86400 and sets[j] and sets[k]]
        out[k] = round(1 - max(near, default=0.0), 6)
    return out


def test_novelty_in_more_tasks_as_pairs_grow(spark, monkeypatch):
    r = np.random.default_rng(4)
    words = ["alpha", "beta", "don't", "x-y", "Gamma", "delta", "é", "1"]
    rows = [(i, f"s{i % 3}", int(r.integers(0, 20 * 86400)), None if i % 37 == 0 else " ".join(r.choice(words, int(r.integers(0, 6))))) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, s string, at long, t string").withColumn("at", F.timestamp_seconds("at"))
    seen = []
    deal = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *c: seen.append(n) or deal(self, n, *c))
    monkeypatch.setattr(T, "PAIRS", 200)
    got = {x.k: x.novelty for x in T.novelty(df, "s", "at", "t", "k").collect()}
    assert got == pytest.approx(_loop(rows), abs=1e-6) and len(got) == 150
    few = min(seen)
    T.novelty(df.union(df.withColumn("s", F.concat("s", F.lit("+")))), "s", "at", "t", "k")
    assert few > 4 and seen[-1] >= 2 * few - 1


def test_novelty_of_nothing(spark):
    df = spark.createDataFrame([], "k long, s string, at timestamp, t string")
    assert T.novelty(df, "s", "at", "t", "k").collect() == []
