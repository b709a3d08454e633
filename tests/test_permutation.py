"""The stratified permutation against plain numpy."""

import datetime

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import permutation


def _events(effect, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for s in "AB":
        for d in sorted(r.choice(900, 150, replace=False)):
            flag = bool(r.random() < 0.3)
            rows.append((s, datetime.date(2020, 1, 1) + datetime.timedelta(int(d)), flag, float(r.normal(effect * flag, 0.02))))
    return pd.DataFrame([*rows, ("C", datetime.date(2021, 5, 5), True, None)], columns=["symbol", "date", "flag", "car5"])


def _numpy(ev, trials=4000):
    ev = ev.dropna()
    r, v, f = np.random.default_rng(0), ev.car5.to_numpy(), ev.flag.to_numpy(bool)
    strata = [np.flatnonzero(x) for x in (ev.symbol + ev.date.map(lambda d: str(d.year))).pipe(lambda k: [(k == u).to_numpy() for u in k.unique()])]
    gap = lambda f: abs(v[f].mean() - v[~f].mean())
    real, beyond = gap(f), 0
    for _ in range(trials):
        g = f.copy()
        for ix in strata:
            g[ix] = r.permutation(g[ix])
        beyond += gap(g) >= real
    a, b = (ev[ev.flag == s].groupby("date").car5.mean() for s in (True, False))
    t = (a.mean() - b.mean()) / np.sqrt(a.var() / len(a) + b.var() / len(b))
    return (beyond + 1) / (trials + 1), t, len(a), len(b), a.mean() * 1e4


@pytest.mark.parametrize("effect", [0.0, 0.004])
def test_compare(spark, effect):
    ev = _events(effect)
    df = spark.createDataFrame(ev.astype({"flag": object}).where(ev.notna(), None), "symbol string, date date, flag boolean, car5 double")
    x, again = (permutation.compare(d, "car5", trials=1000).first() for d in (df, df.repartition(5)))
    assert x == again
    p, t, a, b, mean = _numpy(ev)
    assert abs(x.perm_p - p) < 4 * np.sqrt(p * (1 - p) / 1000) + 0.003
    assert (x.dates_flag, x.dates_noflag) == (a, b) and x.t == pytest.approx(t, abs=0.006) and x.mean_flag_bp == pytest.approx(mean, abs=0.06) and x.note is None


def test_too_few(spark):
    df = spark.createDataFrame([("A", datetime.date(2020, 1, k + 1), k == 0, 0.1) for k in range(8)], "symbol string, date date, flag boolean, car5 double")
    x = permutation.compare(df, "car5", trials=20).first()
    assert (x.n_flag, x.n_noflag, x.note, x.perm_p) == (1, 7, "too few events", None)
    assert permutation.compare(df.limit(0), "car5", trials=20).first().note == "too few events"
