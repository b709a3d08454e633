"""Panel regression with symbol intercepts and Driscoll-Kraay errors, by distributed sums."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _square(row: dict, name: str, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for i, j in combinations_with_replacement(range(p), 2):
        out[i, j] = out[j, i] = row[f"{name}{i}_{j}"] or 0.0
    return out


def driscoll_kraay(rows: DataFrame, y: str, xs: list[str], lags: int, symbol: str = "symbol", time: str = "time") -> DataFrame:
    """(term, beta, se, t, n) of y on the columns ``xs`` and an intercept for each symbol.

    Errors may be correlated across symbols and up to ``lags`` periods: moments
    are summed by date, and the dates' lag products weighted by Bartlett's
    kernel. Intercepts are taken off as symbol means. Rows with a null are left
    out. To the driver go one row of sums for the slopes and one for their
    errors; dates, a row each, meet in one window.
    """
    p, own = len(xs), W.partitionBy(symbol)
    full = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *xs])).select(symbol, time, *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate([*xs, y])])
    x = full.select(symbol, time, *[(F.col(f"_{k}") - F.avg(f"_{k}").over(own)).alias(f"x{k}") for k in range(p + 1)])  # x{p} is y
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i, j in combinations_with_replacement(range(p + 1), 2)]
    seen = x.agg(F.count(F.lit(1)).alias("n"), *sums).first().asDict()
    kind = "term string, beta double, se double, t double, n long"
    if not seen["n"]:
        return rows.sparkSession.createDataFrame([(c, None, None, None, 0) for c in xs], kind)
    a = _square(seen, "a", p + 1)
    inverse = np.linalg.pinv(a[:p, :p])
    beta = inverse @ a[:p, p]

    rest: Column = F.col(f"x{p}")
    for k in range(p):
        rest = rest - F.lit(float(beta[k])) * F.col(f"x{k}")
    moments = x.groupBy(time).agg(*[F.sum(F.col(f"x{k}") * rest).alias(f"h{k}") for k in range(p)])
    dates, terms = W.orderBy(time), []
    late = {f"h{k}_{m}": F.coalesce(F.lag(f"h{k}", m).over(dates), F.lit(0.0)) for k in range(p) for m in range(1, lags + 1)}
    for i, j in combinations_with_replacement(range(p), 2):
        product = F.col(f"h{i}") * F.col(f"h{j}")
        for m in range(1, lags + 1):
            product = product + (1 - m / (lags + 1)) * (F.col(f"h{i}") * F.col(f"h{j}_{m}") + F.col(f"h{i}_{m}") * F.col(f"h{j}"))
        terms.append(F.sum(product).alias(f"s{i}_{j}"))
    middle = _square(moments.withColumns(late).agg(*terms).first().asDict(), "s", p)
    se = np.sqrt(np.maximum(np.diag(inverse @ middle @ inverse), 0))
    return rows.sparkSession.createDataFrame([(c, float(b), float(e), float(b / e) if e > 0 else None, seen["n"]) for c, b, e in zip(xs, beta, se, strict=True)], kind)
