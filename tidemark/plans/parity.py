"""Equal risk contribution weights from trailing covariances, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.plans.portfolios import next_business_day

#: One month's covariances are one array, of as many cells as pairs of symbols.
TEXT = f"""
WITH times AS (SELECT time, row_number() OVER (ORDER BY time) AS i, month({next_business_day('time')}) <> month(time) AS month_end FROM (SELECT DISTINCT time FROM {{bars}}) t),
q AS (SELECT symbol, b.time, i, month_end, CASE WHEN lag(i) OVER w = i - 1 THEN close / lag(close) OVER w - 1 END AS r FROM {{bars}} b JOIN times ON times.time = b.time WINDOW w AS (PARTITION BY symbol ORDER BY i)),
c AS (SELECT x.time, x.i, x.month_end, x.symbol AS a, y.symbol AS b, covar_samp(x.r, y.r) OVER w AS cov, count(x.r + y.r) OVER w AS n FROM q x JOIN q y ON x.time = y.time
 WINDOW w AS (PARTITION BY x.symbol, y.symbol ORDER BY x.i RANGE BETWEEN {{span}} PRECEDING AND CURRENT ROW)),
m AS (SELECT time, array_sort(collect_set(a)) AS names, transform(array_sort(collect_list(struct(a, b, cov))), s -> s.cov) AS cov, sqrt(count(*)) AS k, min(n) AS least FROM c WHERE month_end AND i > {{span}} + 1 GROUP BY time),
e AS (SELECT time, names, aggregate(sequence(1, {{rounds}}), transform(names, s -> 1 / k), (x, _) ->
  transform(array(transform(x, (v, j) -> v * aggregate(sequence(0, size(x) - 1), 0D, (t, l) -> t + cov[CAST(j * k + l AS INT)] * x[l]))),
   rc -> transform(x, (v, j) -> v * sqrt(aggregate(rc, 0D, (t, y) -> t + y) / size(rc) / greatest(rc[j], 1e-18D))))[0],
  x -> x) AS x FROM (SELECT * FROM m WHERE least >= 2 AND size(cov) = CAST(k * k AS INT)) s),
n AS (SELECT time, explode(map_from_arrays(names, transform(x, v -> v / aggregate(x, 0D, (t, y) -> t + y)))) AS (symbol, weight) FROM e)
SELECT q.symbol, CAST(q.time AS STRING) AS time, round(coalesce(last_value(n.weight, true) OVER (PARTITION BY q.symbol ORDER BY q.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0D), 6) AS weight
FROM q LEFT JOIN n ON n.time = q.time AND n.symbol = q.symbol"""


def risk_parity(bars: DataFrame, n: int = 126, rounds: int = 200) -> DataFrame:
    """(symbol, time, weight): at each month end with n returns behind it, weights by that many multiplicative rounds; held until the next, 0 before the first.

    Symbols are all paired, as the covariance matrix needs them; rows grow
    with the square of the symbols and with the bars.
    """
    return bars.sparkSession.sql(TEXT, bars=bars, span=n - 1, rounds=rounds)
