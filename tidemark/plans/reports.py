"""Release dates, revenue as of a date, aligned series, news ranking, boards, valuation and grading, as SQL that Spark and the oracle both read."""

from __future__ import annotations

from tidemark.plans.studies import GRID, SHARPE

W = "PARTITION BY symbol ORDER BY time"

#: A report's checks, as (check, metric, comparison, bar). The last names a metric that no report has.
CHECKS = "(VALUES ('sharpe_min', 'sharpe', 'at least', 0.3D), ('total_min', 'total', 'at least', 0.1D), ('days_min', 'n', 'at least', 250D), ('worst_day', 'worst', 'at least', -0.05D), ('up_rate_max', 'up_rate', 'at most', 0.9D), ('calmar_min', 'calmar', 'at least', 0.5D))"


def fading_growth(earnings: str, growth: str, years: int = 10, last: float = 0.025, discount: float = 0.1) -> str:
    """Two-stage value: growth falls in a line to ``last`` over the years, then stays."""
    flow, value = earnings, []
    for t in range(years):
        flow = f"{flow} * (1 + {growth} * {1 - t / (years - 1)!r}D + {last * t / (years - 1)!r}D)"
        value.append(f"{flow} / {(1 + discount) ** (t + 1)!r}D")
    return " + ".join(value) + f" + {flow} * {(1 + last) / (discount - last) / (1 + discount) ** years!r}D"


def ranks(column: str) -> str:
    """Average ranks of a column within its symbol, ties sharing their mean."""
    return f"rank() OVER (PARTITION BY symbol ORDER BY {column}) + (count(*) OVER (PARTITION BY symbol, {column}) - 1) / 2"


SQL = {
    "release_timing": """
WITH e AS (SELECT user_id, ts, value, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS m, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS est,
 row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS late FROM events WHERE event_type = 'purchase'),
q AS (SELECT *, CAST(date_trunc('quarter', day) AS DATE) + CAST(-1 AS INT) AS ended FROM e WHERE late = 1)
SELECT user_id, CAST(day AS STRING) AS day, CASE WHEN m = 0 THEN 'unknown' WHEN m < 570 THEN 'BMO' WHEN m >= 960 THEN 'AMC' ELSE 'DMH' END AS timing, concat(CAST(year(ended) AS STRING), 'Q', CAST(quarter(ended) AS STRING)) AS quarter,
 round(est, 6) AS estimate, value AS actual, round((value - est) / nullif(abs(est), 0) * 100, 5) AS surprise_pct FROM q""",
    "revenue_as_of": """
WITH r AS (SELECT o_orderpriority AS line, year(o_orderdate) * 4 + quarter(o_orderdate) AS q, max(CAST(o_orderdate AS DATE)) AS ended, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2),
y AS (SELECT r.line, r.q, r.ended, r.revenue, r.revenue / nullif(p.revenue, 0) - 1 AS yoy FROM r LEFT JOIN r p ON p.line = r.line AND p.q = r.q - 4),
e AS (SELECT o_orderpriority AS line, CAST(o_orderdate AS DATE) AS day, max(year(o_orderdate) * 4 + quarter(o_orderdate)) AS q FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2),
near AS (SELECT line, day, q - back AS q FROM e CROSS JOIN (VALUES (0), (1), (2)) AS b(back)),
f AS (SELECT near.line, near.day, max(ended) AS ended, max_by(revenue, ended) AS revenue, max_by(yoy, ended) AS yoy FROM near JOIN y ON y.line = near.line AND y.q = near.q WHERE ended < day AND unix_date(day) - unix_date(ended) <= 100 GROUP BY near.line, near.day)
SELECT e.line, CAST(e.day AS STRING) AS day, CAST(ended AS STRING) AS fiscal_end, revenue, round(yoy, 6) AS revenue_yoy FROM e LEFT JOIN f ON f.line = e.line AND f.day = e.day""",
    "alignment_stats": f"""
WITH a AS (SELECT symbol, time, round(close / lag(close) OVER ({W}) - 1, 8) AS x, round(lead(close, 5) OVER ({W}) / close - 1, 8) AS y FROM bars),
r AS (SELECT symbol, x, y, {ranks('x')} AS rx, {ranks('y')} AS ry FROM a WHERE x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT symbol, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) >= 3 THEN corr(x, y) END AS r, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS s FROM r GROUP BY symbol),
z AS (SELECT *, CASE WHEN n > 3 AND abs(r) < 1 THEN ln((1 + r) / (1 - r)) / 2 END AS z, 1.96D / sqrt(CAST(CASE WHEN n > 3 THEN n - 3 END AS DOUBLE)) AS w FROM c)
SELECT symbol, n, round(r, 6) AS pearson, round(s, 6) AS spearman, round(1 - 2 / (exp(2 * (z - w)) + 1), 6) AS ci95_lo, round(1 - 2 / (exp(2 * (z + w)) + 1), 6) AS ci95_hi FROM z""",
    "reaction_summary": f"""
WITH b AS (SELECT symbol, time, open, close, lag(close) OVER ({W}) AS was, lead(close, 5) OVER ({W}) AS c5, lead(close, 20) OVER ({W}) AS c20, volume / nullif(avg(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) - 1 AS surprise, row_number() OVER ({W}) AS k FROM bars),
x AS (SELECT symbol, close / was - 1 AS day1, open / was - 1 AS gap, c5 / close - 1 AS drift5, c20 / close - 1 AS drift20, round(surprise, 8) AS surprise FROM b WHERE k % 63 = 0 AND was IS NOT NULL)
SELECT symbol, CAST(count(*) AS BIGINT) AS n, round(avg(abs(day1)), 7) AS avg_abs_day1, round(percentile(abs(day1), 0.5), 7) AS median_abs_day1, round(avg(abs(gap)), 7) AS avg_abs_gap, round(avg(CASE WHEN day1 > 0 THEN 1D ELSE 0D END), 6) AS up_rate, round(avg(CASE WHEN day1 < 0 THEN 1D ELSE 0D END), 6) AS down_rate,
 round(avg(drift5), 7) AS avg_drift5, round(avg(drift20), 7) AS avg_drift20, CAST(sum(CASE WHEN surprise > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_beats, CAST(sum(CASE WHEN surprise < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_misses,
 round(avg(CASE WHEN surprise > 0 THEN day1 END), 7) AS day1_after_beats, round(avg(CASE WHEN surprise < 0 THEN day1 END), 7) AS day1_after_misses, round(avg(CASE WHEN surprise > 0 THEN drift20 END), 7) AS drift20_after_beats, round(avg(CASE WHEN surprise < 0 THEN drift20 END), 7) AS drift20_after_misses,
 CAST(sum(CASE WHEN surprise > 0 AND day1 < 0 THEN 1 ELSE 0 END) AS BIGINT) AS beat_but_sold_off, CAST(sum(CASE WHEN surprise < 0 AND day1 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS miss_but_rallied, round(corr(surprise, day1), 6) AS corr_surprise_day1 FROM x GROUP BY symbol""",
    "ranked_headlines": """
WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(DISTINCT event_type) AS DOUBLE) AS n_sources FROM events GROUP BY 1, 2), z AS (SELECT max(ts) AS last_ts FROM events),
w AS (SELECT * FROM (VALUES ('purchase', 1D), ('signup', 0.9D), ('view', 0.7D), ('click', 0.6D)) AS w(event_type, weight)),
a AS (SELECT e.event_id, e.event_type, value, n_sources, coalesce(weight, 0.5D) AS weight, unix_date(CAST(last_ts AS DATE)) - unix_date(CAST(ts AS DATE)) AS days, (hour(last_ts) - hour(ts)) * 60 + minute(last_ts) - minute(ts) AS minutes
 FROM events e JOIN n ON n.user_id = e.user_id AND n.day = CAST(e.ts AS DATE) LEFT JOIN w ON w.event_type = e.event_type CROSS JOIN z)
SELECT event_id, event_type, round(power(0.5D, (days + minutes / 1440D)) * (0.3D + least(abs(value - 100) / 100, 1D)) * weight * (1 + 0.25D * (n_sources - 1)), 9) AS rank FROM a""",
    "firm_daily": """
WITH a AS (SELECT event_type AS symbol, value, CAST(ts AS DATE) + CAST(CASE WHEN hour(ts) >= 20 THEN 1 ELSE 0 END AS INT) AS day FROM events),
b AS (SELECT symbol, value, day + CAST(CASE (unix_date(day) + 3) % 7 WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS INT) AS day FROM a),
g AS (SELECT symbol, day, CAST(count(*) AS BIGINT) AS n, avg(value / 100 - 1) AS tone, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_fresh, avg(CASE WHEN value >= 50 THEN value / 100 - 1 END) AS tone_fresh, avg(CASE WHEN value < 50 THEN value / 100 - 1 END) AS tone_stale FROM b GROUP BY symbol, day),
span AS (SELECT symbol, explode(sequence(min(day), max(day), INTERVAL 1 DAY)) AS day FROM g GROUP BY symbol), s AS (SELECT symbol, CAST(day AS DATE) AS day FROM span)
SELECT s.symbol, CAST(s.day AS STRING) AS day, coalesce(n, 0) AS n, round(tone, 7) AS tone, coalesce(n_fresh, 0) AS n_fresh, round(tone_fresh, 7) AS tone_fresh, coalesce(n - n_fresh, 0) AS n_stale, round(tone_stale, 7) AS tone_stale
FROM s LEFT JOIN g ON g.symbol = s.symbol AND g.day = s.day WHERE (unix_date(s.day) + 3) % 7 < 5""",
    "trend_board": f"""
WITH a AS (SELECT symbol, time, close, lag(close, 21) OVER ({W}) AS c21, lag(close, 63) OVER ({W}) AS c63, lag(close, 252) OVER ({W}) AS c252, avg(close) OVER ({W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
b AS (SELECT *, lag(m, 21) OVER ({W}) AS m21 FROM a),
c AS (SELECT symbol, time, close, close / c21 - 1 AS r1m, close / c63 - 1 AS r3m, CASE WHEN n > 253 THEN close / c252 - 1 END AS r12m, round(close / m - 1, 8) AS over, round(m / m21 - 1, 8) AS slope FROM b WHERE k = 1 AND n >= 210)
SELECT symbol, CAST(time AS STRING) AS time, close AS last, round(r1m, 7) AS r1m, round(r3m, 7) AS r3m, round(r12m, 7) AS r12m, round(over, 7) AS vs_200d, round(slope, 7) AS slope_1m,
 CASE WHEN slope > 0 AND over > 0.15D THEN 'boom: extended' WHEN slope > 0 AND over > 0 THEN 'boom: intact' WHEN slope > 0 THEN 'test: below rising average' WHEN over > 0 THEN 'repair: above falling average' WHEN over < -0.15D THEN 'bust: capitulation' ELSE 'bust: trend down' END AS stage FROM c""",
    "dcf_owner_earnings": f"""
WITH y AS (SELECT c_nationkey AS nation, year(o_orderdate) AS y, sum(o_totalprice) AS oe, max(CAST(o_orderdate AS DATE)) AS day FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
g AS (SELECT nation, min_by(oe, y) AS first_oe, max_by(oe, y) AS oe, (unix_date(max(day)) - unix_date(min(day))) / 365.25D AS years FROM y WHERE y < 1998 GROUP BY nation),
c AS (SELECT nation, oe, power(oe / first_oe, 1 / nullif(years, 0)) - 1 AS growth FROM g WHERE oe > 0 AND first_oe > 0)
SELECT nation, round(oe, 2) AS owner_earnings, round(growth, 8) AS growth, round(({fading_growth('1D', 'growth')}), 5) AS value_multiple FROM c""",
    "net_liquidity_weekly": """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p FROM orders GROUP BY 1),
h AS (SELECT day, max_by(f, CASE WHEN f IS NOT NULL THEN day END) OVER so_far AS f, max_by(o, CASE WHEN o IS NOT NULL THEN day END) OVER so_far AS o, max_by(p, CASE WHEN p IS NOT NULL THEN day END) OVER so_far AS p FROM d WINDOW so_far AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
w AS (SELECT day, day + CAST(6 - unix_date(day) % 7 AS INT) AS wednesday, f, o, p, f - o - p AS net FROM h WHERE f IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL)
SELECT CAST(wednesday AS STRING) AS wednesday, round(max_by(f, day), 2) AS first, round(max_by(o, day), 2) AS second, round(max_by(p, day), 2) AS third, round(max_by(net, day), 2) AS net FROM w GROUP BY wednesday""",
    "graded_checks": f"""
WITH {GRID}, m AS (SELECT fast, slow, {SHARPE} AS sharpe, sum(net) AS total, CAST(count(*) AS DOUBLE) AS n, min(net) AS worst, avg(CASE WHEN net > 0 THEN 1D ELSE 0D END) AS up_rate FROM p GROUP BY fast, slow),
k AS (SELECT * FROM {CHECKS} AS k(name, metric, op, bar)),
v AS (SELECT fast, slow, name, metric, op, bar, round(CASE metric WHEN 'sharpe' THEN sharpe WHEN 'total' THEN total WHEN 'n' THEN n WHEN 'worst' THEN worst WHEN 'up_rate' THEN up_rate END, 5) AS value FROM m CROSS JOIN k),
d AS (SELECT *, coalesce(CASE op WHEN 'at least' THEN value >= bar WHEN 'at most' THEN value <= bar END, false) AS passed FROM v)
SELECT fast, slow, name, value, bar, passed, CASE WHEN metric NOT IN ('sharpe', 'total', 'n', 'worst', 'up_rate') THEN 'unknown metric' WHEN value IS NULL THEN 'no value' ELSE op END AS note, min(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY fast, slow) = 1 AS all_passed FROM d""",
}
