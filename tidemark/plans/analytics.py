"""Queries over bars, chains, positions, documents and datasets, as Spark SQL.

Each text names its inputs as views: the driver's tables, and ``bars``,
``sparse`` and ``hourly``. ``ORACLE`` is the same query for another SQL engine,
with that engine's spelling of a few functions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import chains, portfolios, reports, studies
from tidemark.sources.bars import DAILY_SQL, HOURLY_SQL, SPARSE_SQL, daily_bars, hourly_bars, sparse_bars, table

W = "PARTITION BY symbol ORDER BY time"

#: A chain of options made from line items: status as type, price bucket as strike, quarter end as expiry.
CHAIN = """chain AS (
 SELECT CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'P' END AS kind, CAST(floor(p_retailprice / 5) * 5 AS DOUBLE) AS strike, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS expiry,
  sum(l_quantity) AS oi, CAST(count(*) AS DOUBLE) AS volume, avg(l_discount) * 100 AS mid
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""

#: Weekly positions by flag.
COT = """cot AS (
 SELECT l_returnflag AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS time, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) - sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS net, sum(l_quantity) AS oi
 FROM lineitem GROUP BY 1, 2)"""

RET = f"rets AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM bars)"

SQL: dict[str, str] = {
    "resample_weekly": "SELECT symbol, CAST(CAST(date_trunc('week', time) AS DATE) AS STRING) AS time, min_by(open, time) AS open, max(high) AS high, min(low) AS low, max_by(close, time) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2",
    "dense_calendar_ffill": """
WITH span AS (SELECT symbol, min(time) AS lo, max(time) AS hi FROM sparse GROUP BY symbol),
days AS (SELECT symbol, CAST(d AS DATE) AS time FROM (SELECT symbol, explode(sequence(lo, hi, INTERVAL 1 DAY)) AS d FROM span) s),
f AS (SELECT days.symbol, days.time, max(CASE WHEN s.close IS NOT NULL THEN days.time END) OVER (PARTITION BY days.symbol ORDER BY days.time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM days LEFT JOIN sparse s ON s.symbol = days.symbol AND s.time = days.time)
SELECT f.symbol, CAST(f.time AS STRING) AS time, s.close, CAST(datediff(f.time, f.seen) AS BIGINT) AS age FROM f JOIN sparse s ON s.symbol = f.symbol AND s.time = f.seen""",
    "pivot_levels": f"""
WITH l AS (SELECT symbol, max_by(high, time) AS h, max_by(low, time) AS lo, max_by(close, time) AS c, max_by(open, time) AS o FROM bars GROUP BY symbol), p AS (SELECT *, (h + lo + c) / 3 AS pp, h - lo AS rg FROM l)
SELECT symbol, round(pp, 6) AS pp, round(2 * pp - lo, 6) AS r1, round(2 * pp - h, 6) AS s1, round(pp + rg, 6) AS r2, round(pp - rg, 6) AS s2, round(c + rg * 1.1D / 4, 6) AS cam_r3, round(c - rg * 1.1D / 4, 6) AS cam_s3,
 round((h + lo + 2 * c) / 4, 6) AS woodie_pp, round(pp + 0.382D * rg, 6) AS fib_r1, round(pp - 0.618D * rg, 6) AS fib_s2 FROM p""",
    "fib_levels": """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS n FROM bars), w AS (SELECT symbol, max(high) AS hi, min(low) AS lo, max_by(time, high) AS t_hi, min_by(time, low) AS t_lo FROM k WHERE n <= 120 GROUP BY symbol)
SELECT symbol, hi, lo, CASE WHEN t_hi > t_lo THEN 'up' ELSE 'down' END AS leg, """ + ", ".join(f"round(CASE WHEN t_hi > t_lo THEN hi - {f}D * (hi - lo) ELSE lo + {f}D * (hi - lo) END, 6) AS f{str(f)[2:]}" for f in (0.236, 0.382, 0.5, 0.618, 0.786)) + " FROM w",
    "support_resistance_islands": f"""
WITH t AS (SELECT *, count(high) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n, max(high) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS hh, min(low) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS ll FROM bars),
p AS (SELECT symbol, time, high AS price FROM t WHERE n = 11 AND high = hh UNION ALL SELECT symbol, time, low AS price FROM t WHERE n = 11 AND low = ll),
tol AS (SELECT symbol, avg(high - low) * 0.01D AS tol FROM bars GROUP BY symbol),
g AS (SELECT p.symbol, p.time, price, CASE WHEN price - lag(price) OVER (PARTITION BY p.symbol ORDER BY price, p.time) > tol THEN 1 ELSE 0 END AS jump FROM p JOIN tol ON p.symbol = tol.symbol),
c AS (SELECT *, sum(jump) OVER (PARTITION BY symbol ORDER BY price, time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
SELECT symbol, CAST(island AS BIGINT) AS island, round(avg(price), 4) AS level, CAST(count(*) AS BIGINT) AS touches, CAST(max(time) AS STRING) AS last_touch FROM c GROUP BY symbol, island""",
    "market_profile": """
WITH r AS (SELECT symbol, min(low) AS lo, (max(high) - min(low)) / 50 AS w FROM bars GROUP BY symbol), b AS (SELECT bars.symbol, high, low, volume, r.lo, r.w FROM bars JOIN r ON bars.symbol = r.symbol),
x AS (SELECT symbol, bin, high, low, volume, lo + bin * w AS b0, lo + (bin + 1) * w AS b1 FROM (SELECT *, explode(sequence(0, 49)) AS bin FROM b) e)
SELECT symbol, CAST(bin AS BIGINT) AS bin, round(sum(volume * greatest(0D, least(high, b1) - greatest(low, b0)) / nullif(high - low, 0)), 4) AS volume FROM x WHERE high > low GROUP BY symbol, bin""",
    "abnormal_returns": f"""
WITH {RET}, m AS (SELECT time, avg(close) AS mc FROM bars GROUP BY time), mr AS (SELECT time, mc / lag(mc) OVER (ORDER BY time) - 1 AS rm FROM m), j AS (SELECT rets.symbol, rets.time, r, rm FROM rets JOIN mr ON rets.time = mr.time WHERE r IS NOT NULL AND rm IS NOT NULL),
b AS (SELECT *, CASE WHEN count(r) OVER ({W} ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) >= 125 THEN covar_samp(r, rm) OVER ({W} ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) / nullif(var_samp(rm) OVER ({W} ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING), 0) END AS beta FROM j),
a AS (SELECT *, r - beta * rm AS ar FROM b), z AS (SELECT *, CASE WHEN count(ar) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) >= 30 THEN stddev_samp(ar) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS sd FROM a)
SELECT symbol, CAST(time AS STRING) AS time, round(beta, 6) AS beta, round(ar, 6) AS ar, round(ar / nullif(sd, 0), 5) AS z FROM z""",
    "forward_car": f"""
WITH m AS (SELECT time, avg(open) AS mo, avg(close) AS mc FROM bars GROUP BY time), j AS (SELECT symbol, bars.time, open, close, mo, mc FROM bars JOIN m ON bars.time = m.time)
SELECT symbol, CAST(time AS STRING) AS time, """ + ", ".join(f"round(lead(close, {h}) OVER ({W}) / lead(open) OVER ({W}) - lead(mc, {h}) OVER ({W}) / lead(mo) OVER ({W}), 6) AS car{h}" for h in (1, 5, 10)) + " FROM j",
    "summary_stats": f"""
WITH {RET}, d AS (SELECT *, close / max(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM rets), q AS (SELECT symbol, percentile(r, 0.05) AS q05 FROM rets GROUP BY symbol)
SELECT d.symbol, CAST(min(time) AS STRING) AS first_day, CAST(max(time) AS STRING) AS last_day, round(max_by(close, time) / min_by(close, time) - 1, 6) AS total_return, round(stddev_samp(r) * sqrt(252D), 6) AS vol, round(avg(r) * 252 / (stddev_samp(r) * sqrt(252D)), 6) AS sharpe,
 round(avg(r) * 252 / (stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252D)), 6) AS sortino, round(min(dd), 6) AS max_drawdown, round(avg(CASE WHEN r > 0 THEN 1D WHEN r IS NOT NULL THEN 0D END), 6) AS hit_rate, round(max(q05), 6) AS var_95, round(avg(CASE WHEN r <= q05 THEN r END), 6) AS cvar_95
 FROM d JOIN q ON d.symbol = q.symbol GROUP BY d.symbol""",
    "correlation_matrix": f"WITH {RET} SELECT a.symbol AS a, b.symbol AS b, CAST(count(*) AS BIGINT) AS n, round(covar_samp(a.r, b.r) / nullif(stddev_samp(a.r) * stddev_samp(b.r), 0), 6) AS corr FROM rets a JOIN rets b ON a.time = b.time WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2",
    "relative_strength": f"""
WITH l AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS n, """ + ", ".join(f"close / lag(close, {k}) OVER ({W}) - 1 AS r{k}" for k in (21, 63, 126, 252)) + """ FROM bars), x AS (SELECT * FROM l WHERE n = 1)
SELECT symbol, """ + ", ".join(f"round(r{k}, 6) AS r{k}" for k in (21, 63, 126, 252)) + ", round((" + " + ".join(f"CAST(rank() OVER (ORDER BY r{k}) AS DOUBLE) / count(*) OVER ()" for k in (21, 63, 126, 252)) + ") / 4, 6) AS rank_avg FROM x",
    "pair_zscore": f"""
WITH p AS (SELECT 'A-N' AS symbol, a.time, ln(a.close) AS la, ln(b.close) AS lb FROM bars a JOIN bars b ON a.time = b.time WHERE a.symbol = 'A' AND b.symbol = 'N'),
h AS (SELECT *, CASE WHEN count(la) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) = 60 THEN covar_samp(la, lb) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) / nullif(var_samp(lb) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0) END AS beta FROM p), s AS (SELECT *, la - beta * lb AS spread FROM h)
SELECT CAST(time AS STRING) AS time, round(beta, 6) AS beta, round(spread, 6) AS spread, round(CASE WHEN count(spread) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) = 60 THEN (spread - avg(spread) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) / nullif(stddev_samp(spread) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0) END, 5) AS z FROM s""",
    "sma_cross_backtest": f"""
WITH s AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, CASE WHEN count(close) OVER ({W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) = 200 AND avg(close) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > avg(close) OVER ({W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) THEN 1D ELSE 0D END / 3 AS w FROM bars),
k AS (SELECT *, coalesce(lag(w) OVER ({W}), 0D) AS held, coalesce(lag(w) OVER ({W}), 0D) - coalesce(lag(w, 2) OVER ({W}), 0D) AS traded FROM s)
SELECT CAST(time AS STRING) AS time, round(sum(held * coalesce(r, 0D)), 8) AS gross, round(sum(abs(traded)), 8) AS turnover, round(sum(held * coalesce(r, 0D)) - sum(abs(traded)) * 5 / 10000D, 8) AS net, round(sum(held), 8) AS exposure FROM k GROUP BY time""",
    "xs_momentum_weights": f"""
WITH m AS (SELECT symbol, time, lag(close, 21) OVER ({W}) / lag(close, 252) OVER ({W}) - 1 AS mom FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY time ORDER BY mom DESC, symbol) AS rk FROM m WHERE mom IS NOT NULL)
SELECT symbol, CAST(time AS STRING) AS time, round(mom, 6) AS mom, CASE WHEN rk <= 1 THEN 1D ELSE 0D END AS weight FROM k""",
    "inverse_vol_weights": f"""
WITH {RET}, v AS (SELECT symbol, time, CASE WHEN count(r) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) = 60 THEN stddev_samp(r) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS vol FROM rets)
SELECT symbol, CAST(time AS STRING) AS time, round((1 / vol) / sum(1 / vol) OVER (PARTITION BY time), 6) AS weight FROM v WHERE vol > 0""",
    "cot_index": f"""
WITH {COT}, x AS (SELECT *, count(net) OVER ({W} ROWS BETWEEN 155 PRECEDING AND CURRENT ROW) AS n, min(net) OVER ({W} ROWS BETWEEN 155 PRECEDING AND CURRENT ROW) AS lo, max(net) OVER ({W} ROWS BETWEEN 155 PRECEDING AND CURRENT ROW) AS hi, avg(net) OVER ({W} ROWS BETWEEN 155 PRECEDING AND CURRENT ROW) AS mu, stddev_samp(net) OVER ({W} ROWS BETWEEN 155 PRECEDING AND CURRENT ROW) AS sd FROM cot)
SELECT symbol, CAST(time AS STRING) AS time, net, round(net - lag(net) OVER ({W}), 6) AS change, round(100 * net / nullif(oi, 0), 6) AS pct_oi, round(CASE WHEN n >= 26 THEN 100 * (net - lo) / nullif(hi - lo, 0) END, 6) AS cot_index, round(CASE WHEN n >= 26 THEN (net - mu) / nullif(sd, 0) END, 6) AS z FROM x""",
    "positioning_divergence": f"""
WITH {COT}, u AS (SELECT symbol, time, close, CAST(NULL AS DOUBLE) AS pct, 0 AS side FROM bars UNION ALL SELECT symbol, time, CAST(NULL AS DOUBLE), 100 * net / nullif(oi, 0), 1 FROM cot),
f AS (SELECT *, max(CASE WHEN side = 0 THEN time END) OVER (PARTITION BY symbol ORDER BY time, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at FROM u), j AS (SELECT f.symbol, f.time, f.pct, bars.close AS px FROM f JOIN bars ON f.symbol = bars.symbol AND f.at = bars.time WHERE side = 1),
d AS (SELECT *, px / lag(px, 4) OVER ({W}) - 1 AS dp, pct - lag(pct, 4) OVER ({W}) AS dn FROM j)
SELECT symbol, CAST(time AS STRING) AS time, px, round(dp, 6) AS price_change, round(dn, 6) AS position_change, CASE WHEN dp IS NULL OR dn IS NULL THEN 'n/a' WHEN dp > 0.02D AND dn < -2 THEN 'bearish divergence' WHEN dp < -0.02D AND dn > 2 THEN 'bullish divergence' WHEN dp > 0.02D AND dn > 2 THEN 'confirmed up' WHEN dp < -0.02D AND dn < -2 THEN 'confirmed down' ELSE 'neutral' END AS label FROM d""",
    "macro_asof_changes": "WITH l AS (SELECT symbol, max(time) AS t FROM sparse GROUP BY symbol) SELECT s.symbol, CAST(max(l.t) AS STRING) AS latest, max_by(close, time) AS value, " + ", ".join(f"round(max_by(close, time) - max_by(CASE WHEN time <= l.t - INTERVAL '{d}' DAY THEN close END, CASE WHEN time <= l.t - INTERVAL '{d}' DAY THEN time END), 6) AS change_{d}d" for d in (30, 91, 365)) + " FROM sparse s JOIN l ON s.symbol = l.symbol GROUP BY s.symbol",
    "max_pain": f"WITH {CHAIN}, k AS (SELECT DISTINCT expiry, strike AS settle FROM chain), v AS (SELECT k.expiry, settle, sum(CASE WHEN kind = 'C' THEN greatest(settle - strike, 0) ELSE greatest(strike - settle, 0) END * oi) AS pay FROM k JOIN chain c ON k.expiry = c.expiry GROUP BY k.expiry, settle), n AS (SELECT *, row_number() OVER (PARTITION BY expiry ORDER BY pay, settle) AS rk FROM v) SELECT CAST(expiry AS STRING) AS expiry, settle AS max_pain, round(pay, 4) AS pay FROM n WHERE rk = 1",
    "put_call_ratios_rollup": f"WITH {CHAIN} SELECT coalesce(CAST(expiry AS STRING), 'ALL') AS expiry, round(sum(CASE WHEN kind = 'P' THEN volume END) / nullif(sum(CASE WHEN kind = 'C' THEN volume END), 0), 6) AS pc_volume, round(sum(CASE WHEN kind = 'P' THEN oi END) / nullif(sum(CASE WHEN kind = 'C' THEN oi END), 0), 6) AS pc_oi FROM chain GROUP BY ROLLUP (expiry)",
    "oi_by_strike": f"WITH {CHAIN} SELECT strike, round(sum(CASE WHEN kind = 'C' THEN oi ELSE 0D END), 4) AS call_oi, round(sum(CASE WHEN kind = 'P' THEN oi ELSE 0D END), 4) AS put_oi, round(sum(CASE WHEN kind = 'C' THEN oi ELSE -oi END), 4) AS net_oi FROM chain GROUP BY strike",
    "unusual_activity": f"""
WITH {CHAIN}, m AS (SELECT expiry, kind, percentile(CASE WHEN volume > 0 THEN volume END, 0.5) AS med FROM chain GROUP BY expiry, kind), x AS (SELECT c.*, med, mid * volume * 100 AS premium, volume / nullif(oi, 0) AS vol_oi FROM chain c JOIN m ON c.expiry = m.expiry AND c.kind = m.kind),
f AS (SELECT *, row_number() OVER (ORDER BY round(premium, 4) DESC, expiry, kind, strike) AS rk FROM x WHERE volume >= 2 AND volume >= 1.5D * med)
SELECT CAST(expiry AS STRING) AS expiry, kind, strike, volume, oi, round(premium, 4) AS premium, round(vol_oi, 6) AS vol_oi FROM f WHERE rk <= 15""",
    "earnings_reaction": """
WITH e AS (SELECT o_custkey AS cust, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS actual, o_orderpriority AS symbol, lag(o_totalprice, 4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS estimate FROM orders),
n AS (SELECT symbol, time, open, close, lead(open) OVER (PARTITION BY symbol ORDER BY time) AS next_open, lead(close) OVER (PARTITION BY symbol ORDER BY time) AS next_close, lead(close, 5) OVER (PARTITION BY symbol ORDER BY time) AS close5 FROM sparse)
SELECT id, round((actual - estimate) / abs(estimate) * 100, 6) AS surprise_pct, round(next_open / n.close - 1, 6) AS gap, round(next_close / n.close - 1, 6) AS day1, round(close5 / next_close - 1, 6) AS drift5 FROM e JOIN n ON e.symbol = n.symbol AND e.day = n.time WHERE estimate IS NOT NULL""",
    "event_aggregate_weighted": """
SELECT n1.n_name AS actor1, n2.n_name AS actor2, CAST(count(*) AS BIGINT) AS n_events, round(sum(l_quantity), 4) AS articles, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS goldstein, round(avg(l_tax), 6) AS tone
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation n2 ON s_nationkey = n2.n_nationkey GROUP BY 1, 2""",
    "theme_country_counts": "SELECT coalesce(r_name, '_ALL') AS country, event_type AS theme, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS tone FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, event_type), (event_type))",
    "daily_index_calendar": """
WITH d AS (SELECT CAST(ts AS DATE) AS day, avg((value - 50) / 100) AS s, count(*) AS n, avg(CASE WHEN value > 55 THEN 1D WHEN value < 45 THEN 0D END) AS bull FROM events GROUP BY 1), c AS (SELECT CAST(x AS DATE) AS day FROM (SELECT explode(sequence(min(day), max(day), INTERVAL 1 DAY)) AS x FROM d) q)
SELECT CAST(c.day AS STRING) AS day, round(s, 6) AS sentiment, CAST(coalesce(n, 0) AS BIGINT) AS n, round(bull, 6) AS bull_ratio FROM c LEFT JOIN d ON c.day = d.day""",
    "attention_z": """
WITH d AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS time, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2)
SELECT symbol, CAST(time AS STRING) AS time, n, round(CASE WHEN count(n) OVER w >= 10 THEN (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) END, 6) AS z FROM d WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""",
    "dataset_quality": f"""
WITH g AS (SELECT *, datediff(time, lag(time) OVER ({W})) AS gap, abs(close / nullif(lag(close) OVER ({W}), 0) - 1) AS jump FROM sparse)
SELECT symbol, CAST(count(*) AS BIGINT) AS n, CAST(min(time) AS STRING) AS first_bar, CAST(max(time) AS STRING) AS last_bar, CAST(max(gap) AS BIGINT) AS max_gap, CAST(sum(CASE WHEN jump > 0.25D THEN 1 ELSE 0 END) AS BIGINT) AS jumps, CAST(sum(CASE WHEN low > least(open, close) + 1e-9 OR high < greatest(open, close) - 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS inconsistent, CAST(sum(CASE WHEN close <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_positive FROM g GROUP BY symbol""",
    "split_labels": "SELECT symbol, CASE WHEN time < DATE '1999-01-01' THEN 'train' WHEN time < DATE '2000-07-01' THEN 'validation' ELSE 'test' END AS split, CAST(count(*) AS BIGINT) AS n, CAST(min(time) AS STRING) AS first_bar, CAST(max(time) AS STRING) AS last_bar FROM bars GROUP BY 1, 2",
    "last_wins_upsert": """
WITH u AS (SELECT user_id, event_type, value, ts, event_id, 0 AS seq FROM events UNION ALL SELECT user_id, event_type, value + 1000 AS value, ts, event_id, 1 AS seq FROM events WHERE event_id % 3 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) AS rk FROM u) SELECT event_id, user_id, event_type, round(value, 6) AS value FROM k WHERE rk = 1""",
    "crosscheck_sources": """
WITH j AS (SELECT coalesce(b.time, s.time) AS time, b.close AS a, s.close AS c FROM (SELECT * FROM bars WHERE symbol = 'A') b FULL OUTER JOIN (SELECT time, avg(close) AS close FROM sparse GROUP BY time) s ON b.time = s.time)
SELECT CAST(count(*) AS BIGINT) AS days, CAST(sum(CASE WHEN a IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_right, CAST(sum(CASE WHEN c IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_left, round(percentile(abs(a / c - 1) * 10000, 0.5), 4) AS median_bp, round(percentile(abs(a / c - 1) * 10000, 0.95), 4) AS p95_bp FROM j""",
    "entity_prefix_match": """
WITH alias AS (SELECT * FROM (VALUES ('small', 'S', 'person'), ('small ring', 'SR', 'organisation'), ('red', 'R', 'organisation'), ('red widget', 'RW', 'person'), ('hot gear', 'HG', 'organisation'), ('hot gear', 'HP', 'person'), ('blue', 'B', 'organisation'), ('large', 'L', 'organisation')) AS a(name, entity, kind)),
deny AS (SELECT * FROM (VALUES ('blue bolt'), ('large')) AS d(name)),
lead AS (SELECT p_partkey, 1 AS n, split(p_name, ' ')[0] AS prefix FROM part UNION ALL SELECT p_partkey, 2 AS n, p_name AS prefix FROM part WHERE p_name LIKE '% %'),
m AS (SELECT p_partkey, entity, kind, lead.prefix, row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, CASE WHEN kind = 'organisation' THEN 0 ELSE 1 END, entity) AS rk
 FROM lead JOIN alias ON lower(lead.prefix) = alias.name WHERE NOT EXISTS (SELECT 1 FROM deny WHERE deny.name = lower(lead.prefix)))
SELECT p_partkey, entity, kind, prefix FROM m WHERE rk = 1""",
    "last_bar_snapshot": f"""
WITH s AS (SELECT symbol, time, close, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS n, avg(close) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sma50, avg(close) OVER ({W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS sma200, max(high) OVER ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS hi52, min(low) OVER ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS lo52, volume / nullif(avg(volume) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS rvol FROM bars)
SELECT symbol, CAST(time AS STRING) AS time, close, round(sma50, 6) AS sma50, round(sma200, 6) AS sma200, round(close / hi52 - 1, 6) AS off_high, round(close / lo52 - 1, 6) AS off_low, round(rvol, 6) AS rvol, CASE WHEN close > sma50 AND sma50 > sma200 THEN 'up' WHEN close < sma50 AND sma50 < sma200 THEN 'down' ELSE 'mixed' END AS trend FROM s WHERE n = 1""",
}

SQL |= portfolios.SQL
SQL |= chains.chain_sql(CHAIN)
SQL |= studies.SQL
SQL |= reports.SQL
SQL |= {
    "unusual_activity": f"""
WITH {CHAIN}, m AS (SELECT expiry, kind, percentile(volume, 0.5) AS med FROM chain WHERE volume > 0 GROUP BY expiry, kind),
x AS (SELECT chain.*, volume / nullif(oi, 0) AS vol_oi, volume / med AS vol_vs_med, volume * mid * 100 AS premium FROM chain LEFT JOIN m ON m.expiry = chain.expiry AND m.kind = chain.kind),
f AS (SELECT *, coalesce(vol_oi >= 0.05D, false) OR (oi = 0 AND volume >= 5) AS f_oi, coalesce(vol_vs_med >= 1.5D, false) AS f_med, coalesce(round(premium, 2) >= 20000, false) AS f_premium FROM x)
SELECT CAST(expiry AS STRING) AS expiry, kind, strike, volume, oi, round(vol_oi, 6) AS vol_oi, round(vol_vs_med, 6) AS vol_vs_med, round(premium, 2) AS premium, f_oi, f_med, f_premium FROM f WHERE volume >= 5 AND (f_oi OR f_med OR f_premium)""",
    "iv_rank": f"""
WITH r AS (SELECT symbol, time, ln(close / lag(close) OVER ({W})) AS r FROM bars),
v AS (SELECT symbol, time, CASE WHEN count(r) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN round(stddev_samp(r) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252D), 9) END AS vol FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS n FROM v WHERE vol IS NOT NULL), h AS (SELECT * FROM k WHERE n <= 252),
c AS (SELECT symbol, max_by(vol, time) AS now, min(vol) AS lo, max(vol) AS hi, CAST(count(*) AS BIGINT) AS n_obs FROM h GROUP BY symbol)
SELECT h.symbol, n_obs, round(lo, 6) AS vol_min, round(hi, 6) AS vol_max, round((now - lo) / nullif(hi - lo, 0), 5) AS vol_rank, round(avg(CASE WHEN vol < now THEN 1D ELSE 0D END), 6) AS vol_percentile FROM h JOIN c ON c.symbol = h.symbol GROUP BY h.symbol, n_obs, lo, hi, now""",
}

#: Order of the Spark views' making; each is a lazy plan.
TABLES = "region nation customer supplier part orders lineitem events".split()


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name]
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    for t, make in (("bars", daily_bars), ("sparse", sparse_bars), ("hourly", hourly_bars)):
        if re.search(rf"\b{t}\b", text):
            make(spark, sf_dir).createOrReplaceTempView(t)
    return spark.sql(text)


def _oracle(text: str) -> str:
    for ours, theirs in studies.SPELT.items():
        text = text.replace(ours, theirs)
    text = re.sub(r"(?<![\w.])(-?\d+(?:\.\d+)?)D\b", r"CAST(\1 AS DOUBLE)", text).replace("percentile(", "quantile_cont(").replace(" AS STRING)", " AS VARCHAR)").replace("unix_date(", "date_diff('day', DATE '1970-01-01', ")
    text = re.sub(r"datediff\((\w+(?:\.\w+)?), ((?:[^()]|\([^()]*(?:\([^()]*\))?[^()]*\))*?)\) AS", r"date_diff('day', \2, \1) AS", text)
    text = re.sub(r"CAST\(datediff\(f.time, f.seen\) AS BIGINT\)", "date_diff('day', f.seen, f.time)", text)
    text = text.replace("explode(sequence(lo, hi, INTERVAL 1 DAY))", "unnest(generate_series(lo, hi, INTERVAL 1 DAY))").replace("explode(sequence(min(day), max(day), INTERVAL 1 DAY))", "unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))")
    text = text.replace("explode(sequence(0, 49))", "unnest(generate_series(0, 49))").replace("explode(sequence(0, 240))", "unnest(generate_series(0, 240))").replace("explode(sequence(0, 80))", "unnest(generate_series(0, 80))").replace("split(p_name, ' ')[0]", "split_part(p_name, ' ', 1)")
    head = [f"{t} AS ({s})" for t, s in (("bars", DAILY_SQL), ("sparse", SPARSE_SQL), ("hourly", HOURLY_SQL)) if re.search(rf"\b{t}\b", text)]
    if not head:
        return text
    text = text.strip()
    return "WITH " + ",\n".join(head) + (",\n" + text[5:] if text.startswith("WITH ") else "\n" + text)


ORACLE = {name: _oracle(text) for name, text in SQL.items()}
