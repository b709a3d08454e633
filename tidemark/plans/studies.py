"""Event studies, parameter grids, walk-forward choice and data checks, as SQL that Spark and the oracle both read."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY time"

#: Greedy de-clustering of an event's bar numbers: each kept event is at least ten bars after the one kept before. A fold over one symbol's events.
DECLUSTER = "aggregate(array_sort(collect_list(n)), CAST(array() AS array<bigint>), (kept, x) -> CASE WHEN size(kept) = 0 OR x - element_at(kept, -1) >= 10 THEN concat(kept, array(x)) ELSE kept END)"
#: Rows of a group in one order, as text.
DIGEST = "md5(array_join(array_sort(collect_list(line)), ','))"

#: How the oracle's engine spells these.
SPELT = {
    DECLUSTER: "list_reduce(list_sort(list(n)), lambda kept, x: CASE WHEN len(kept) = 0 OR x - kept[-1] >= 10 THEN list_append(kept, x) ELSE kept END, CAST([] AS BIGINT[]))",
    DIGEST: "md5(array_to_string(list_sort(list(line)), ','))",
    "explode(kept)": "unnest(kept)",
}

EVENTS = f"""x AS (SELECT symbol, time, close, CAST(row_number() OVER ({W}) AS BIGINT) AS n, round(avg(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS f, round(avg(close) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS s,
 max(high) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS top, lead(close, 5) OVER ({W}) / close - 1 AS r5, lead(close, 10) OVER ({W}) / close - 1 AS r10, lead(close, 20) OVER ({W}) / close - 1 AS r20 FROM bars),
y AS (SELECT *, lag(f) OVER ({W}) AS f1, lag(s) OVER ({W}) AS s1 FROM x),
ev AS (SELECT symbol, n, 'cross_up' AS event FROM y WHERE n > 50 AND f > s AND f1 <= s1 UNION ALL SELECT symbol, n, 'cross_down' AS event FROM y WHERE n > 50 AND f < s AND f1 >= s1 UNION ALL SELECT symbol, n, 'high_break' AS event FROM y WHERE n > 60 AND close > top),
kept AS (SELECT symbol, event, explode(kept) AS n FROM (SELECT symbol, event, {DECLUSTER} AS kept FROM ev GROUP BY symbol, event) g),
fwd AS (SELECT symbol, n, 5 AS horizon, r5 AS r FROM y UNION ALL SELECT symbol, n, 10, r10 FROM y UNION ALL SELECT symbol, n, 20, r20 FROM y)"""

#: Daily net of a moving-average pair for each pair of the grid, held from the next bar on.
GRID = f"""a AS (SELECT symbol, time, close / lag(close) OVER ({W}) - 1 AS r, """ + ", ".join(f"round(avg(close) OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 6) AS a{k}" for k in (10, 20, 50, 100, 200)) + """ FROM bars),
g AS (SELECT * FROM (VALUES (10, 50), (10, 100), (20, 50), (20, 100), (20, 200), (50, 200)) AS g(fast, slow)),
q AS (SELECT symbol, time, r, fast, slow, CASE WHEN CASE fast WHEN 10 THEN a10 WHEN 20 THEN a20 ELSE a50 END > CASE slow WHEN 50 THEN a50 WHEN 100 THEN a100 ELSE a200 END THEN 1D ELSE 0D END AS side FROM a CROSS JOIN g),
h AS (SELECT time, fast, slow, r * lag(side) OVER (PARTITION BY fast, slow, symbol ORDER BY time) AS net FROM q),
p AS (SELECT fast, slow, time, avg(net) AS net FROM h WHERE net IS NOT NULL GROUP BY fast, slow, time)"""

SHARPE = "avg(net) / nullif(stddev_samp(net), 0) * sqrt(252D)"

SQL = {
    "event_study_declustered": f"""
WITH {EVENTS}, base AS (SELECT symbol, horizon, avg(r) AS base FROM fwd WHERE r IS NOT NULL GROUP BY symbol, horizon)
SELECT event, j.horizon, CAST(count(*) AS BIGINT) AS n, round(avg(r), 6) AS mean, round(avg(CASE WHEN r > 0 THEN 1D ELSE 0D END), 6) AS up_rate, round(avg(r - base), 6) AS edge, round(avg(r) / nullif(stddev_samp(r) / sqrt(CAST(count(*) AS DOUBLE)), 0), 4) AS t
FROM (SELECT kept.symbol, event, horizon, r FROM kept JOIN fwd ON kept.symbol = fwd.symbol AND kept.n = fwd.n WHERE r IS NOT NULL) j JOIN base ON j.symbol = base.symbol AND j.horizon = base.horizon GROUP BY event, j.horizon""",
    "active_events": f"""
WITH {EVENTS}, z AS (SELECT symbol, max(n) AS last FROM y GROUP BY symbol)
SELECT kept.symbol, event, CAST(y.time AS STRING) AS time, CAST(last - kept.n AS BIGINT) AS age FROM kept JOIN z ON kept.symbol = z.symbol JOIN y ON kept.symbol = y.symbol AND kept.n = y.n WHERE last - kept.n <= 60""",
    "sma_sensitivity": f"WITH {GRID} SELECT fast, slow, CAST(count(*) AS BIGINT) AS n, round({SHARPE}, 5) AS sharpe, round(sum(net), 5) AS total, round(avg(CASE WHEN net > 0 THEN 1D ELSE 0D END), 6) AS up_rate FROM p GROUP BY fast, slow",
    "walk_forward": f"""
WITH {GRID}, d AS (SELECT *, CAST(year(time) AS BIGINT) AS y FROM p),
own AS (SELECT fast, slow, y, {SHARPE} AS sharpe, sum(net) AS total FROM d GROUP BY fast, slow, y),
past AS (SELECT fast, slow, t.y, {SHARPE} AS sharpe FROM (SELECT DISTINCT y FROM d) t JOIN d ON d.y BETWEEN t.y - 2 AND t.y - 1 GROUP BY fast, slow, t.y HAVING count(DISTINCT d.y) = 2),
best AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY round(sharpe, 9) DESC, fast, slow) AS rk FROM past)
SELECT best.y AS test_year, best.fast, best.slow, round(best.sharpe, 5) AS train_sharpe, round(own.sharpe, 5) AS test_sharpe, round(own.total, 6) AS test_total FROM best JOIN own ON best.fast = own.fast AND best.slow = own.slow AND best.y = own.y WHERE rk = 1""",
    "split_stats": f"""
WITH {GRID}, s AS (SELECT *, CASE WHEN time < DATE '1999-01-01' THEN 'train' WHEN time < DATE '2000-07-01' THEN 'validation' ELSE 'test' END AS split FROM p WHERE fast = 20 AND slow = 100)
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(min(time) AS STRING) AS first_bar, CAST(max(time) AS STRING) AS last_bar, round({SHARPE}, 5) AS sharpe, round(sum(net), 6) AS total FROM s GROUP BY split""",
    "newey_west_mean": f"""
WITH r AS (SELECT symbol, time, ln(close / lag(close) OVER ({W})) AS r FROM bars), m AS (SELECT symbol, avg(r) AS m, CAST(count(r) AS DOUBLE) AS n FROM r GROUP BY symbol),
e AS (SELECT r.symbol, time, r - m AS e, m, n FROM r JOIN m ON r.symbol = m.symbol WHERE r IS NOT NULL),
l AS (SELECT *, """ + ", ".join(f"lag(e, {k}) OVER ({W}) AS e{k}" for k in range(1, 6)) + """ FROM e),
v AS (SELECT symbol, max(m) AS m, max(n) AS n, sum(e * e) / max(n) AS g0, """ + ", ".join(f"sum(e * e{k}) / max(n) AS g{k}" for k in range(1, 6)) + """ FROM l GROUP BY symbol),
w AS (SELECT symbol, m, n, g0 + 2 * (""" + " + ".join(f"g{k} * {1 - k / 6!r}D" for k in range(1, 6)) + """) AS lrv FROM v)
SELECT symbol, CAST(n AS BIGINT) AS n, round(m, 8) AS mean, round(sqrt(greatest(lrv, 0D) / n), 8) AS se, round(m / nullif(sqrt(greatest(lrv, 0D) / n), 0), 5) AS t FROM w""",
    "month_day_numbers": """
WITH d AS (SELECT symbol, time, row_number() OVER (PARTITION BY symbol, year(time), month(time) ORDER BY time) AS k, row_number() OVER (PARTITION BY symbol, year(time), month(time) ORDER BY time DESC) AS b FROM sparse)
SELECT symbol, CAST(time AS STRING) AS time, CAST(k AS BIGINT) AS day_of_month, CAST(b AS BIGINT) AS days_left, k = 1 AS is_first, b = 1 AS is_last, k <= 3 OR b = 1 AS turn_of_month FROM d""",
    "large_moves": f"""
WITH r AS (SELECT symbol, time, close, close / lag(close) OVER ({W}) - 1 AS r FROM bars), s AS (SELECT *, CASE WHEN count(r) OVER w60 = 60 THEN r / nullif(stddev_samp(r) OVER w60, 0) END AS z FROM r WINDOW w60 AS ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT symbol, CAST(time AS STRING) AS time, round(r, 8) AS r, round(z, 5) AS z, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS side FROM s WHERE abs(round(z, 5)) >= 2""",
    "sentiment_price_lags": f"""
WITH s AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, avg((value - 50) / 100) AS mood FROM events GROUP BY 1, 2), c AS (SELECT symbol, CAST(time AS DATE) AS day, max_by(close, time) AS close FROM hourly GROUP BY 1, 2),
r AS (SELECT symbol, day, close - lag(close) OVER (PARTITION BY symbol ORDER BY day) AS move FROM c), k AS (SELECT * FROM (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) AS k(shift))
SELECT s.symbol, shift, CAST(count(move) AS BIGINT) AS n, round(corr(mood, move), 5) AS corr FROM s CROSS JOIN k JOIN r ON s.symbol = r.symbol AND unix_date(r.day) = unix_date(s.day) + shift WHERE move IS NOT NULL GROUP BY s.symbol, shift""",
    "dataset_manifest": f"""
WITH l AS (SELECT symbol, CAST(year(time) AS BIGINT) AS y, time, concat(CAST(CAST(time AS DATE) AS STRING), ':', CAST(CAST(round(close * 100) AS BIGINT) AS STRING)) AS line FROM bars)
SELECT symbol, y, CAST(count(*) AS BIGINT) AS n, CAST(min(time) AS STRING) AS first_bar, CAST(max(time) AS STRING) AS last_bar, {DIGEST} AS digest FROM l GROUP BY symbol, y""",
    "sealed_test_split": """
WITH b AS (SELECT symbol, time, close, CASE WHEN time < DATE '1999-01-01' THEN 'train' WHEN time < DATE '2000-07-01' THEN 'validation' ELSE 'test' END AS split FROM bars)
SELECT symbol, CAST(time AS STRING) AS time, split, CASE WHEN split <> 'test' THEN close END AS close FROM b""",
    "rolling_beta": f"""
WITH r AS (SELECT symbol, time, close / lag(close) OVER ({W}) - 1 AS r FROM bars), m AS (SELECT time, avg(r) AS m FROM r WHERE r IS NOT NULL GROUP BY time), j AS (SELECT symbol, r.time, r, m FROM r JOIN m ON r.time = m.time WHERE r IS NOT NULL)
SELECT symbol, CAST(time AS STRING) AS time, round(CASE WHEN count(*) OVER w120 = 120 THEN covar_samp(r, m) OVER w120 / nullif(var_samp(m) OVER w120, 0) END, 5) AS beta FROM j WINDOW w120 AS ({W} ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)""",
    "portfolio_vol_target": f"""
WITH r AS (SELECT symbol, time, close / lag(close) OVER ({W}) - 1 AS r FROM bars), p AS (SELECT time, avg(r) AS r FROM r WHERE r IS NOT NULL GROUP BY time),
v AS (SELECT time, r, CASE WHEN count(*) OVER w60 = 60 THEN stddev_samp(r) OVER w60 * sqrt(252D) END AS vol FROM p WINDOW w60 AS (ORDER BY time ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT CAST(time AS STRING) AS time, round(vol, 7) AS vol, round(coalesce(least(2D, 0.1D / nullif(vol, 0)), 1D), 6) AS scale, round(r * coalesce(least(2D, 0.1D / nullif(vol, 0)), 1D), 8) AS net FROM v""",
    # calendar dates (orders in part shipped) to the sessions whose move they may explain: the first on or after, and the next
    "trading_day_flags": """
WITH s AS (SELECT symbol, CAST(time AS DATE) AS d, CAST(row_number() OVER (PARTITION BY symbol ORDER BY time) AS BIGINT) AS k FROM sparse WHERE (unix_date(CAST(time AS DATE)) + 3) % 7 < 5),
f0 AS (SELECT DISTINCT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'P'),
u AS (SELECT symbol, d, k, 0 AS dated FROM s UNION ALL SELECT symbol, d, CAST(NULL AS BIGINT) AS k, 1 AS dated FROM f0),
f AS (SELECT symbol, dated, min(k) OVER (PARTITION BY symbol ORDER BY d RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM u),
h AS (SELECT DISTINCT symbol, f.k + spill AS k FROM f CROSS JOIN (VALUES (0), (1)) AS p(spill) WHERE dated = 1 AND f.k IS NOT NULL)
SELECT s.symbol, CAST(s.d AS STRING) AS time, h.k IS NOT NULL AS flag FROM s LEFT JOIN h ON h.symbol = s.symbol AND h.k = s.k""",
    # markets of weekly positions, made of flags and part types: where each one's index stands on its last week
    "scan_extremes": """
WITH cot AS (SELECT concat(l_returnflag, ' ', p_type) AS market, CAST(date_trunc('week', l_shipdate) AS DATE) AS time, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) - sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS net, sum(l_quantity) AS oi
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
x AS (SELECT *, net - lag(net) OVER (PARTITION BY market ORDER BY time) AS change, row_number() OVER (PARTITION BY market ORDER BY time DESC) AS last FROM cot),
w AS (SELECT * FROM x WHERE last <= 156),
m AS (SELECT market, count(net) AS n, min(net) AS lo, max(net) AS hi, avg(net) AS mu, stddev_samp(net) AS sd FROM w GROUP BY market),
r AS (SELECT w.market, time, net, change, 100 * net / nullif(oi, 0) AS pct_oi, round(CASE WHEN n >= 26 THEN 100 * (net - lo) / nullif(hi - lo, 0) END, 6) AS idx, CASE WHEN n >= 26 THEN (net - mu) / nullif(sd, 0) END AS z FROM w JOIN m ON m.market = w.market WHERE last = 1)
SELECT market, CAST(time AS STRING) AS time, net AS spec_net, change AS spec_wk_chg, round(pct_oi, 6) AS spec_pct_oi, idx AS spec_index, round(z, 6) AS spec_z, CASE WHEN idx > 90 THEN 'extreme long' WHEN idx < 10 THEN 'extreme short' ELSE '' END AS flag FROM r""",
    # days on which a symbol draws far more attention than before, signed by tone against its own past, led by fresh or stale items
    "attention_events": """
WITH d AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n, round(avg(value / 100 - 1), 9) AS tone, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS DOUBLE) AS fresh FROM events GROUP BY 1, 2),
p AS (SELECT symbol, CAST(time AS DATE) AS day, min_by(open, time) AS o, max_by(close, time) AS c FROM hourly GROUP BY 1, 2), m AS (SELECT day, avg(o) AS mo, avg(c) AS mc FROM p GROUP BY day),
q AS (SELECT p.symbol, p.day, o, c, mo, mc FROM p JOIN m ON m.day = p.day),
f AS (SELECT symbol, day, """ + ", ".join(f"lead(c, {h}) OVER (PARTITION BY symbol ORDER BY day) / lead(o) OVER (PARTITION BY symbol ORDER BY day) - lead(mc, {h}) OVER (PARTITION BY symbol ORDER BY day) / lead(mo) OVER (PARTITION BY symbol ORDER BY day) AS car{h}" for h in (1, 5)) + """ FROM q),
b AS (SELECT *, fresh / n AS share, count(*) OVER w10 AS k, avg(n) OVER w10 AS base, stddev_samp(n) OVER w10 AS sd, avg(tone) OVER w10 AS was, percentile(fresh / n, 0.5) OVER w10 AS share_base FROM d WINDOW w10 AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CASE WHEN tone > round(was, 9) THEN 1D WHEN tone < round(was, 9) THEN -1D ELSE 0D END AS dir FROM b WHERE k >= 5 AND n > round(base + sd, 6) AND n >= 20)
SELECT h.symbol, CAST(h.day AS STRING) AS day, CAST(n AS BIGINT) AS n, dir, round(share, 6) AS fresh_share, round(share, 9) > round(share_base, 9) AS fresh_led, round(dir * car1 - 0.001D, 6) AS car1, round(dir * car5 - 0.001D, 6) AS car5 FROM h JOIN f ON f.symbol = h.symbol AND f.day = h.day WHERE dir <> 0""",
}
