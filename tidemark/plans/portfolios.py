"""Calendar effects, monthly portfolios and sizing, as SQL texts for the queries in ``analytics``."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY time"
SO_FAR = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def next_business_day(day: str) -> str:
    """The Monday to Friday after a date; day 0 was a Thursday."""
    return f"{day} + CAST(CASE (unix_date({day}) + 3) % 7 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS INT)"


def weekdays_before(day: str) -> str:
    """Mondays to Fridays from a fixed Monday up to, not including, the date."""
    n = f"(unix_date({day}) + 3)"
    return f"(5 * floor({n} / 7) + least({n} % 7, 5))"


#: Every symbol at every time of any symbol, with its last close; month_end if the next business day is in another month.
PANEL = f"""times AS (SELECT time, month({next_business_day('time')}) <> month(time) AS month_end FROM bars GROUP BY time), names AS (SELECT DISTINCT symbol FROM bars),
grid AS (SELECT names.symbol, times.time, month_end FROM names CROSS JOIN times),
held AS (SELECT grid.symbol, grid.time, month_end, max_by(close, CASE WHEN close IS NOT NULL THEN grid.time END) OVER (PARTITION BY grid.symbol ORDER BY grid.time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
 FROM grid LEFT JOIN bars ON bars.symbol = grid.symbol AND bars.time = grid.time)"""


def monthly(source: str) -> str:
    """The month ends' weights, held until the next."""
    return f"SELECT symbol, CAST(time AS STRING) AS time, coalesce(max_by(w, CASE WHEN month_end THEN time END) OVER {SO_FAR}, 0D) AS weight FROM {source}"


SQL: dict[str, str] = {
    "turn_of_month": f"""
WITH n AS (SELECT symbol, time, {next_business_day('time')} AS nx FROM bars),
k AS (SELECT symbol, time, {weekdays_before('nx')} - {weekdays_before("CAST(date_trunc('month', nx) AS DATE)")} AS from_start, {weekdays_before('last_day(nx) + 1')} - 1 - {weekdays_before('nx')} AS to_end FROM n)
SELECT symbol, CAST(time AS STRING) AS time, CASE WHEN to_end < 1 OR from_start < 3 THEN 1D ELSE 0D END AS position FROM k""",
    "xs_momentum_monthly": f"""
WITH {PANEL}, m AS (SELECT *, lag(close, 21) OVER ({W}) / lag(close, 252) OVER ({W}) - 1 AS mom FROM held),
r AS (SELECT *, rank() OVER (PARTITION BY time ORDER BY mom DESC NULLS LAST) + (count(*) OVER (PARTITION BY time, mom) - 1) / 2 AS rk, count(mom) OVER (PARTITION BY time) AS valid FROM m),
x AS (SELECT symbol, time, month_end, CASE WHEN mom IS NOT NULL AND valid >= 2 AND rk <= 2 THEN 0.5D ELSE 0D END AS w FROM r)
{monthly('x')}""",
    "dual_momentum": f"""
WITH {PANEL}, m AS (SELECT held.*, close / lag(close, 252) OVER ({W}) - 1 AS mom, safe FROM held CROSS JOIN (SELECT max(symbol) AS safe FROM names) s),
b AS (SELECT time, max(CASE WHEN symbol <> safe THEN mom END) AS best_r, min(CASE WHEN symbol = safe THEN greatest(coalesce(mom, 0D), 0D) END) AS hurdle FROM m GROUP BY time),
f AS (SELECT b.time, best_r, hurdle, min(CASE WHEN symbol <> safe AND mom = best_r THEN symbol END) AS best FROM b JOIN m ON m.time = b.time GROUP BY b.time, best_r, hurdle),
x AS (SELECT m.symbol, m.time, month_end, CASE WHEN best_r IS NULL THEN 0D WHEN m.symbol = CASE WHEN best_r > hurdle THEN best ELSE safe END THEN 1D ELSE 0D END AS w FROM m JOIN f ON m.time = f.time)
{monthly('x')}""",
    "vol_target_filter": f"""
WITH r AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, CASE WHEN count(close) OVER ({W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) = 200 THEN avg(close) OVER ({W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS s200 FROM bars),
v AS (SELECT *, CASE WHEN count(r) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN stddev_samp(r) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END * sqrt(252D) AS vol FROM r)
SELECT symbol, CAST(time AS STRING) AS time, round(least(0.15D / nullif(vol, 0), 2D), 6) AS scalar, CASE WHEN close > s200 THEN 1D ELSE 0D END AS long_ok, CASE WHEN close < s200 THEN 1D ELSE 0D END AS short_ok FROM v""",
    "expectancy": f"""
WITH r AS (SELECT symbol, (lead(close, 10) OVER ({W}) / close - 1) / 0.02D AS r FROM bars),
a AS (SELECT symbol, CAST(count(r) AS BIGINT) AS n, avg(CASE WHEN r > 0 THEN 1D WHEN r <= 0 THEN 0D END) AS win_rate, avg(CASE WHEN r > 0 THEN r END) AS win, avg(CASE WHEN r <= 0 THEN r END) AS loss, avg(r) AS mean FROM r GROUP BY symbol)
SELECT symbol, n, round(win_rate, 6) AS win_rate, round(coalesce(win, 0D), 6) AS avg_win_r, round(coalesce(loss, 0D), 6) AS avg_loss_r, round(mean, 6) AS expectancy_r, round(win / abs(nullif(loss, 0)), 6) AS payoff,
 round(coalesce(greatest(0D, win_rate - (1 - win_rate) / nullif(win / abs(nullif(loss, 0)), 0)) * 0.25D, 0D), 6) AS quarter_kelly FROM a""",
}
