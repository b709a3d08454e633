"""Option-chain analytics from one normalised chain, as SQL that Spark and the oracle both read.

The chain has for each contract its expiry, kind, strike, open interest,
volume, mid, years to expiry and volatility. The driver's tables carry no
quotes, so years count from a fixed date and the volatility follows a fixed
smile; everything after that is the analytics of a real chain.
"""

from __future__ import annotations

SPOT, RATE = 952.5, 0.04
S, R = f"{SPOT}D", f"{RATE}D"

#: Needs ``chain`` before it. Day 9101 is 30 days before the first expiry.
NORMAL = f"""v AS (
 SELECT *, CAST(unix_date(expiry) - 9101 AS DOUBLE) / 365 AS t, 0.2D + 0.8D * abs(strike / {S} - 1) + CASE WHEN kind = 'P' THEN 0.02D ELSE 0.01D END * sqrt(CAST(unix_date(expiry) - 9101 AS DOUBLE) / 365) AS iv
 FROM chain WHERE strike > 0)"""

#: Volatility at the spot: interpolated between the strikes around it for calls and puts, then averaged; beyond the strikes the nearest one's.
TERM = f"""e AS (
 SELECT expiry, kind, avg(t) AS t,
  max(CASE WHEN strike <= {S} THEN strike END) AS k0, max_by(iv, CASE WHEN strike <= {S} THEN strike END) AS v0,
  min(CASE WHEN strike >= {S} THEN strike END) AS k1, min_by(iv, CASE WHEN strike >= {S} THEN strike END) AS v1
 FROM v GROUP BY expiry, kind),
term AS (
 SELECT expiry, avg(t) AS t, avg(CASE WHEN k0 IS NULL THEN v1 WHEN k1 IS NULL OR k0 = k1 THEN v0 ELSE v0 + (v1 - v0) * ({S} - k0) / (k1 - k0) END) AS atm
 FROM e GROUP BY expiry)"""


def gamma(spot: str) -> str:
    """Black-Scholes gamma of a row of ``v`` at a spot; calls and puts have the same."""
    d1 = f"(ln({spot} / strike) + ({R} + iv * iv / 2) * t) / (iv * sqrt(t))"
    return f"exp(-0.5D * ({d1}) * ({d1})) / 2.5066282746310002D / ({spot} * iv * sqrt(t))"


#: Dealers long calls and short puts, dollars for a move of one percent.
EXPOSURE = "CASE WHEN kind = 'C' THEN 1D ELSE -1D END * oi * 100 * 0.01D"


def chain_sql(chain: str) -> dict[str, str]:
    """Queries by name; ``chain`` is the text of the chain's own table expression."""
    head = f"WITH {chain}, {NORMAL}"
    profile = f"lv AS (SELECT {S} * (0.7D + 0.6D * step / 240) AS level, step FROM (SELECT explode(sequence(0, 240)) AS step) g), p AS (SELECT step, level, sum({EXPOSURE} * level * level * {gamma('level')}) AS gex FROM lv CROSS JOIN (SELECT expiry, kind, strike, t, iv, oi FROM v WHERE oi > 0) c GROUP BY step, level)"
    # for each expiry a condor from the chain: the first put below and call above the spot sold, the second of each bought, at their mids
    legs = f"""rk AS (SELECT expiry, kind, strike, mid, row_number() OVER (PARTITION BY expiry, kind ORDER BY abs(strike - {S})) AS k FROM v WHERE mid IS NOT NULL AND CASE WHEN kind = 'P' THEN strike < {S} ELSE strike > {S} END),
legs AS (SELECT expiry, kind, CASE WHEN k = 1 THEN -1D ELSE 1D END AS side, strike, mid AS paid FROM rk WHERE k <= 2)"""
    at = f"""price AS (SELECT DISTINCT expiry, round({S} * (0.9D + 0.0025D * step), 6) AS settle FROM legs CROSS JOIN (SELECT explode(sequence(0, 80)) AS step) g UNION SELECT expiry, strike AS settle FROM legs)"""
    pay = f"""{legs}, {at}, pay AS (SELECT price.expiry, settle, round(sum(side * (CASE WHEN kind = 'C' THEN greatest(settle - strike, 0D) ELSE greatest(strike - settle, 0D) END - paid)) * 100, 6) AS profit FROM price JOIN legs ON legs.expiry = price.expiry GROUP BY price.expiry, settle)"""
    wing = lambda kind, x: f"""round(CASE WHEN {kind}0 = {kind}1 THEN {kind}v0 ELSE {kind}v0 + ({kind}v1 - {kind}v0) * ({x} - {kind}0) / ({kind}1 - {kind}0) END, 9)"""
    near = lambda kind, x: ", ".join(f"{f}(CASE WHEN kind = '{kind}' AND delta {op} {x} THEN delta END) AS {kind}{j}, {f}_by(iv, CASE WHEN kind = '{kind}' AND delta {op} {x} THEN delta END) AS {kind}v{j}" for j, f, op in ((0, "max", "<="), (1, "min", ">=")))
    return {
        "normalised_chain": f"{head} SELECT CAST(expiry AS STRING) AS expiry, kind, strike, oi, volume, round(mid, 6) AS mid, round(t, 6) AS t, round(iv, 6) AS iv, round(strike / {S}, 6) AS moneyness, round({gamma(S)}, 8) AS gamma FROM v",
        "atm_term_structure": f"{head}, {TERM}, d AS (SELECT *, atm * atm * t - lag(atm * atm * t) OVER (ORDER BY expiry) AS dw, t - lag(t) OVER (ORDER BY expiry) AS dt FROM term) SELECT CAST(expiry AS STRING) AS expiry, round(t, 6) AS t, round(atm, 6) AS atm_iv, round(CASE WHEN dw > 0 THEN sqrt(dw / dt) END, 6) AS fwd_vol FROM d",
        "constant_maturity_iv": f"""{head}, {TERM}, m AS (SELECT days, days / 365D AS x FROM (VALUES (15D), (30D), (60D), (90D), (180D), (365D), (5000D)) AS m(days)),
n AS (SELECT days, x, max(CASE WHEN t <= x THEN t END) AS t0, max_by(atm, CASE WHEN t <= x THEN t END) AS a0, min(CASE WHEN t >= x THEN t END) AS t1, min_by(atm, CASE WHEN t >= x THEN t END) AS a1 FROM m CROSS JOIN term WHERE atm IS NOT NULL GROUP BY days, x)
SELECT days, round(CASE WHEN t0 IS NULL THEN a1 WHEN t1 IS NULL OR t0 = t1 THEN a0 ELSE sqrt((a0 * a0 * t0 + (a1 * a1 * t1 - a0 * a0 * t0) * (x - t0) / (t1 - t0)) / x) END, 6) AS atm_iv FROM n""",
        "expected_move": f"""{head}, {TERM}, s AS (SELECT expiry, strike, sum(mid) AS straddle FROM v WHERE mid IS NOT NULL GROUP BY expiry, strike HAVING count(DISTINCT kind) = 2),
k AS (SELECT *, row_number() OVER (PARTITION BY expiry ORDER BY abs(strike - {S}), strike) AS rk FROM s)
SELECT CAST(k.expiry AS STRING) AS expiry, strike AS atm_strike, round(straddle, 6) AS straddle, round(straddle / {S}, 8) AS move_pct, round({S} - straddle, 6) AS lower_price, round({S} + straddle, 6) AS upper_price, round({S} * atm * sqrt(t), 5) AS iv_1sd FROM k JOIN term ON k.expiry = term.expiry WHERE rk = 1""",
        "gex_by_strike": f"{head}, g AS (SELECT strike, kind, {EXPOSURE} * {S} * {S} * {gamma(S)} AS gex FROM v) SELECT strike, round(sum(CASE WHEN kind = 'C' THEN gex ELSE 0D END), 2) AS call_gex, round(sum(CASE WHEN kind = 'P' THEN gex ELSE 0D END), 2) AS put_gex, round(sum(gex), 2) AS net_gex FROM g GROUP BY strike",
        "gex_profile": f"{head}, {profile} SELECT round(level, 6) AS level, round(gex, 1) AS gex FROM p",
        "zero_gamma_level": f"""{head}, {profile}, n AS (SELECT level, gex, lead(level) OVER (ORDER BY step) AS level1, lead(gex) OVER (ORDER BY step) AS gex1 FROM p),
r AS (SELECT CASE WHEN gex = 0 THEN level ELSE level - gex * (level1 - level) / (gex1 - gex) END AS root FROM n WHERE gex = 0 OR gex * gex1 < 0)
SELECT CAST(count(*) AS BIGINT) AS roots, round(min_by(root, abs(root - {S})), 4) AS flip FROM r""",
        "option_payoff": f"{head}, {pay} SELECT CAST(expiry AS STRING) AS expiry, settle, round(profit, 4) AS profit FROM pay",
        "option_payoff_breakevens": f"""{head}, {pay}, n AS (SELECT expiry, settle, profit, lead(settle) OVER (PARTITION BY expiry ORDER BY settle) AS settle1, lead(profit) OVER (PARTITION BY expiry ORDER BY settle) AS profit1 FROM pay)
SELECT CAST(expiry AS STRING) AS expiry, round(CASE WHEN profit = 0 THEN settle ELSE settle - profit * (settle1 - settle) / (profit1 - profit) END, 4) AS breakeven, CASE WHEN profit1 > profit THEN 'up' ELSE 'down' END AS side FROM n WHERE profit = 0 OR profit * profit1 < 0""",
        "option_structure": f"""{head}, {pay}, c AS (SELECT expiry, sum(side * paid) * 100 AS cost, count(*) AS n FROM legs GROUP BY expiry)
SELECT CAST(c.expiry AS STRING) AS expiry, CAST(max(n) AS BIGINT) AS n_legs, round(max(cost), 4) AS net_premium, round(max(profit), 4) AS max_profit, round(min(profit), 4) AS max_loss FROM c JOIN pay ON pay.expiry = c.expiry GROUP BY c.expiry""",
        "iv_skew": f"""{head}, {TERM}, g AS (SELECT *, (ln({S} / strike) + ({R} + iv * iv / 2) * t) / (iv * sqrt(t)) AS d1 FROM v WHERE t > 0),
n AS (SELECT *, 1 / (1 + 0.2316419D * abs(d1)) AS q FROM g),
c AS (SELECT *, 1 - exp(-0.5D * d1 * d1) / 2.5066282746310002D * q * (0.319381530D + q * (-0.356563782D + q * (1.781477937D + q * (-1.821255978D + q * 1.330274429D)))) AS up FROM n),
k AS (SELECT expiry, kind, iv, round(CASE WHEN d1 >= 0 THEN up ELSE 1 - up END - CASE WHEN kind = 'P' THEN 1 ELSE 0 END, 9) AS delta FROM c),
w AS (SELECT expiry, {near('C', '0.25D')}, {near('P', '-0.25D')} FROM k GROUP BY expiry),
s AS (SELECT w.expiry, atm, {wing('C', '0.25D')} AS iv_c, {wing('P', '-0.25D')} AS iv_p FROM w JOIN term ON term.expiry = w.expiry)
SELECT CAST(expiry AS STRING) AS expiry, round(atm, 6) AS atm_iv, round(iv_c, 6) AS iv_c25, round(iv_p, 6) AS iv_p25, round(iv_c - iv_p, 6) AS rr25, round((iv_c + iv_p) / 2 - atm, 6) AS bf25 FROM s""",
    }
