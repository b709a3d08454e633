"""Indicator plans over daily bars: trend, momentum, volatility, volume, levels, candles."""

from __future__ import annotations

from tidemark.functions.expressions import KEY, cum, frame, lag, lead, over, roll, sma, wma, xdn, xup
from tidemark.plans.staged import Plan

TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
TP = "(high + low + close) / 3"
#: Typical price times volume in thirds of a cent, whole numbers, so that sums do not depend on their order.
CENTS = "CAST(round((high + low + close) * 100) AS BIGINT) * CAST(volume AS BIGINT)"
UP = "greatest(close - c1, 0D)"
DOWN = "greatest(c1 - close, 0D)"


def span(n: int) -> float:
    return 2 / (n + 1)


def mad(x: str, n: int, mean: str = "") -> str:
    """Sum of absolute deviations of the window's values from its own mean, or from a column that holds that."""
    mean = mean or f"avg({x}) OVER {frame(1 - n, 0)}"
    return " + ".join(f"abs({x if not k else lag(x, k)} - ({mean}))" for k in range(n))


def fast_k(n: int) -> str:
    lo, hi = roll("min", "low", n), roll("max", "high", n)
    return f"100 * (close - {lo}) / nullif({hi} - {lo}, 0)"


PLANS: dict[str, Plan] = {
    "sma_bollinger": Plan(
        ["mid", "upper", "lower", "pctb", "width", "q20"],
        [{"mid": sma("close", 20), "sd": roll("stddev_samp", "close", 20), "q20": roll("percentile({x}, 0.2)", "close", 20)}, {"upper": "mid + 2 * sd", "lower": "mid - 2 * sd"}, {"pctb": "(close - lower) / nullif(upper - lower, 0)", "width": "(upper - lower) / nullif(mid, 0)"}],
    ),
    "wma_hma": Plan(["wma20", "hma20"], [{"wma20": wma("close", 20), "half": wma("close", 10)}, {"raw": "2 * half - wma20"}, {"hma20": wma("raw", 4)}]),
    "envelopes": Plan(["mid", "upper", "lower"], [{"mid": sma("close", 20)}, {"upper": "mid * 1.025D", "lower": "mid * 0.975D"}], digits=7),
    "donchian": Plan(["upper", "lower", "mid"], [{"upper": roll("max", "high", 20), "lower": roll("min", "low", 20)}, {"mid": "(upper + lower) / 2"}]),
    "donchian_prior_break": Plan(["up", "down"], [{"hi": over("max", "high", -55, -1), "lo": over("min", "low", -55, -1)}, {"up": "coalesce(close > hi, false)", "down": "coalesce(close < lo, false)"}], flags=True),
    "ichimoku": Plan(
        ["tenkan", "kijun", "span_a", "span_b", "chikou"],
        [
            {f"m{n}": f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2" for n in (9, 26, 52)},
            {"tenkan": "m9", "kijun": "m26", "span_a": f"({lag('m9', 26)} + {lag('m26', 26)}) / 2", "span_b": lag("m52", 26), "chikou": lead("close", 26)},
        ],
    ),
    "true_range": Plan(["tr"], [{"tr": TR}]),
    "roc_momentum": Plan(["roc10", "roc21", "log_ret", "drawdown", "z60"], [{"roc10": f"close / {lag('close', 10)} - 1", "roc21": f"close / {lag('close', 21)} - 1", "log_ret": f"ln(close / {lag('close')})", "drawdown": f"close / {cum('max', 'close')} - 1", "z60": f"(close - {sma('close', 60)}) / nullif({roll('stddev_samp', 'close', 60)}, 0)"}]),
    "stochastic": Plan(["k", "d", "willr"], [{"k": fast_k(14)}, {"d": sma("k", 3), "willr": "k - 100"}]),
    "cci": Plan(["cci"], [{"tp": TP}, {"cci": f"(tp - {sma('tp', 20)}) / nullif(0.015D * (({mad('tp', 20)}) / 20), 0)"}]),
    "cmo": Plan(["cmo"], [{"c1": lag("close")}, {"u": f"CASE WHEN c1 IS NOT NULL THEN {UP} END", "d": f"CASE WHEN c1 IS NOT NULL THEN {DOWN} END"}, {"su": roll("sum", "u", 14), "sd": roll("sum", "d", 14)}, {"cmo": "100 * (su - sd) / nullif(su + sd, 0)"}]),
    "dpo": Plan(["dpo"], [{"dpo": f"{lag('close', 11)} - {sma('close', 20)}"}]),
    "balance_of_power": Plan(["bop"], [{"bop": "(close - open) / nullif(high - low, 0)"}]),
    "coppock": Plan(["coppock"], [{"r": f"100 * (close / {lag('close', 14)} - 1) + 100 * (close / {lag('close', 11)} - 1)"}, {"coppock": wma("r", 10)}]),
    "kst": Plan(
        ["kst", "signal"],
        [{f"r{n}": f"100 * (close / {lag('close', n)} - 1)" for n in (10, 15, 20, 30)}, {"kst": f"{sma('r10', 10)} + 2 * {sma('r15', 10)} + 3 * {sma('r20', 10)} + 4 * {sma('r30', 15)}"}, {"signal": sma("kst", 9)}],
    ),
    "ultimate_oscillator": Plan(
        ["uo"],
        [
            {"c1": lag("close")},
            {"bp": "CASE WHEN c1 IS NOT NULL THEN close - least(low, c1) END", "tr": "CASE WHEN c1 IS NOT NULL THEN greatest(high, c1) - least(low, c1) END"},
            {f"a{n}": f"{roll('sum', 'bp', n)} / nullif({roll('sum', 'tr', n)}, 0)" for n in (7, 14, 28)},
            {"uo": "100 * (4 * a7 + 2 * a14 + a28) / 7"},
        ],
    ),
    "aroon": Plan(
        ["up", "down", "osc"],
        [
            {"n": f"row_number() OVER ({KEY})"},
            {"hi": roll("max", "high", 26), "lo": roll("min", "low", 26)},
            {"since_hi": "CASE WHEN hi IS NOT NULL THEN CASE " + " ".join(f"WHEN {lag('high', k) if k else 'high'} = hi THEN {k}" for k in range(26)) + " END END", "since_lo": "CASE WHEN lo IS NOT NULL THEN CASE " + " ".join(f"WHEN {lag('low', k) if k else 'low'} = lo THEN {k}" for k in range(26)) + " END END"},
            {"up": "100 * (25 - since_hi) / 25D", "down": "100 * (25 - since_lo) / 25D"},
            {"osc": "up - down"},
        ],
    ),
    "obv": Plan(["obv", "pvt"], [{"dv": f"coalesce(sign(close - {lag('close')}) * volume, 0D)", "rv": f"coalesce((close / {lag('close')} - 1) * volume, 0D)"}, {"obv": cum("sum", "dv"), "pvt": cum("sum", "rv")}], digits=4),
    "mfi": Plan(["mfi"], [{"tp": TP}, {"t1": lag("tp")}, {"pos": "CASE WHEN tp > t1 THEN tp * volume ELSE 0D END", "neg": "CASE WHEN tp < t1 THEN tp * volume ELSE 0D END"}, {"sp": roll("sum", "pos", 14), "sn": roll("sum", "neg", 14)}, {"mfi": "CASE WHEN sn IS NOT NULL THEN CASE WHEN sn = 0 THEN CASE WHEN sp > 0 THEN 100D END ELSE 100 - 100 / (1 + sp / sn) END END"}]),
    "ad_line": Plan(["ad", "cmf"], [{"mf": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0D) * volume"}, {"ad": cum("sum", "mf"), "cmf": f"{roll('sum', 'mf', 20)} / nullif({roll('sum', 'volume', 20)}, 0)"}], digits=4),
    "ease_of_movement": Plan(["eom"], [{"e": f"((high + low) / 2 - ({lag('high')} + {lag('low')}) / 2) * (high - low) * 1000000D / nullif(volume, 0)"}, {"eom": sma("e", 14)}], digits=0),
    "vwap_month": Plan(["vwap"], [{"pv": CENTS, "m": "date_trunc('month', time)"}, {"vwap": "sum(pv) OVER (PARTITION BY symbol, m ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nullif(300D * sum(volume) OVER (PARTITION BY symbol, m ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"}]),
    "anchored_vwap": Plan(["avwap"], [{"pv": f"CASE WHEN time >= DATE '1998-01-01' THEN {CENTS} END", "v": "CASE WHEN time >= DATE '1998-01-01' THEN volume END"}, {"avwap": f"{cum('sum', 'pv')} / nullif(300D * {cum('sum', 'v')}, 0)"}]),
    "ulcer_index": Plan(["ulcer"], [{"dd": f"100 * (close / {roll('max', 'close', 14)} - 1)"}, {"dd2": "dd * dd"}, {"ulcer": f"sqrt({sma('dd2', 14)})"}]),
    "vortex": Plan(["plus", "minus"], [{"tr": f"CASE WHEN {lag('close')} IS NOT NULL THEN {TR} END", "p": f"abs(high - {lag('low')})", "m": f"abs(low - {lag('high')})"}, {"plus": f"{roll('sum', 'p', 14)} / nullif({roll('sum', 'tr', 14)}, 0)", "minus": f"{roll('sum', 'm', 14)} / nullif({roll('sum', 'tr', 14)}, 0)"}]),
    "choppiness": Plan(["chop"], [{"tr": TR}, {"rng": f"{roll('max', 'high', 14)} - {roll('min', 'low', 14)}", "s": roll("sum", "tr", 14)}, {"chop": "CASE WHEN rng > 0 AND s > 0 THEN 100 * log10(s / rng) / log10(14D) END"}]),
    "hist_vol_4": Plan(
        ["hv_close", "hv_parkinson", "hv_garman_klass", "hv_yang_zhang"],
        [
            {"r": f"ln(close / {lag('close')})", "hl2": "ln(high / low) * ln(high / low)", "co": "ln(close / open)", "oc": f"ln(open / {lag('close')})", "rs": "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"},
            {"gk": "0.5D * hl2 - (2 * ln(2D) - 1) * co * co"},
            {"hv_close": f"{roll('stddev_samp', 'r', 20)} * sqrt(252D)", "hv_parkinson": f"sqrt({sma('hl2', 20)} / (4 * ln(2D)) * 252)", "g": sma("gk", 20), "vo": roll("var_samp", "oc", 20), "vc": roll("var_samp", "co", 20), "vr": sma("rs", 20)},
            {"hv_garman_klass": "CASE WHEN g >= 0 THEN sqrt(g * 252) END", "yz": f"vo + {0.34 / (1.34 + 21 / 19)!r}D * vc + {1 - 0.34 / (1.34 + 21 / 19)!r}D * vr"},
            {"hv_yang_zhang": "CASE WHEN yz >= 0 THEN sqrt(yz * 252) END"},
        ],
    ),
    "linreg_channel": Plan(
        ["mid", "slope", "r2", "upper", "lower"],
        [
            {"n": f"CAST(row_number() OVER ({KEY}) AS DOUBLE)"},
            {"slope": roll("regr_slope({x}, n)", "close", 50), "icept": roll("regr_intercept({x}, n)", "close", 50), "r2": roll("regr_r2({x}, n)", "close", 50), "sd": roll("stddev_pop", "close", 50)},
            {"mid": "icept + slope * n", "w": "2 * sd * sqrt(greatest(1 - r2, 0D))"},
            {"upper": "mid + w", "lower": "mid - w"},
        ],
        digits=5,
    ),
    "swing_points": Plan(["swing_high", "swing_low"], [{"hh": over("max", "high", -5, 5), "ll": over("min", "low", -5, 5)}, {"swing_high": "CASE WHEN high = hh THEN high END", "swing_low": "CASE WHEN low = ll THEN low END"}]),
    "regime": Plan(["trend", "vol_pct"], [{"s50": sma("close", 50), "s200": sma("close", 200), "r": f"close / {lag('close')} - 1"}, {"rv": roll("stddev_samp", "r", 20)}, {"trend": "CASE WHEN s200 IS NULL THEN NULL WHEN close > s50 AND s50 > s200 THEN 1 WHEN close < s50 AND s50 < s200 THEN -1 ELSE 0 END", "vol_pct": f"rv / nullif({cum('max', 'rv')}, 0)"}]),
    "bar_patterns": Plan(
        ["high_52w_breakout", "low_52w_breakdown", "inside_bar", "outside_bar", "nr4", "nr7", "gap_up", "gap_down"],
        [
            {"h1": lag("high"), "l1": lag("low"), "rng": "high - low", "hi": over("max", "high", -252, -1), "lo": over("min", "low", -252, -1)},
            {
                "high_52w_breakout": "coalesce(close > hi, false)", "low_52w_breakdown": "coalesce(close < lo, false)", "inside_bar": "coalesce(high < h1 AND low > l1, false)", "outside_bar": "coalesce(high > h1 AND low < l1, false)",
                "nr4": f"coalesce(rng <= {roll('min', 'rng', 4)}, false)", "nr7": f"coalesce(rng <= {roll('min', 'rng', 7)}, false)", "gap_up": "coalesce(low > h1, false)", "gap_down": "coalesce(high < l1, false)",
            },
        ],
        flags=True,
    ),
    # exponential averages
    "ema_family": Plan(
        ["ema20", "dema20", "tema20", "zlema20"],
        [{"lead_price": f"close + (close - {lag('close', 9)})"}, {"dema20": "2 * ema20 - e2", "tema20": "3 * ema20 - 3 * e2 + e3"}],
        {0: {"ema20": ("close", span(20), 20), "e2": ("ema20", span(20), 20), "e3": ("e2", span(20), 20), "zlema20": ("lead_price", span(20), 20)}},
        digits=4,
    ),
    "macd": Plan(["macd", "signal", "hist"], [{"x": "close"}, {"macd": "fast - slow"}, {"hist": "macd - signal"}], {0: {"fast": ("close", span(12), 12), "slow": ("close", span(26), 26)}, 1: {"signal": ("macd", span(9), 0)}}, digits=4),
    "rsi": Plan(["rsi"], [{"c1": lag("close")}, {"u": f"CASE WHEN c1 IS NOT NULL THEN {UP} END", "d": f"CASE WHEN c1 IS NOT NULL THEN {DOWN} END"}, {"rsi": "CASE WHEN ed = 0 THEN 100D ELSE 100 - 100 / (1 + eu / ed) END"}], {1: {"eu": ("u", 1 / 14, 14), "ed": ("d", 1 / 14, 14)}}),
    "stoch_rsi": Plan(["k", "d"], [{"c1": lag("close")}, {"u": f"CASE WHEN c1 IS NOT NULL THEN {UP} END", "dn": f"CASE WHEN c1 IS NOT NULL THEN {DOWN} END"}, {"rsi": "CASE WHEN ed = 0 THEN 100D ELSE 100 - 100 / (1 + eu / ed) END"}, {"lo": roll("min", "rsi", 14), "hi": roll("max", "rsi", 14)}, {"raw": "100 * (rsi - lo) / nullif(hi - lo, 0)"}, {"k": sma("raw", 3)}, {"d": sma("k", 3)}], {1: {"eu": ("u", 1 / 14, 14), "ed": ("dn", 1 / 14, 14)}}),
    "atr_keltner": Plan(["atr14", "mid", "upper", "lower"], [{"tr": TR}, {"upper": "mid + 2 * atr20", "lower": "mid - 2 * atr20"}], {0: {"atr14": ("tr", 1 / 14, 14), "atr20": ("tr", 1 / 20, 20), "mid": ("close", span(20), 20)}}, digits=4),
    "adx": Plan(
        ["plus_di", "minus_di", "adx"],
        [
            {"up": f"high - {lag('high')}", "dn": f"{lag('low')} - low", "tr": TR},
            {"pdm": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0D END", "mdm": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0D END"},
            {"plus_di": "100 * ep / nullif(et, 0)", "minus_di": "100 * em / nullif(et, 0)"},
            {"dx": "100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)"},
        ],
        {1: {"ep": ("pdm", 1 / 14, 14), "em": ("mdm", 1 / 14, 14), "et": ("tr", 1 / 14, 14)}, 3: {"adx": ("dx", 1 / 14, 14)}},
    ),
    "elder_ray": Plan(["bull", "bear"], [{"x": "close"}, {"bull": "high - e", "bear": "low - e"}], {0: {"e": ("close", span(13), 13)}}),
    "ppo_pvo": Plan(
        ["ppo", "ppo_signal", "pvo", "pvo_signal"],
        [{"x": "close"}, {"ppo": "100 * (pf - ps) / nullif(ps, 0)", "pvo": "100 * (vf - vs) / nullif(vs, 0)"}],
        {0: {"pf": ("close", span(12), 12), "ps": ("close", span(26), 26), "vf": ("volume", span(12), 12), "vs": ("volume", span(26), 26)}, 1: {"ppo_signal": ("ppo", span(9), 9), "pvo_signal": ("pvo", span(9), 9)}},
    ),
    "trix": Plan(["trix", "signal"], [{"x": "close"}, {"trix": f"100 * (e3 / {lag('e3')} - 1)"}], {0: {"e1": ("close", span(15), 15), "e2": ("e1", span(15), 15), "e3": ("e2", span(15), 15)}, 1: {"signal": ("trix", span(9), 9)}}),
    "tsi": Plan(
        ["tsi", "signal"],
        [{"m": f"close - {lag('close')}"}, {"am": "abs(m)"}, {"tsi": "100 * m2 / nullif(a2, 0)"}],
        {1: {"m1": ("m", span(25), 25), "m2": ("m1", span(13), 13), "a1": ("am", span(25), 25), "a2": ("a1", span(13), 13)}, 2: {"signal": ("tsi", span(7), 7)}},
    ),
    "chaikin_osc": Plan(["chaikin"], [{"mf": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0D) * volume"}, {"ad": cum("sum", "mf")}, {"chaikin": "f - s"}], {1: {"f": ("ad", span(3), 3), "s": ("ad", span(10), 10)}}, digits=4),
    "force_index": Plan(["force"], [{"fv": f"(close - {lag('close')}) * volume"}], {0: {"force": ("fv", span(13), 13)}}, digits=3),
    "nvi_pvi": Plan(
        ["ln_nvi", "ln_pvi"],
        [{"r": f"close / {lag('close')} - 1", "dv": f"volume - {lag('volume')}"}, {"nf": "CASE WHEN dv < 0 THEN 1 + r ELSE 1D END", "pf": "CASE WHEN dv > 0 THEN 1 + r ELSE 1D END"}, {"ln_nvi": f"ln(1000D) + {cum('sum', 'ln(nf)')}", "ln_pvi": f"ln(1000D) + {cum('sum', 'ln(pf)')}"}],
    ),
    "mass_index": Plan(["mass"], [{"rng": "high - low"}, {"q": "e1 / nullif(e2, 0)"}, {"mass": roll("sum", "q", 25)}], {0: {"e1": ("rng", span(9), 9), "e2": ("e1", span(9), 9)}}),
    # forward returns and excursions of an entry at the close
    "forward_returns": Plan(
        [f"{k}{h}" for h in (5, 10, 20) for k in ("r", "mae_long", "mae_short")],
        [{"tr": TR}, {f"lo{h}": over("min", "low", 1, h) for h in (5, 10, 20)} | {f"hi{h}": over("max", "high", 1, h) for h in (5, 10, 20)} | {f"r{h}": f"{lead('close', h)} / close - 1" for h in (5, 10, 20)},
         {f"mae_long{h}": f"CASE WHEN lo{h} IS NOT NULL AND atr IS NOT NULL THEN greatest(0D, (close - lo{h}) / atr) END" for h in (5, 10, 20)} | {f"mae_short{h}": f"CASE WHEN hi{h} IS NOT NULL AND atr IS NOT NULL THEN greatest(0D, (hi{h} - close) / atr) END" for h in (5, 10, 20)}],
        {0: {"atr": ("tr", 1 / 14, 14)}},
    ),
}


def candle_plan() -> Plan:
    """33 candle shapes on body, range, shadows and the trend before; any missing input makes a shape false."""
    shape = {
        "body": "abs(close - open)", "rng": "high - low", "top": "greatest(open, close)", "bot": "least(open, close)", "bull": "close > open", "bear": "close < open",
        "m10": sma("close", 10), "c_5": lag("close", 5),
    }
    measures = {
        "ush": "high - top", "lsh": "bot - low", "abody": over("avg", "body", -10, -1, 5), "arng": over("avg", "rng", -10, -1, 5), "up": "coalesce(close > m10 AND close > c_5, false)", "down": "coalesce(close < m10 AND close < c_5, false)",
    }
    more = {"long": "coalesce(body >= abody, false)", "doji": "body <= 0.1D * rng AND rng > 0"}
    before = {f"{c}_{k}": f"lag({c}, {k}) OVER ({KEY})" for k in (1, 2, 3, 4) for c in ("open", "high", "low", "close", "body", "rng", "top", "bot", "bull", "bear", "long", "doji", "up", "down")}
    ham = "NOT doji AND body <= 0.35D * rng AND lsh >= 2 * body AND ush <= 0.15D * rng"
    inv = "NOT doji AND body <= 0.35D * rng AND ush >= 2 * body AND lsh <= 0.15D * rng"
    maru = "ush <= 0.05D * rng AND lsh <= 0.05D * rng AND long AND rng > 0"
    small = "body_1 <= 0.3D * body_2"

    def marching(side: str, sign: str) -> str:
        bars = ["", "_1", "_2"]
        return " AND ".join([f"{side}{b} AND body{b} >= 0.6D * rng{b}" for b in bars] + [f"close{a} {sign} close{b} AND open{a} BETWEEN least(open{b}, close{b}) AND greatest(open{b}, close{b})" for a, b in zip(bars, bars[1:], strict=False)])

    def held(side: str, sign: str) -> str:
        return f"{side}_4 AND long_4 AND {side} AND long AND close {sign} close_4 AND " + " AND ".join(f"body_{k} < 0.5D * body_4 AND high_{k} <= high_4 AND low_{k} >= low_4" for k in (1, 2, 3))

    base = {
        "doji": "doji", "doji_dragonfly": "doji AND ush <= 0.1D * rng AND lsh >= 0.6D * rng", "doji_gravestone": "doji AND lsh <= 0.1D * rng AND ush >= 0.6D * rng",
        "doji_long_legged": "doji AND ush >= 0.3D * rng AND lsh >= 0.3D * rng AND rng >= 1.3D * arng",
        "hammer": f"{ham} AND down_1", "hanging_man": f"{ham} AND up_1", "inverted_hammer": f"{inv} AND down_1", "shooting_star": f"{inv} AND up_1",
        "bullish_engulfing": "bear_1 AND bull AND open <= close_1 AND close >= open_1 AND body > body_1 AND down_1", "bearish_engulfing": "bull_1 AND bear AND open >= close_1 AND close <= open_1 AND body > body_1 AND up_1",
        "bullish_harami": "bear_1 AND long_1 AND top <= open_1 AND bot >= close_1 AND body <= 0.5D * body_1 AND down_1", "bearish_harami": "bull_1 AND long_1 AND top <= close_1 AND bot >= open_1 AND body <= 0.5D * body_1 AND up_1",
        "piercing_line": "bear_1 AND long_1 AND bull AND open < close_1 AND close > (open_1 + close_1) / 2 AND close < open_1 AND down_1", "dark_cloud_cover": "bull_1 AND long_1 AND bear AND open > close_1 AND close < (open_1 + close_1) / 2 AND close > open_1 AND up_1",
        "morning_star": f"bear_2 AND long_2 AND {small} AND top_1 <= close_2 AND bull AND close > (open_2 + close_2) / 2 AND down_2", "evening_star": f"bull_2 AND long_2 AND {small} AND bot_1 >= close_2 AND bear AND close < (open_2 + close_2) / 2 AND up_2",
        "three_white_soldiers": f"{marching('bull', '>')} AND down_3", "three_black_crows": f"{marching('bear', '<')} AND up_3",
        "tweezer_top": "up_1 AND bull_1 AND bear AND abs(high - high_1) <= 0.1D * arng", "tweezer_bottom": "down_1 AND bear_1 AND bull AND abs(low - low_1) <= 0.1D * arng",
        "bullish_marubozu": f"{maru} AND bull", "bearish_marubozu": f"{maru} AND bear", "spinning_top": "NOT doji AND body <= 0.3D * rng AND ush > body AND lsh > body",
        "rising_three_methods": f"{held('bull', '>')} AND up_4", "falling_three_methods": f"{held('bear', '<')} AND down_4",
        "bullish_kicker": "bear_1 AND long_1 AND bull AND long AND open > open_1", "bearish_kicker": "bull_1 AND long_1 AND bear AND long AND open < open_1",
        "bullish_abandoned_baby": "bear_2 AND long_2 AND doji_1 AND high_1 < low_2 AND bull AND low > high_1 AND down_2", "bearish_abandoned_baby": "bull_2 AND long_2 AND doji_1 AND low_1 > high_2 AND bear AND high < low_1 AND up_2",
    }
    found = {f"is_{k}": f"coalesce({x}, false)" for k, x in base.items()}
    then = {
        "is_three_inside_up": f"coalesce({lag('is_bullish_harami')} AND bull AND close > open_2, false)", "is_three_inside_down": f"coalesce({lag('is_bearish_harami')} AND bear AND close < open_2, false)",
        "is_three_outside_up": f"coalesce({lag('is_bullish_engulfing')} AND bull AND close > close_1, false)", "is_three_outside_down": f"coalesce({lag('is_bearish_engulfing')} AND bear AND close < close_1, false)",
    }
    return Plan([*found, *then], [shape, measures, more, before, found, then], flags=True)


PLANS["candles"] = candle_plan()


def signal_plan() -> Plan:
    """Crossings and breaks on this bar; each is false where its inputs are missing."""
    first = lambda c: f"{c} AND NOT coalesce(lag({c}) OVER ({KEY}), false)"
    stages: list[dict[str, str]] = [
        {
            "c1": lag("close"), "h1": lag("high"), "l1": lag("low"), "tp": TP, "tr": TR, "sma50": sma("close", 50), "sma200": sma("close", 200), "bb_mid": sma("close", 20), "bb_sd": roll("stddev_samp", "close", 20),
            "k": fast_k(14), "rng": "high - low", "mfv": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0D) * volume",
            **{f"m{n}": f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2" for n in (9, 26, 52)},
            **{f"hi{n}": over("max", "high", -n, -1) for n in (20, 55, 252)}, **{f"lo{n}": over("min", "low", -n, -1) for n in (20, 55, 252)},
            "dv": f"coalesce(sign(close - {lag('close')}) * volume, 0D)", "r14": f"close / {lag('close', 14)} - 1 + close / {lag('close', 11)} - 1",
            "vp": f"abs(high - {lag('low')})", "vm": f"abs(low - {lag('high')})",
        },
        {
            "u": f"CASE WHEN c1 IS NOT NULL THEN {UP} END", "dn": f"CASE WHEN c1 IS NOT NULL THEN {DOWN} END", "d": sma("k", 3), "willr": "k - 100", "t1": lag("tp"),
            "upper": "bb_mid + 2 * bb_sd", "lower": "bb_mid - 2 * bb_sd", "tp_mean": f"avg(tp) OVER {frame(-19, 0)}",
            "nr7": f"coalesce(rng <= {roll('min', 'rng', 7)}, false)", "cmf": f"{roll('sum', 'mfv', 20)} / nullif({roll('sum', 'volume', 20)}, 0)", "ad": cum("sum", "mfv"), "obv": cum("sum", "dv"),
            "span_a": f"({lag('m9', 26)} + {lag('m26', 26)}) / 2", "span_b": lag("m52", 26), "coppock": wma("r14", 10),
            "tr1": "CASE WHEN c1 IS NOT NULL THEN tr END", "bp": "CASE WHEN c1 IS NOT NULL THEN close - least(low, c1) END",
            "b20_up": "coalesce(close > hi20, false)", "b20_dn": "coalesce(close < lo20, false)", "b55_up": "coalesce(close > hi55, false)", "b55_dn": "coalesce(close < lo55, false)", "b252_up": "coalesce(close > hi252, false)", "b252_dn": "coalesce(close < lo252, false)",
        },
        {
            "macd": "ef - es", "cci": f"(tp - {sma('tp', 20)}) / nullif(0.015D * (({mad('tp', 20, 'tp_mean')}) / 20), 0)", "rsi": "CASE WHEN ed = 0 THEN 100D ELSE 100 - 100 / (1 + eu / ed) END", "chaikin": "cf - cs", "kc_up": "kmid + 2 * atr20", "kc_lo": "kmid - 2 * atr20", "width": "(upper - lower) / nullif(bb_mid, 0)",
            "pos": "CASE WHEN tp > t1 THEN tp * volume ELSE 0D END", "neg": "CASE WHEN tp < t1 THEN tp * volume ELSE 0D END", "vplus": f"{roll('sum', 'vp', 14)} / nullif({roll('sum', 'tr1', 14)}, 0)", "vminus": f"{roll('sum', 'vm', 14)} / nullif({roll('sum', 'tr1', 14)}, 0)",
            "uo": f"100 * (4 * ({roll('sum', 'bp', 7)}) / nullif({roll('sum', 'tr1', 7)}, 0) + 2 * ({roll('sum', 'bp', 14)}) / nullif({roll('sum', 'tr1', 14)}, 0) + ({roll('sum', 'bp', 28)}) / nullif({roll('sum', 'tr1', 28)}, 0)) / 7",
            "cloud_top": "CASE WHEN span_a IS NOT NULL AND span_b IS NOT NULL THEN greatest(span_a, span_b) END", "cloud_low": "CASE WHEN span_a IS NOT NULL AND span_b IS NOT NULL THEN least(span_a, span_b) END",
            "obv_hi": roll("max", "obv", 20), "obv_lo": roll("min", "obv", 20),
        },
        {
            "mfi": f"CASE WHEN {roll('sum', 'neg', 14)} IS NOT NULL THEN 100 - 100 / (1 + {roll('sum', 'pos', 14)} / nullif({roll('sum', 'neg', 14)}, 0)) END",
            "rlo": roll("min", "rsi", 14), "rhi": roll("max", "rsi", 14), "wq": roll("percentile({x}, 0.2)", "width", 126, 60),
        },
        {"sraw": "100 * (rsi - rlo) / nullif(rhi - rlo, 0)", "squeezed": "CASE WHEN width <= wq THEN 1D ELSE 0D END"},
        {"srsi": sma("sraw", 3), "recent": f"coalesce({over('sum', 'squeezed', -5, -1)}, 0D)"},
    ]
    ema = {
        1: {"ef": ("close", span(12), 12), "es": ("close", span(26), 26), "eu": ("u", 1 / 14, 14), "ed": ("dn", 1 / 14, 14), "cf": ("ad", span(3), 3), "cs": ("ad", span(10), 10), "kmid": ("close", span(20), 20), "atr20": ("tr", 1 / 20, 20)},
        2: {"msig": ("macd", span(9), 0)},
    }
    pairs = {
        "macd_bull_cross": ("macd", "msig", 1), "macd_bear_cross": ("macd", "msig", -1), "macd_zero_up": ("macd", "0", 1), "macd_zero_down": ("macd", "0", -1), "golden_cross": ("sma50", "sma200", 1), "death_cross": ("sma50", "sma200", -1),
        "close_x_sma50_up": ("close", "sma50", 1), "close_x_sma50_down": ("close", "sma50", -1), "close_x_sma200_up": ("close", "sma200", 1), "close_x_sma200_down": ("close", "sma200", -1), "ichimoku_tk_bull": ("m9", "m26", 1), "ichimoku_tk_bear": ("m9", "m26", -1),
        "kumo_breakout_up": ("close", "cloud_top", 1), "kumo_breakout_down": ("close", "cloud_low", -1), "vortex_bull_cross": ("vplus", "vminus", 1), "vortex_bear_cross": ("vplus", "vminus", -1), "rsi_os_enter": ("rsi", "30", -1), "rsi_os_exit": ("rsi", "30", 1),
        "rsi_ob_enter": ("rsi", "70", 1), "rsi_ob_exit": ("rsi", "70", -1), "willr_os_exit": ("willr", "-80", 1), "willr_ob_exit": ("willr", "-20", -1), "cci_up100": ("cci", "100", 1), "cci_down100": ("cci", "-100", -1), "cci_os_exit": ("cci", "-100", 1),
        "cci_ob_exit": ("cci", "100", -1), "stochrsi_os_exit": ("srsi", "20", 1), "stochrsi_ob_exit": ("srsi", "80", -1), "uo_os_exit": ("uo", "30", 1), "uo_ob_exit": ("uo", "70", -1), "bb_reentry_up": ("close", "lower", 1), "bb_reentry_down": ("close", "upper", -1),
        "keltner_breakout_up": ("close", "kc_up", 1), "keltner_breakout_down": ("close", "kc_lo", -1), "chaikin_zero_up": ("chaikin", "0", 1), "chaikin_zero_down": ("chaikin", "0", -1), "mfi_os_exit": ("mfi", "20", 1), "mfi_ob_exit": ("mfi", "80", -1),
    }
    last = {k: (xup if d > 0 else xdn)(a, b) for k, (a, b, d) in pairs.items()}
    c2 = lag("coppock", 2)
    last |= {
        "stoch_bull_os": f"{xup('k', 'd')} AND d < 20", "stoch_bear_ob": f"{xdn('k', 'd')} AND d > 80", "cmf_confirmed_sma50_up": f"{xup('close', 'sma50')} AND coalesce(cmf > 0, false)", "cmf_confirmed_sma50_down": f"{xdn('close', 'sma50')} AND coalesce(cmf < 0, false)",
        "bb_squeeze_breakout_up": f"{xup('close', 'upper')} AND recent > 0", "bb_squeeze_breakout_down": f"{xdn('close', 'lower')} AND recent > 0", "gap_up": "coalesce(low > h1, false)", "gap_down": "coalesce(high < l1, false)",
        "nr7_breakout_up": f"coalesce({lag('nr7')} AND close > h1, false)", "nr7_breakout_down": f"coalesce({lag('nr7')} AND close < l1, false)",
        "coppock_turn_up": f"coalesce(coppock < 0 AND coppock > {lag('coppock')} AND {lag('coppock')} <= {c2}, false)", "coppock_turn_down": f"coalesce(coppock > 0 AND coppock < {lag('coppock')} AND {lag('coppock')} >= {c2}, false)",
        "obv_confirmed_breakout": f"{first('b20_up')} AND coalesce(obv >= obv_hi, false)", "obv_confirmed_breakdown": f"{first('b20_dn')} AND coalesce(obv <= obv_lo, false)",
        "donchian20_breakout": first("b20_up"), "donchian20_breakdown": first("b20_dn"), "donchian55_breakout": first("b55_up"), "donchian55_breakdown": first("b55_dn"), "high_52w_breakout": first("b252_up"), "low_52w_breakdown": first("b252_dn"),
    }
    return Plan(list(last), [*stages, {f"s_{k}": v for k, v in last.items()}, {k: f"s_{k}" for k in last}], ema, flags=True)


def strategy_plan() -> Plan:
    """Positions decided at the close of each bar: 1 long, 0 flat, -1 short; 0 while a measure is missing."""
    vs = lambda a, b, down: f"CASE WHEN {b} IS NULL THEN 0 WHEN {a} > {b} THEN 1 ELSE {down} END"
    return Plan(
        ["sma_cross", "ema_cross", "tsmom", "macd_trend", "regime_long", "vol_scale"],
        [
            {"s50": sma("close", 50), "s200": sma("close", 200), "r12": f"{lag('close', 21)} / {lag('close', 252)} - 1", "r": f"close / {lag('close')} - 1"},
            {"macd": "e12 - e26", "rv": f"{roll('stddev_samp', 'r', 20)} * sqrt(252D)"},
            {"sma_cross": vs("s50", "s200", "0"), "ema_cross": vs("e20", "e100", "0"), "tsmom": "CASE WHEN r12 IS NULL THEN 0 WHEN r12 > 0 THEN 1 ELSE -1 END", "macd_trend": "CASE WHEN macd > sig AND macd > 0 THEN 1 ELSE 0 END",
             "regime_long": "CASE WHEN close > s200 THEN 1 ELSE 0 END", "vol_scale": "coalesce(least(0.15D / nullif(rv, 0), 2D), 0D)"},
        ],
        {0: {"e12": ("close", span(12), 12), "e26": ("close", span(26), 26), "e20": ("close", span(20), 20), "e100": ("close", span(100), 100)}, 1: {"sig": ("macd", span(9), 0)}},
    )


PLANS["signals"] = signal_plan()
PLANS["strategy_positions"] = strategy_plan()
