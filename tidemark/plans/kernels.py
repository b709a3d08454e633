"""Queries that run kernels, text functions and pricing; those with a SQL form have an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scratch import Rounds
from tidemark.operators import calls, hawkes, leaders, options, recursive, strategies, text, validation
from tidemark.plans import parity, phases
from tidemark.sources.bars import DAILY_SQL, daily_bars, smoothed_bars, table
from tidemark.sources.versions import Dataset

POSITIVE, NEGATIVE, NEGATORS = ["the", "le*", "and"], ["of", "der", "para"], ["in", "un"]


def _day(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def state_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(recursive.with_states(daily_bars(spark, sf_dir), *recursive.STATES), "time")


def zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recursive.rows_of(smoothed_bars(spark, sf_dir), recursive.zigzag, "pivot int, price double, kind int, confirm int", {"time": 0, "confirm_time": 3})
    return _day(out, "time", "confirm_time")


def renko(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(recursive.rows_of(smoothed_bars(spark, sf_dir), recursive.renko, "bar int, side int, open double, close double", {"time": 0}), "time")


def point_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(recursive.rows_of(smoothed_bars(spark, sf_dir), recursive.point_figure, "col int, kind int, low double, high double, boxes int, first int, last int", {"start": 5, "end": 6}), "start", "end")


def state_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(strategies.positions(daily_bars(spark, sf_dir)), "time")


def strategy_backtests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly net return and turnover of every state strategy, equal weight over symbols."""
    pos = strategies.positions(daily_bars(spark, sf_dir))
    names = list(strategies.POSITIONS)
    long = pos.unpivot(["symbol", "time", "close"], names, "strategy", "position")
    weights = long.crossJoin(F.broadcast(_count(pos)))  # one row
    weights = weights.select("strategy", "symbol", "time", "close", (F.col("position") / F.col("n_symbols")).alias("weight"))
    out = strategies.simulate(weights, by="strategy")
    return out.groupBy("strategy", F.year("time").cast("long").alias("year")).agg(F.round(F.sum("net"), 8).alias("net"), F.round(F.sum("turnover"), 8).alias("turnover"))


def _count(pos: DataFrame) -> DataFrame:
    return pos.agg(F.count_distinct("symbol").alias("n_symbols"))


def state_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the state machines: the bar on which each changes side or crosses its line."""
    w = W.partitionBy("symbol").orderBy("time")
    df = recursive.with_states(daily_bars(spark, sf_dir), "supertrend", "psar", "schaff", "klinger", "dow")
    was = lambda c: F.lag(c).over(w)
    flip = lambda c, side: (F.col(c) == side) & (was(c) == -side)
    turn = lambda side: (F.col("dow") == side) & (was("dow") != side)
    out = {
        "supertrend_flip_up": flip("st_trend", 1), "supertrend_flip_down": flip("st_trend", -1), "psar_flip_up": flip("psar_trend", 1), "psar_flip_down": flip("psar_trend", -1),
        "schaff_up": (F.col("schaff") > 25) & (was("schaff") <= 25), "schaff_down": (F.col("schaff") < 75) & (was("schaff") >= 75), "dow_turn_up": turn(1), "dow_turn_down": turn(-1),
        "klinger_bull_cross": (F.col("kvo") > F.col("kvo_signal")) & (was("kvo") <= was("kvo_signal")), "klinger_bear_cross": (F.col("kvo") < F.col("kvo_signal")) & (was("kvo") >= was("kvo_signal")),
    }
    nulls = {c: F.when(~F.isnan(c), F.col(c)) for c in ("st_trend", "psar_trend", "schaff", "kvo", "kvo_signal", "dow")}
    return _day(df.withColumns(nulls).select("symbol", "time", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in out.items()]), "time")


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy, time, weights, moves, net) of every state strategy, equal weight over symbols, at 5 basis points."""
    pos = strategies.positions(daily_bars(spark, sf_dir))
    w = W.partitionBy("strategy", "symbol").orderBy("time")
    long = pos.unpivot(["symbol", "time", "close"], list(strategies.POSITIONS), "strategy", "position")
    long = long.crossJoin(F.broadcast(_count(pos)))  # one row
    held = F.coalesce(F.lag("position").over(w), F.lit(0.0)) / F.col("n_symbols")
    x = long.select("*", held.alias("held"), F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)).alias("move"))
    x = x.withColumn("traded", F.abs(F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0.0))))
    names = [r.symbol for r in pos.select("symbol").distinct().orderBy("symbol").collect()]  # the panel's symbols: one slot each
    slot = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("symbol") == s, F.col(c))), F.lit(0.0)) for s in names])
    return x.groupBy("strategy", "time").agg(slot("held").alias("weights"), slot("move").alias("moves"), (F.sum(F.col("held") * F.col("move")) - F.sum("traded") * 5 / 1e4).alias("net"))


def strategy_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio with its probabilities, bootstrap interval and permutation p of every state strategy."""
    book = _book(spark, sf_dir)
    stats = validation.sharpe_stats(book, trials=len(strategies.POSITIONS))
    out = stats.join(validation.bootstrap_sharpe(book), "strategy", "left").join(validation.permutation_p(book).drop("real"), "strategy", "left")
    return out.select("strategy", "n", *[F.round(c, 6).alias(c) for c in ("sharpe", "psr", "dsr", "ci_low", "ci_high", "p_le_0", "p")])


def token_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tone(table(spark, sf_dir, "documents"), "text", "doc_id", POSITIVE, NEGATIVE, NEGATORS)


def headline_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("text_md5"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


def _headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.substring_index("text", ".", 1).alias("title"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("avail"))


def novelty_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.novelty(_headlines(spark, sf_dir), "source", "avail", "title", "doc_id")


def headline_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of web pages by their host's top domain, in the order of page ids."""
    pages = table(spark, sf_dir, "pages").where("page_id IS NOT NULL")
    title = text.html_to_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    block = F.regexp_extract("url", r"^[a-z]+://[^/:?#]*\.([a-z]+)", 1)
    out = leaders.leaders(pages.select(block.alias("block"), F.col("page_id").alias("k"), title.alias("title")))
    return out.select(F.col("k").alias("page_id"), "block", "leader")


def option_greeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a chain made from parts: spot 950, strikes by price, half a year, mids from a fixed formula."""
    p = table(spark, sf_dir, "part").groupBy((F.floor(F.col("p_retailprice") / 5) * 5).cast("double").alias("strike")).agg(F.count(F.lit(1)).alias("n"))
    chain = p.select("strike", F.explode(F.array(F.lit("C"), F.lit("P"))).alias("kind"))
    intrinsic = F.greatest(F.when(F.col("kind") == "C", F.lit(950.0) - F.col("strike")).otherwise(F.col("strike") - F.lit(950.0)), F.lit(0.0))
    return options.with_greeks(chain.withColumn("mid", intrinsic + 40.0), F.lit(950.0), F.lit(0.5))


#: Words of the driver's invented texts in place of a call's: what a sentence of guidance names, and which way.
_CALL = {"withdraw": r"\bnever\b", "raise": r"\band\b", "lower": r"\bof\b", "reaffirm": r"\bin\b"}


def guidance_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.guidance(table(spark, sf_dir, "documents"), "text", "doc_id", r"\bthe\b", _CALL)


def call_text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    out = calls.call_metrics(d, "text", "doc_id", {"the": r"\bthe\b", "le": r"\ble\w*", "number": r"\d+"}, r"\b(and|der)\b", r"\n")
    return out.select("doc_id", "n_words", "fls_per1k", "fls_sentence_share", "qa_share", *[F.col("topics")[k].alias(f"n_{k}") for k in ("the", "le", "number")])


def risk_parity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.risk_parity(daily_bars(spark, sf_dir))


def wyckoff_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(phases.wyckoff(daily_bars(spark, sf_dir)), "time")


def pair_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread of the first two return flags' bars."""
    out = _day(phases.pairs(daily_bars(spark, sf_dir), "A", "N"), "time")
    return out.select("a", "b", "time", "side", *[F.round(c, 6).alias(c) for c in ("z", "weight_a", "weight_b")])


def hawkes_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _day(hawkes.posterior(daily_bars(spark, sf_dir), hawkes.Spec(iters=1000, burn=300, chains=2)), "time")
    return out.select("symbol", "time", "events", *[F.round(c, 6).alias(c) for c in ("n_mean", "n_lo", "n_hi", "p_n_gt_0_5", "mu_mean", "decay_bars", "accept", "log_rv1", "log_rv4", "y")])


def dataset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars built in two versions, the second accumulating later bars onto the first, and read back by split; files are verified."""
    bars = daily_bars(spark, sf_dir)
    data = Dataset(spark, Rounds(spark, "dataset").root, "bars")
    data.build(bars.where("time < DATE '2000-01-01'"))
    data.build(bars.where("time >= DATE '1999-01-01'"), accumulate=True)
    sound = data.verify().agg(F.bool_and(F.col("status") == "ok").alias("sound"))  # one row
    out = []
    for version in data.versions():
        for split in ("train", "validation", "test"):
            x = data.load(version, split, allow_test=True, note="counts")
            out.append(x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("time").cast("string").alias("first_bar"), F.max("time").cast("string").alias("last_bar"), F.round(F.sum("close"), 2).alias("close")).select(F.lit(version).alias("version"), F.lit(split).alias("split"), "*"))
    every = out[0]
    for part in out[1:]:
        every = every.union(part)
    return every.crossJoin(F.broadcast(sound))


_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '([A-Za-z][A-Za-z''\\-]*)')"
_POS = "(t IN ('the', 'and') OR starts_with(t, 'le'))"
_TURNED = "len(list_intersect(ts[greatest(i - 3, 1):i - 1], ['in', 'un'])) > 0"

ORACLE = {
    "dataset_build": f"""
WITH b AS ({DAILY_SQL}), v AS (SELECT 1 AS version, * FROM b WHERE time < DATE '2000-01-01' UNION ALL SELECT 2, * FROM b)
SELECT version, CASE WHEN time <= DATE '1998-12-31' THEN 'train' WHEN time <= DATE '2000-06-30' THEN 'validation' ELSE 'test' END AS split, symbol, count(*) AS n, min(time)::VARCHAR AS first_bar, max(time)::VARCHAR AS last_bar, round(sum(close), 2) AS close, true AS sound FROM v GROUP BY 1, 2, 3""",
    "token_tone": f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), e AS (SELECT doc_id, ts, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM d),
f AS (SELECT doc_id, {_POS} AS pos, t IN ('of', 'der', 'para') AS neg, {_TURNED} AS turned FROM e),
g AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (pos AND NOT turned) AS n_pos, count(*) FILTER (neg OR (pos AND turned)) AS n_neg FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg, round((n_pos - n_neg) * 100.0::DOUBLE / n_tokens, 6) AS net_tone FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
}

QUERIES = {f.__name__: f for f in (dataset_build, hawkes_panel, wyckoff_phase, pair_positions, guidance_direction, call_text_metrics, risk_parity_weights, state_columns, state_signals, strategy_significance, zigzag, renko, point_figure, state_strategies, strategy_backtests, token_tone, headline_slug, page_text, sentence_counts, novelty_cosine, headline_dedupe, option_greeks)}
