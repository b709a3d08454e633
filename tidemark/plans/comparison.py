"""Event comparisons, the value area of a market profile, and news scores, each over a given table, with the oracle's own text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import panel, permutation, sentiment
from tidemark.sources.bars import DAILY_SQL, SPARSE_SQL, daily_bars, sparse_bars, table

W = "PARTITION BY symbol ORDER BY time"
TRIALS, SEED, EXTREME, BINS, AREA = 200, 7, 1.5, 50, 0.7

_EVENTS = f"""r AS (SELECT symbol, time, close / lag(close) OVER ({W}) - 1 AS r, lead(close, 5) OVER ({W}) / lead(open) OVER ({W}) - 1 AS ahead FROM bars),
z AS (SELECT *, CASE WHEN count(r) OVER w60 >= 30 THEN r / nullif(stddev_samp(r) OVER w60, 0) END AS z FROM r WINDOW w60 AS ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT z.symbol, z.time AS date, u.time IS NOT NULL AS flag, round(sign(r) * ahead, 9) AS car5 FROM z LEFT JOIN (SELECT time FROM sparse WHERE symbol = '1-URGENT') u ON u.time = z.time WHERE abs(round(z, 6)) > {EXTREME}"""


def event_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extreme days with and without an urgent order that day, by the next five days' move from the next open."""
    events = spark.sql("WITH " + _EVENTS.replace("FROM bars", "FROM {bars}").replace("FROM sparse", "FROM {sparse}"), bars=daily_bars(spark, sf_dir), sparse=sparse_bars(spark, sf_dir))
    return permutation.compare(events, "car5", TRIALS, SEED).drop("note")


def market_profile_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point of control and value area: from the fullest bin, the fuller neighbour is added, the upper on a tie, until AREA of the volume lies within.

    Bins are summed by (symbol, bin); only a symbol's BINS sums meet in a fold.
    """
    bars = daily_bars(spark, sf_dir)
    span = bars.groupBy("symbol").agg(F.min("low").alias("lo"), ((F.max("high") - F.min("low")) / BINS).alias("w"))
    x = bars.join(span, "symbol").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    b0, b1 = F.col("lo") + F.col("bin") * F.col("w"), F.col("lo") + (F.col("bin") + 1) * F.col("w")
    share = F.greatest(F.lit(0.0), F.least("high", b1) - F.greatest("low", b0)) / (F.col("high") - F.col("low"))
    flat = (F.least(F.floor((F.col("close") - F.col("lo")) / F.col("w")), F.lit(BINS - 1)) == F.col("bin")).cast("double")
    hist = x.groupBy("symbol", "lo", "w", "bin").agg(F.round(F.sum(F.col("volume") * F.when(F.col("high") > F.col("low"), share).otherwise(flat)), 4).alias("v"))
    h = hist.groupBy("symbol", "lo", "w").agg(F.array_sort(F.collect_list(F.struct("bin", "v")))["v"].alias("h"), F.sum("v").alias("all"), F.max_by("bin", F.struct("v", -F.col("bin"))).alias("poc"))
    at = lambda i: F.when((i >= 0) & (i < BINS), F.try_element_at("h", (i + 1).cast("int"))).otherwise(-1.0)
    start = F.struct(F.col("poc").alias("a"), F.col("poc").alias("b"), at(F.col("poc")).alias("s"))

    def grow(s, _):
        up, down = at(s["b"] + 1), at(s["a"] - 1)
        done = (s["s"] >= AREA * F.col("all")) | ((s["a"] <= 0) & (s["b"] >= BINS - 1))
        above = up >= down
        return F.when(done, s).otherwise(F.struct(F.when(above, s["a"]).otherwise(s["a"] - 1).alias("a"), F.when(above, s["b"] + 1).otherwise(s["b"]).alias("b"), (s["s"] + F.greatest(up, down)).alias("s")))

    out = h.withColumn("g", F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), start, grow))
    level = lambda i: F.round(F.col("lo") + i * F.col("w"), 6)
    return out.select("symbol", level(F.col("poc") + 0.5).alias("poc"), level(F.col("g.b") + 1).alias("vah"), level(F.col("g.a")).alias("val"), F.round(F.col("g.s") / F.col("all"), 6).alias("share"))


#: Realised volatility of the next five bars on that of the last five and twenty, in logs.
_VOLATILITY = f"""r AS (SELECT symbol, time, power(ln(close / lag(close) OVER ({W})), 2) AS r2 FROM bars),
v AS (SELECT symbol, time, sum(r2) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead, count(r2) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS k, sum(r2) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v1, sum(r2) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v4, count(r2) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS k4 FROM r)
SELECT symbol, time, ln(sqrt(ahead)) AS y, ln(sqrt(v1)) AS log_rv1, ln(sqrt(v4 / 4)) AS log_rv4 FROM v WHERE k = 5 AND k4 = 20 AND ahead > 0 AND v1 > 0"""
LAGS = 5


def volatility_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("WITH " + _VOLATILITY.replace("FROM bars", "FROM {bars}"), bars=daily_bars(spark, sf_dir))
    out = panel.driscoll_kraay(rows, "y", ["log_rv1", "log_rv4"], LAGS)
    return out.select("term", "n", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), F.round("t", 4).alias("t"))


#: Stand-ins, in the driver's invented words, for a news lexicon's phrases: pattern and token.
PHRASES = [(r"\bof the\b", "fin_of_the"), (r"\bde la\b", "fin_de_la"), (r"\bin der\b", "fin_in_der"), (r"\bthat the\b", "fin_that_the")]

#: Words of the labelled documents by how much more often they stand in good ones, from -4 to 4; phrases' tokens are words too.
_LEXICON = """
g AS (SELECT word, sum(quality) AS good, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 20), a AS (SELECT avg(CAST(quality AS DOUBLE)) AS share FROM l)
SELECT word, round(4 * (good / n - share), 6) AS valence FROM g CROSS JOIN a WHERE round(4 * (good / n - share), 6) <> 0"""


def news_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored with a lexicon that the labels give: a word's valence is its share of good documents less that of all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality IS NOT NULL")
    labelled = docs.join(labels, "doc_id").select("doc_id", "quality", F.array_distinct(F.transform(sentiment.tokens(F.col("text"), PHRASES), lambda t: F.replace(F.lower(t), F.lit("'"), F.lit("")))).alias("ws"))
    words = labelled.select("doc_id", "quality", F.explode("ws").alias("word"))
    lexicon = spark.sql("WITH " + _LEXICON.replace("FROM w ", "FROM {w} ").replace("FROM l)", "FROM {l})").strip(), w=words, l=labelled)
    return sentiment.scores(docs, "text", ["doc_id"], lexicon, PHRASES).select("doc_id", F.col("n_valued").cast("long").alias("n_valued"), F.round("compound", 6).alias("compound"))


QUERIES = {f.__name__: f for f in (event_comparison, market_profile_area, news_score, volatility_panel)}


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _news_sql() -> str:
    s, text = sentiment, "coalesce(text, '')"
    for pattern, token in PHRASES:
        text = f"regexp_replace({text}, '(?i){pattern}', ' {token} ', 'g')"
    token = s.TOKEN.replace("'", "''")
    plain = lambda w: f"replace(lower({w}), '''', '')"
    steps, alive = [], "true"
    boosts, turns = [], []
    for j, decay in enumerate(s.DECAY, 1):
        boosts.append(f"CASE WHEN {alive} THEN coalesce(CASE WHEN p{j} IN ({_quoted(s.RAISE)}) THEN {s.BOOST} WHEN p{j} IN ({_quoted(s.LOWER)}) THEN -{s.BOOST} ELSE 0 END, 0) * {decay} ELSE 0 END")
        turns.append(f"({alive} AND coalesce(p{j} IN ({_quoted(s.NEGATE)}) OR regexp_full_match(o{j}, '[^'']*n''t'), false))")
        steps.append(f"coalesce(p{j} NOT IN ({_quoted(s.CONTRAST)}), true)")
        alive = " AND ".join(steps)
    return f"""
WITH d AS (SELECT doc_id, len(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) AS marks, regexp_extract_all({text}, '{token}') AS ws FROM documents),
l AS (SELECT d.doc_id, quality, ws FROM d JOIN labels ON d.doc_id = labels.doc_id WHERE quality IS NOT NULL),
w AS (SELECT DISTINCT doc_id, quality, {plain('t')} AS word FROM (SELECT doc_id, quality, unnest(ws) AS t FROM l)),
lex AS (WITH {_LEXICON.strip()}),
t AS (SELECT doc_id, marks, i, word AS o, lower(word) AS low, {plain('word')} AS p FROM (SELECT doc_id, marks, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d)),
m AS (SELECT doc_id, count(*) FILTER (regexp_full_match(o, '[A-Za-z][A-Za-z]+') AND o = upper(o)) > 0 AND count(*) FILTER (regexp_full_match(o, '[A-Za-z][A-Za-z]+') AND o <> upper(o)) > 0 AS mixed,
 coalesce(min(i) FILTER (low = 'but'), min(i) FILTER (low = 'however'), 0) AS k FROM t GROUP BY doc_id),
c AS (SELECT *, {", ".join(f"lag(p, {j}) OVER o AS p{j}, lag(low, {j}) OVER o AS o{j}" for j in (1, 2, 3))} FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT c.doc_id, CASE WHEN k = 0 OR i = k THEN 1 WHEN i < k THEN 0.5 ELSE 1.5 END * CASE WHEN {" OR ".join(turns)} THEN {s.TURNED} ELSE 1 END
 * (valence + sign(valence) * (CASE WHEN mixed AND regexp_full_match(o, '[A-Za-z][A-Za-z]+') AND o = upper(o) THEN {s.CAPITALS} ELSE 0 END + {" + ".join(boosts)})) AS v
 FROM c JOIN m ON c.doc_id = m.doc_id JOIN lex ON c.p = lex.word WHERE c.p NOT IN ({_quoted(s.RAISE + s.LOWER)})),
s AS (SELECT doc_id, sum(v) AS s, count(*) AS n FROM v GROUP BY doc_id),
x AS (SELECT d.doc_id, coalesce(n, 0) AS n_valued, CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE s + sign(s) * least(marks, {s.MOST_EXCLAIMED}) * {s.EXCLAIM} END AS s FROM d LEFT JOIN s ON d.doc_id = s.doc_id)
SELECT doc_id, n_valued, round(s / sqrt(s * s + {s.NORM}), 6) AS compound FROM x"""


_BARS = f"bars AS ({DAILY_SQL})"
ORACLE = {
    "event_comparison": f"""
WITH {_BARS}, sparse AS ({SPARSE_SQL}), ev AS (WITH {_EVENTS}), e AS (SELECT * FROM ev WHERE car5 IS NOT NULL),
dm AS (SELECT flag, count(*) AS dates, avg(v) AS mean, var_samp(v) AS var FROM (SELECT flag, date, avg(car5) AS v FROM e GROUP BY flag, date) GROUP BY flag),
a AS (SELECT * FROM dm WHERE flag), b AS (SELECT * FROM dm WHERE NOT flag),
n AS (SELECT count(*) FILTER (flag) AS n1, count(*) FILTER (NOT flag) AS n0, sum(car5) FILTER (flag) AS real, sum(car5) AS total FROM e),
k AS (SELECT *, count(*) FILTER (flag) OVER (PARTITION BY symbol, year(date)) AS k FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY trial, symbol, year(date) ORDER BY md5(concat_ws(':', '{SEED}', trial, symbol, date)), date) AS place FROM k, range(1, {TRIALS + 1}) AS g(trial)),
s AS (SELECT trial, sum(car5) AS s FROM t WHERE place <= k GROUP BY trial),
p AS (SELECT count(*) FILTER (round(abs(s / n1 - (total - s) / n0), 12) >= round(abs(real / n1 - (total - real) / n0), 12)) AS beyond FROM s, n)
SELECT n1 AS n_flag, n0 AS n_noflag, a.dates AS dates_flag, b.dates AS dates_noflag, round(a.mean * 1e4, 1) AS mean_flag_bp, round(b.mean * 1e4, 1) AS mean_noflag_bp, round((a.mean - b.mean) * 1e4, 1) AS diff_bp,
 round((a.mean - b.mean) / sqrt(a.var / a.dates + b.var / b.dates), 2) AS t, round(a.mean / sqrt(a.var / a.dates), 2) AS t_flag, round(b.mean / sqrt(b.var / b.dates), 2) AS t_noflag, round((beyond + 1) / {TRIALS + 1}.0::DOUBLE, 4) AS perm_p FROM n, a, b, p""",
    "market_profile_area": f"""
WITH RECURSIVE {_BARS}, r AS (SELECT symbol, min(low) AS lo, (max(high) - min(low)) / {BINS} AS w FROM bars GROUP BY symbol),
x AS (SELECT bars.*, lo, w, bin, lo + bin * w AS b0, lo + (bin + 1) * w AS b1 FROM bars JOIN r ON bars.symbol = r.symbol, range(0, {BINS}) AS g(bin)),
h AS (SELECT symbol, lo, w, bin, round(sum(volume * CASE WHEN high > low THEN greatest(0, least(high, b1) - greatest(low, b0)) / (high - low) WHEN least(floor((close - lo) / w), {BINS - 1}) = bin THEN 1 ELSE 0 END), 4) AS v FROM x GROUP BY symbol, lo, w, bin),
p AS (SELECT symbol, lo, w, sum(v) AS total, arg_max(bin, (v, -bin)) AS poc, max(v) AS top FROM h GROUP BY symbol, lo, w),
g AS (SELECT symbol, poc AS a, poc AS b, top AS s, 0 AS step FROM p UNION ALL
 SELECT g.symbol, CASE WHEN coalesce(u.v, -1) >= coalesce(d.v, -1) THEN a ELSE a - 1 END, CASE WHEN coalesce(u.v, -1) >= coalesce(d.v, -1) THEN b + 1 ELSE b END, s + greatest(coalesce(u.v, -1), coalesce(d.v, -1)), step + 1
 FROM g JOIN p ON g.symbol = p.symbol LEFT JOIN h u ON u.symbol = g.symbol AND u.bin = b + 1 LEFT JOIN h d ON d.symbol = g.symbol AND d.bin = a - 1 WHERE s < {AREA} * total AND (a > 0 OR b < {BINS - 1})),
z AS (SELECT symbol, max(step) AS step FROM g GROUP BY symbol)
SELECT g.symbol, round(lo + (poc + 0.5) * w, 6) AS poc, round(lo + (b + 1) * w, 6) AS vah, round(lo + a * w, 6) AS val, round(s / total, 6) AS share FROM g JOIN z ON g.symbol = z.symbol AND g.step = z.step JOIN p ON p.symbol = g.symbol""",
    "news_score": _news_sql(),
    "volatility_panel": f"""
WITH {_BARS}, q AS (WITH {_VOLATILITY}), x AS (SELECT time, y - avg(y) OVER s AS y, log_rv1 - avg(log_rv1) OVER s AS u, log_rv4 - avg(log_rv4) OVER s AS w FROM q WINDOW s AS (PARTITION BY symbol)),
a AS (SELECT count(*) AS n, sum(u * u) AS uu, sum(u * w) AS uw, sum(w * w) AS ww, sum(u * y) AS uy, sum(w * y) AS wy FROM x),
b AS (SELECT *, uu * ww - uw * uw AS det, (ww * uy - uw * wy) / (uu * ww - uw * uw) AS b1, (uu * wy - uw * uy) / (uu * ww - uw * uw) AS b2 FROM a),
h AS (SELECT time, sum(u * (y - b1 * u - b2 * w)) AS h1, sum(w * (y - b1 * u - b2 * w)) AS h2 FROM x, b GROUP BY time),
k AS (SELECT row_number() OVER (ORDER BY time) AS i, h1, h2 FROM h),
s AS (SELECT sum(a1 * g1 * f) AS s11, sum(a1 * g2 * f) AS s12, sum(a2 * g2 * f) AS s22 FROM (SELECT p.h1 AS a1, p.h2 AS a2, q.h1 AS g1, q.h2 AS g2, 1 - abs(p.i - q.i) / {LAGS + 1}.0::DOUBLE AS f FROM k p JOIN k q ON abs(p.i - q.i) <= {LAGS})),
e AS (SELECT n, b1, b2, sqrt((ww * ww * s11 - 2 * ww * uw * s12 + uw * uw * s22) / (det * det)) AS e1, sqrt((uw * uw * s11 - 2 * uu * uw * s12 + uu * uu * s22) / (det * det)) AS e2 FROM b, s)
SELECT 'log_rv1' AS term, n, round(b1, 6) AS beta, round(e1, 6) AS se, round(b1 / e1, 4) AS t FROM e UNION ALL SELECT 'log_rv4', n, round(b2, 6), round(e2, 6), round(b2 / e2, 4) FROM e""",
}
