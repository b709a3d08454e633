"""News sentiment and event tags: valence words in their context, natively.

Phrases are rewritten to single tokens first, in the order given. A token with a
valence is raised or lowered by boosters up to three tokens before it, raised in
capitals among other writing, turned by a negator there, and none of these reach
over a contrast. What comes before a text's first contrast counts half, what
comes after one and a half.

Context is put into each token by array functions, and a row's tokens of one word
become one cell of two weights, for the word's valence and for its sign. Cells are
joined to the lexicon table (Spark picks the join by its size) and summed by row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words and weights of the score.
NEGATE = "not no never nor neither without cannot cant dont doesnt didnt isnt wasnt arent wont fails failed fail unable hardly barely".split()
RAISE = "very extremely hugely massively sharply significantly strongly deeply highly huge massive major really so most totally absolutely substantially dramatically incredibly exceptionally big biggest".split()
LOWER = "slightly somewhat marginally modestly mildly little partly kinda sorta less".split()
CONTRAST = ["but", "however"]
BOOST, CAPITALS, TURNED, EXCLAIM, MOST_EXCLAIMED, NORM = 0.293, 0.733, -0.74, 0.292, 4, 15
DECAY = (1.0, 0.95, 0.9)
LABELS = {"bullish": 0.6, "bearish": -0.6}
TOKEN = r"""[A-Za-z0-9][A-Za-z0-9_'\-]*|\$[A-Za-z]+|[^\p{L}\p{M}\p{N}_\s!?.,;:()"\[\]/]"""

# The patterns of event kinds, over a text whose phrases are rewritten.
EVENT_RULES = {
    "earnings": r"\b(earnings|eps|quarterly (results|profit|revenue)|q[1-4] (results|earnings|revenue|sales)|results|fin_beat|fin_miss|revenue|profit)\b",
    "guidance": r"\b(guidance|outlook|fin_guide_up|fin_guide_down|forecasts?|profit warning|fin_profit_warning)\b",
    "m&a": r"\b(acquir(e|es|ed|ing)|acquisition|merger|merge|takeover|buyout|tender offer|bid for|(agrees?|deal|plans?|offers?|bids?|moves?|sets?) to (buy|acquire)|stake in|spin[- ]?off|divest)",
    "analyst": r"\b(upgrades?|upgraded|downgrades?|downgraded|price target|fin_pt_up|fin_pt_down|initiat(es|ed) coverage|overweight|underweight|outperform|underperform|reiterat(es|ed))\b",
    "regulatory_legal": r"\b(sec|doj|ftc|fca|cma|antitrust|lawsuit|sues?|sued|probe|investigation|fined?|settlement|settles|court|ruling|regulators?|fin_reg_probe|fin_class_action|subpoena|recalls?)\b",
    "management": r"\b(ceo|cfo|coo|chairman|chief executive|president)\b.*\b(resign|resigns|steps down|step down|departs|appointed|appoints|names|hired|fired|ousted|retire|retires|successor)\b|\b(resigns|steps down|appoints|names)\b.*\b(ceo|cfo|chairman|chief executive)\b",
    "product": r"\b(launch(es|ed)?|unveil(s|ed)?|releases?|new (product|model|chip|phone|drug)|fda|fin_fda_ok|fin_fda_no|patent|rollout|recalls?)\b",
    "macro": r"\b(fed|fomc|rate (cut|hike)s?|interest rates?|inflation|cpi|ppi|payrolls|jobs report|gdp|tariffs?|recession|ecb|boe|bank of england|treasury yields?|central bank)\b",
    "capital_return": r"\b(buybacks?|repurchase|dividends?|fin_buyback|fin_div_up|fin_div_down|special dividend)\b",
    "short_report": r"\b(fin_short_report|hindenburg|muddy waters|citron|gotham city|spruce point|culper|kerrisdale|grizzly research|blue orca|wolfpack)\b",
    "insider_trade": r"\b(insider (buying|selling|buys|sells|purchase|sale)s?|form 4|(ceo|cfo|director|chairman|founder|insider)s? (buys|sells|sold|bought|unloads|dumps|offloads))\b",
}
ANALYST_UP = r"\b(upgrades?|upgraded|fin_pt_up|raises? (its )?price target|to (buy|overweight|outperform))\b"
ANALYST_DOWN = r"\b(downgrades?|downgraded|fin_pt_down|cuts? (its )?price target|to (sell|underweight|underperform|neutral|hold))\b"


# A border of a word of ASCII letters, digits and _, which is what \b means to SQL engines. Java's depends on its version, and takes letters with marks for parts of words.
_IN = "[0-9A-Za-z_]"
_BORDER = f"(?:(?<!{_IN})(?={_IN})|(?<={_IN})(?!{_IN}))"


def _bordered(pattern: str) -> str:
    """The pattern with SQL's borders; one look is enough where the pattern starts or ends with two letters beside it."""
    pattern = re.sub(r"^\\b(?=[A-Za-z]{2})", lambda _: f"(?<!{_IN})", pattern) if "|" not in pattern else pattern
    pattern = re.sub(r"(?<=[A-Za-z]{2})\\b$", lambda _: f"(?!{_IN})", pattern) if "|" not in pattern else pattern
    return re.sub(r"\\(.)", lambda m: _BORDER if m[1] == "b" else m[0], pattern, flags=re.S)


def rewritten(text: Column, phrases: list[tuple[str, str]]) -> Column:
    """The text with each pattern's matches, in any case, replaced by its token, one pattern after the other."""
    out = F.coalesce(text, F.lit(""))
    for pattern, token in phrases:
        out = F.regexp_replace(out, f"(?i){_bordered(pattern)}", f" {token} ")
    return out


def tokens(text: Column, phrases: list[tuple[str, str]]) -> Column:
    # \s has the vertical tab in Java alone
    return F.regexp_extract_all(rewritten(text, phrases), F.lit(TOKEN.replace(r"\s", r"\t\n\f\r ")), F.lit(0))


def _plain(word: Column) -> Column:
    return F.replace(word, F.lit("'"), F.lit(""))


def _kind(low: Column) -> Column:
    """What a token does to those after it: 1 raises, 2 lowers, 3 turns, 4 bars the way; 0 nothing. The word lists have no word in common."""
    plain = _plain(low)
    turns = plain.isin(NEGATE) | (low.endswith("n't") & (F.length(low) - F.length(plain) == 1))
    return F.when(plain.isin(RAISE), 1).when(plain.isin(LOWER), 2).when(turns, 3).when(plain.isin(CONTRAST), 4).otherwise(0)


def _cells(df: DataFrame, text: str, keep: list[str], phrases: list[tuple[str, str]]) -> DataFrame:
    """(row, word, times, extra, n, keep, marks) for each row and distinct word: ``times`` of its valence and ``extra`` of its valence's sign go into the row's sum.

    Each row also has a cell of no word, which alone carries the columns ``keep`` and the marks. Whatever
    holds for a whole text is found before its words part, so the work grows with the number of words.
    Texts are dealt out by row, so that a row's words are counted where they are made.
    """
    rows = df.select(F.monotonically_increasing_id().alias("_row"), *keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).repartition("_row")
    rows = rows.withColumns({"_marks": F.length(F.regexp_replace("_text", "[^!]", "")), "_ws": tokens(F.col("_text"), phrases)})
    alone = lambda w: w.rlike("^[A-Za-z]{2,}$")
    mixed = F.exists("_ws", lambda w: alone(w) & (w == F.upper(w))) & F.exists("_ws", lambda w: alone(w) & (w != F.upper(w)))
    rows = rows.withColumns({"_low": F.transform("_ws", F.lower), "_mixed": mixed})
    turn = F.coalesce(*[F.when(F.array_position("_low", c) > 0, F.array_position("_low", c)) for c in CONTRAST], F.lit(0))
    rows = rows.withColumns({"_turn": turn, "_kinds": F.transform("_low", _kind)})
    steps, size = range(1, len(DECAY) + 1), F.size("_ws")
    back = [F.concat(F.array_repeat(F.lit(0), j + 1), F.slice("_kinds", 1, F.greatest(size - j, F.lit(0)))).alias(f"b{j}") for j in steps]
    zipped = F.arrays_zip(F.array(F.struct(*keep, "_marks")).alias("kept"), F.concat(F.array(F.lit(None).cast("string")), "_ws").alias("w"), *back)
    cells = rows.select("_row", "_mixed", "_turn", F.posexplode(zipped).alias("i", "c"))
    w = F.col("c.w")
    extra, turned, open_ = F.when(F.col("_mixed") & alone(w) & (w == F.upper(w)), CAPITALS).otherwise(0.0), F.lit(False), F.lit(True)
    for j, decay in zip(steps, DECAY, strict=True):
        kind = F.col(f"c.b{j}")
        extra = extra + F.when(open_ & (kind == 1), BOOST * decay).when(open_ & (kind == 2), -BOOST * decay).otherwise(0.0)
        turned, open_ = turned | (open_ & (kind == 3)), open_ & (kind != 4)
    side = F.when(F.col("_turn") == 0, 1.0).when(F.col("i") < F.col("_turn"), 0.5).when(F.col("i") > F.col("_turn"), 1.5).otherwise(1.0)
    cells = cells.select("_row", _plain(F.lower(w)).alias("_key"), (F.when(turned, TURNED).otherwise(1.0) * side).alias("_times"), extra.alias("_extra"), *[F.col(f"c.kept.{k}").alias(k) for k in [*keep, "_marks"]])
    firsts = [F.first(k, ignorenulls=True).alias(k) for k in [*keep, "_marks"]]
    return cells.groupBy("_row", "_key").agg(F.sum("_times").alias("_times"), F.sum(F.col("_times") * F.col("_extra")).alias("_extra"), F.count(F.lit(1)).alias("_n"), *firsts)


def scores(df: DataFrame, text: str, keep: list[str], lexicon: DataFrame, phrases: list[tuple[str, str]] = ()) -> DataFrame:
    """The columns ``keep``, ``n_valued`` (tokens of a valence) and ``compound`` in [-1, 1] for each row; null and valueless texts score 0.

    ``lexicon`` is (word, valence): lower-case words without apostrophes, or a
    phrase's token. Boosters have no valence of their own.
    """
    cells = _cells(df, text, keep, list(phrases))
    words = lexicon.select(F.col("word").alias("_word"), F.col("valence").cast("double").alias("_v")).where(~F.col("word").isin(RAISE + LOWER))
    key = F.coalesce(F.col("_key"), F.concat(F.lit("\0"), F.col("_row")))  # rows of no word don't meet in one task
    hit = cells.withColumns({"_none": F.col("_key").isNull(), "_key": key}).join(words, F.col("_key") == F.col("_word"), "left").where("_word IS NOT NULL OR _none")
    v = F.when(F.col("_word").isNotNull(), F.col("_times") * F.col("_v") + F.col("_extra") * F.when(F.col("_v") > 0, 1.0).otherwise(-1.0)).otherwise(0.0)
    s = hit.groupBy("_row").agg(*[F.first(c, ignorenulls=True).alias(c) for c in [*keep, "_marks"]], F.sum(v).alias("_s"), F.sum(F.when(F.col("_word").isNotNull(), F.col("_n")).otherwise(0)).alias("n_valued"))
    s = s.withColumn("_s", F.when(F.col("_s") != 0, F.col("_s") + F.signum("_s") * F.least("_marks", F.lit(MOST_EXCLAIMED)) * EXCLAIM).otherwise(0.0))
    return s.select(*keep, "n_valued", (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + NORM)).alias("compound"))


def with_label(compound: Column, label: Column) -> Column:
    """A poster's own label in place of the score, where there is one."""
    low = F.lower(label)
    out = F.when(low == "bullish", LABELS["bullish"]).when(low == "bearish", LABELS["bearish"])
    return F.coalesce(out, compound)


def event_tags(text: Column, phrases: list[tuple[str, str]] = (), rules: dict[str, str] = EVENT_RULES) -> Column:
    """The kinds of events that a title tells of, in the rules' order; an analyst's change bears its direction."""
    t = F.array_join(tokens(text, list(phrases)), " ")
    up, down = t.rlike(f"(?i){ANALYST_UP}"), t.rlike(f"(?i){ANALYST_DOWN}")
    name = lambda k: F.when(up & ~down, "analyst_up").when(down, "analyst_down").otherwise("analyst") if k == "analyst" else F.lit(k)
    return F.filter(F.array(*[F.when(t.rlike(f"(?i){rule}"), name(k)) for k, rule in rules.items()]), lambda x: x.isNotNull())
