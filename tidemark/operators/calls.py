"""Earnings calls: guidance, forward-looking cues, the question part and topics, all as native expressions over one text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.text import sentences, tokens

# The patterns by which a call's sentences and parts are known.
GUIDANCE = (
    r"\b(guidance|outlook|forecast|full[- ]year|fiscal (year )?20\d\d|fy ?\d{2,4}|we now (expect|anticipate|see|project)|"
    r"expectations? for (the )?(full|fiscal|year|quarter|second half|remainder))\b"
)
DIRECTIONS = {
    "withdraw": r"\b(withdr(aw|aws|awn|awing|ew)|suspend(s|ed|ing)?|pull(s|ed|ing)? (our|its|the) |no longer (provid|giv|offer)|not (providing|issuing|giving) (guidance|an outlook))",
    "raise": r"\b(rais(e|es|ed|ing)|increas(e|es|ed|ing) (our|its|the)|lift(s|ed|ing)?|boost(s|ed|ing)? (our|its|the)|upgrad(e|es|ed|ing)|top end|above (our|the) (prior|previous))\b",
    "lower": r"\b(lower(s|ed|ing)|lower (our|its|the|full|fiscal)|cut(s|ting)? (our|its|the)|reduc(e|es|ed|ing) (our|its|the)|trim(s|med|ming)?|downgrad(e|es|ed|ing)|below (our|the) (prior|previous))\b",
    "reaffirm": r"\b(reaffirm(s|ed|ing)?|reiterat(e|es|ed|ing)|maintain(s|ed|ing)?|confirm(s|ed|ing)?|unchanged|on track|in line with (our|the) (prior|previous))\b",
}
FORWARD = (
    r"\b(will|expect\w*|anticipat\w*|intend\w*|plan(s|ned|ning)?|believ\w*|outlook|guidance|forecast\w*|project(ed|ing|ions?)|"
    r"target\w*|aim(s|ing)?|should|going forward|next (quarter|year)|(full|fiscal)[- ]year|second half|remainder of)\b"
)
QUESTIONS = (
    r"question[- ]and[- ]answer|questions? (and|&) answers?|\bq\s*&\s*a\b|(first|next) question|"
    r"open (it |the call |the line |the lines |the floor )?(up )?(for|to) questions|we will now (begin|take|open)"
)
TOPICS = {
    "AI": r"(?-i:\bAI\b)|artificial intelligence|generative|\bgenai\b|\bllms?\b|machine learning|inference|accelerated computing",
    "pricing": r"\bpric(e|es|ed|ing)\b",
    "demand": r"\bdemand\b|\bbacklog\b|\border(s| book)\b|bookings",
    "margins": r"\bmargins?\b",
    "tariffs": r"\btariffs?\b|\bduties\b|trade (war|policy)",
    "China": r"\bchina\b|\bchinese\b",
    "layoffs": r"\blayoffs?\b|headcount reduction|workforce reduction|job cuts|\brestructuring\b",
    "buyback": r"\bbuybacks?\b|\brepurchas\w*",
    "guidance": r"\bguidance\b|\boutlook\b",
    "capex": r"\bcapex\b|capital expenditure",
    "consumer": r"\bconsumer\b",
    "inventory": r"\binventor(y|ies)\b",
    "competition": r"\bcompetit\w*",
    "FX": r"foreign exchange|\bcurrency\b|\bfx\b",
}


def _at(text: Column, pattern: str) -> Column:
    """Where a pattern first matches, from 1; 0 if nowhere."""
    return F.regexp_instr(text, F.lit(f"(?i)(?:{pattern})"))


def direction(sentence: Column, directions: dict[str, str] = DIRECTIONS) -> Column:
    """Withdrawal above all, then the earlier of a raise and a cut, then a reaffirmation, else a mention."""
    gone, up, down, same = (_at(sentence, directions[k]) for k in ("withdraw", "raise", "lower", "reaffirm"))
    out = F.when(gone > 0, "withdraw").when((up > 0) & ((down == 0) | (up <= down)), "raise").when(down > 0, "lower")
    return out.when(same > 0, "reaffirm").otherwise("mention")


def guidance(df: DataFrame, text: str, key: str, nouns: str = GUIDANCE, directions: dict[str, str] = DIRECTIONS) -> DataFrame:
    """(key, guidance, guidance_score, g_raise, g_lower, g_reaffirm, g_withdraw, g_mention) for each row.

    Counts over the sentences that speak of guidance; any withdrawal decides,
    then the more of raises and cuts (equal: mixed), then a reaffirmation,
    else none, whose score is null as is a null text's.
    """
    said = F.transform(F.filter(sentences(F.coalesce(F.col(text), F.lit(""))), lambda s: _at(s, nouns) > 0), lambda s: direction(s, directions))
    kinds = ("raise", "lower", "reaffirm", "withdraw", "mention")
    own = df.select(key, said.alias("said")).select(key, *[(F.size("said") - F.size(F.array_remove("said", k))).cast("long").alias(f"g_{k}") for k in kinds])
    c = F.col
    what = F.when(c("g_withdraw") > 0, "withdraw").when(c("g_raise") > c("g_lower"), "raise").when(c("g_raise") < c("g_lower"), "lower")
    what = what.when(c("g_raise") > 0, "mixed").when(c("g_reaffirm") > 0, "reaffirm").otherwise("none")
    score = F.when(what == "raise", 1.0).when(what.isin("lower", "withdraw"), -1.0).when(what.isin("reaffirm", "mixed"), 0.0)
    return own.select(key, what.alias("guidance"), score.alias("guidance_score"), *[f"g_{k}" for k in kinds])


def split_qa(text: Column, marker: str = QUESTIONS, least: float = 0.1) -> Column:
    """A struct of prepared remarks and questions, cut at the start of the line with the first marker after that share of the text; no questions (null) without one."""
    start = F.floor(F.length(text) * F.lit(least)).cast("int")
    found = _at(F.substring(text, start + 1, F.length(text)), marker)
    at = start + found - 1
    before = F.substring(text, F.lit(1), at)
    line = F.length(before) - F.instr(F.reverse(before), "\n")
    cut = F.when((F.instr(before, "\n") == 0) | (line < start), at).otherwise(line)
    some = found > 0
    return F.struct(F.when(some, F.substring(text, F.lit(1), cut)).otherwise(text).alias("remarks"), F.when(some, F.substring(text, cut + 1, F.length(text))).alias("questions"))


def call_metrics(df: DataFrame, text: str, key: str, topics: dict[str, str] = TOPICS, cues: str = FORWARD, marker: str = QUESTIONS) -> DataFrame:
    """(key, n_words, fls_per1k, fls_sentence_share, qa_share, topics) for each row.

    topics maps each topic to its mentions; qa_share is the questions' part of
    the characters, null without a marker. A null or empty text has 0 words
    and null rates.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = df.select(F.col(key), t.alias("t"), F.size(tokens(t)).cast("long").alias("n_words"), sentences(t).alias("said"), split_qa(t, marker).alias("parts"))
    count = lambda p: F.regexp_count("t", F.lit(f"(?i)(?:{p})"))
    n, many = F.when(F.col("n_words") > 0, F.col("n_words")), F.when(F.size("said") > 0, F.size("said"))
    named = F.map_from_arrays(F.array(*[F.lit(k) for k in topics]), F.array(*[count(p).cast("long") for p in topics.values()]))
    ahead = F.size(F.filter("said", lambda s: _at(s, cues) > 0))
    share = F.length("parts.questions") / F.length("t")
    return own.select(key, "n_words", F.round(count(cues) * 1000 / n, 6).alias("fls_per1k"), F.round(ahead / many, 6).alias("fls_sentence_share"), F.round(share, 6).alias("qa_share"), named.alias("topics"))
