"""Text measures of the news and earnings side: tokens, tone, slugs, markup, sentences, novelty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z][A-Za-z'\-]*"
#: Tokens within which a negator turns a positive word.
REACH = 3
#: Pairs of rows that share a token for one task of ``novelty``, at most about half of these in fact.
PAIRS = 4_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"))


def tone(df: DataFrame, text: str, key: str, positive: list[str], negative: list[str], negators: list[str]) -> DataFrame:
    """(key, n_tokens, n_pos, n_neg, net_tone): a positive word within REACH tokens after a negator counts as negative.

    Words that end in * match by prefix. Tokens are exploded once and counted by one group-by on the key.
    """

    def hit(words: list[str]) -> Column:
        exact, stems = [w for w in words if not w.endswith("*")], [w[:-1] for w in words if w.endswith("*")]
        out = F.col("t").isin(*exact) if exact else F.lit(False)
        for s in stems:
            out = out | F.col("t").startswith(s)
        return out

    t = df.select(F.col(key), tokens(F.col(text)).alias("ts"))
    t = t.select(key, "ts", F.posexplode_outer("ts").alias("i", "t"))
    near = F.slice("ts", F.greatest(F.col("i") + 1 - REACH, F.lit(1)), F.least(F.col("i"), F.lit(REACH)))
    turned = F.arrays_overlap(near, F.array(*[F.lit(w) for w in negators]))
    pos, neg = F.coalesce(hit(positive), F.lit(False)), F.coalesce(hit(negative), F.lit(False))
    t = t.select(key, F.col("t").isNotNull().alias("is"), (pos & ~F.coalesce(turned, F.lit(False))).alias("p"), (neg | (pos & F.coalesce(turned, F.lit(False)))).alias("n"))
    out = t.groupBy(key).agg(F.count_if("is").alias("n_tokens"), F.count_if("p").alias("n_pos"), F.count_if("n").alias("n_neg"))
    return out.withColumn("net_tone", F.round((F.col("n_pos") - F.col("n_neg")) * 100 / F.when(F.col("n_tokens") > 0, F.col("n_tokens")), 6))


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments out, block ends as line ends, tags out, spaces collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|li|tr|h[1-6]|table|ul|ol|section|article)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(to))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def slug(url: Column) -> Column:
    """The path segment with most words (the first on ties), words parted by spaces, its extension off."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+/([^?#]*)", 1)
    parts = F.transform(F.split(path, "/"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\.\w+$", ""), r"[-_+]+", " ")))
    counted = F.transform(parts, lambda p, i: F.struct(F.size(F.split(p, " ")).alias("n"), (-i).alias("at"), p.alias("p")))
    return F.array_max(counted)["p"]


def sentences(text: Column) -> Column:
    """Cut after an end mark before a capital or digit, and at blank lines; pieces of over 3 characters."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[\p{Lu}\d\"'])|\n\s*\n"), lambda s: F.length(F.trim(s)) > 3)


def novelty(df: DataFrame, symbol: str, time: str, text: str, key: str, days: int = 5) -> DataFrame:
    """(key, novelty): 1 less the highest cosine of token sets with an earlier row of the symbol within so many days.

    A band join: rows meet on (symbol, day bucket, token), so only rows that share a token and may lie in the window are paired.
    Tasks are as many as the pairs ask for, which are counted first by their keys, so a task's table of pairs stays of one size.
    """
    t = df.select(F.col(symbol).alias("s"), F.col(time).alias("at"), F.col(key).alias("k"), F.array_distinct(tokens(F.col(text))).alias("ts"))
    t = t.withColumns({"n": F.size("ts"), "day": F.floor(F.unix_seconds("at") / (86400 * days))})
    now = t.select("s", "day", "at", "k", "n", F.explode("ts").alias("t"))
    bound = now.groupBy("s", "day", "t").count().agg(F.sum(F.col("count").cast("double") * F.col("count") * 2)).first()[0] or 0
    tasks = int(bound // PAIRS) + 1
    old = t.select("s", F.explode(F.array(F.col("day"), F.col("day") + 1)).alias("day"), F.col("at").alias("at0"), F.col("k").alias("k0"), F.col("n").alias("n0"), "ts")
    old = old.select("s", "day", "at0", "k0", "n0", F.explode("ts").alias("t"))
    meet = ["s", "day", "t"]
    pair = now.repartition(tasks, *meet).join(old.repartition(tasks, *meet), meet).where((F.struct("at0", "k0") < F.struct("at", "k")) & (F.unix_seconds("at") - F.unix_seconds("at0") <= 86400 * days))
    pair = pair.select("k", "k0", "n", "n0").repartition(tasks, "k")
    near = pair.groupBy("k", "k0").agg((F.count(F.lit(1)) / F.sqrt(F.first("n").cast("double") * F.first("n0"))).alias("cos")).groupBy("k").agg(F.max("cos").alias("c"))
    return t.join(near, "k", "left").select(F.col("k").alias(key), F.round(1 - F.coalesce("c", F.lit(0.0)), 6).alias("novelty"))
