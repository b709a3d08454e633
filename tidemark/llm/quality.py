"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into a fixed number of bins.
Two multinomials over the bins are counted, one over all documents, one over
documents that labels call good. A document's score is the mean, over its
n-grams, of the log of trusted over raw probability. It is kept if the score
reaches a fixed threshold.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, given, words

#: A power of two.
BINS = 1 << 16
#: Labelled documents of which the trusted multinomial is counted: about so many at most, those of lowest hash.
TRUSTED = 200_000
#: Mean nats per n-gram below which a document is rejected.
THRESHOLD = -0.12
SCALE = 1_000_000


def base_measures(df: DataFrame, text: str = "text", w: str = "_w") -> DataFrame:
    """The input, where ``w`` has the text's words, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t, own = F.coalesce(F.col(text), F.lit("")), F.col(w)
    n = F.size(own)
    grams = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(5)])))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_g": grams, "_lines": lines})
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(own, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    # windows found twice: equal neighbours once sorted; only texts with such a window are sorted
    g = F.col("_g")
    again = F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    df = df.withColumn("_again", again)
    s = F.col("_again")
    same = lambda x, i: F.coalesce(F.get(s, i)["x"] == x["x"], F.lit(False))
    hit = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.withColumn("_hit", F.sort_array(F.transform(hit, lambda x: x["i"])))
    h = F.col("_hit")
    covered = F.aggregate(F.transform(h, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(h, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_g", "_lines", "_again", "_hit")


def _bin(*words_: Column, n: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*words_), 64 - (n.bit_length() - 1)).cast("int")


def weights(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = BINS, trusted: int = TRUSTED) -> list[int]:
    """For each bin the log of trusted over raw probability, add-one smoothed, in millionths.

    Raw counts cover all documents; trusted counts cover the documents whose
    label says quality 1, thinned by hash where more than ``trusted`` are
    labelled so, which bounds the broadcast. Without labels all weights are 0.
    The result has one integer for each bin, whatever the corpus.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    found = good.count()
    if found > trusted:
        good = good.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 32)) < int((1 << 32) * trusted / found))
    good = good.withColumn("_good", F.lit(1))
    slim = docs.select(F.col(f"`{doc_id}`").alias("_id"), words(F.col(f"`{text}`")).alias("_w"))
    flagged = slim.join(F.broadcast(good), "_id", "left")
    pairs = flagged.select("_good", F.inline(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.size("_w")).alias("b")))).toDF("_good", "a", "b")
    pair = F.when(F.col("b").isNotNull(), _bin(F.col("a"), F.col("b"), n=n))  # the last word begins none
    pairs = pairs.select("_good", F.explode(F.array(_bin(F.col("a"), n=n), pair)).alias("bin")).where("bin is not null")
    rows = pairs.groupBy("bin").agg(F.count(F.lit(1)).alias("raw"), F.count("_good").alias("good")).collect()
    raw, target = sum(r.raw for r in rows), sum(r.good for r in rows)
    out = [0] * n
    if target:
        for r in rows:
            out[r.bin] = round(SCALE * (log((r.good + 1) / (target + n)) - log((r.raw + 1) / (raw + n))))
    return out


def score(w: Column, table: list[int]) -> Column:
    """Mean weight, in nats, of a text's n-grams: an exact integer sum over their number; 0 for a text without words."""
    # one constant that the optimizer folds, of as many integers as there are bins
    ratio, n = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"), len(table)
    each = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.get(ratio, _bin(a, n=n)) + F.when(b.isNotNull(), F.get(ratio, _bin(a, b, n=n))).otherwise(F.lit(0).cast("long")))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda x, y: x + y)
    return F.when(F.size(w) > 0, total / ((F.size(w) * 2 - 1) * F.lit(float(SCALE)))).otherwise(F.lit(0.0))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = BINS, trusted: int = TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows with the base measures, base_failed, score and kept.

    Null text has no words and so fails the base rules, as does an empty
    one. Null or unlabelled ids count in the raw multinomial only. Repeated
    rows are judged alike, each on its own. Input columns that bear the name
    of an added one are replaced. An empty table gives an empty result.
    """
    table = weights(docs, labels, text, doc_id, n, trusted)
    t = F.col(f"`{text}`")
    df = base_measures(docs.select(carried(docs), t.alias("text"), words(t).alias("_w")))
    df = df.withColumn("score", F.when(~F.col("base_failed"), score(F.col("_w"), table)))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("score"), F.lit(0.0)) >= threshold))
    return df.select(*given(docs, *ADDED), *ADDED)


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The input's rows, all columns, that ``judge`` keeps."""
    text, doc_id = options.pop("text", "text"), options.pop("doc_id", "doc_id")
    out = judge(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), carried(docs, "document")), labels, **options)
    # a row number in the condition: else the optimizer moves the condition below the measures and writes them out again at each use
    out = out.withColumn("_row", F.monotonically_increasing_id())
    return out.where(F.col("kept") & (F.col("_row") >= 0)).select(*given(docs, name="document"))
