"""Greedy leader de-duplication of titles, in parallel.

Taken in order, a title joins the first leader that it is alike to, or becomes a
leader. The leaders are the lexicographically first maximal independent set of
the likeness graph: in each round those titles without an undecided earlier
neighbour lead, and their neighbours can't. Rounds are written tables. Then each
title takes its first leader.

Equal titles have one leader, so each text is compared once. Texts are alike if
their word sets have a Jaccard similarity of JACCARD, or their characters a
matching ratio (twice the characters in matching blocks over both lengths) of
RATIO. Pairs by words come from a prefix filter: a text only offers its rarest
words, as many as any alike text must meet one of. At this ratio alike texts may
share no run of over two characters, so grams bring nearly all pairs together:
pairs by characters are those of all texts of a block, dealt into cells, two
cells a group, each within bounds that no alike pair breaks (lengths, bigrams,
characters, longest common subsequence) before the ratio itself. Only alike
pairs leave a group, and a group is at most two cells, however large the block.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scratch import Rounds

JACCARD, RATIO = 0.6, 0.85
#: Alike titles are at least this much of each other's length: both lengths l <= m have 2 l / (l + m) >= RATIO.
SHORTEST = RATIO / (2 - RATIO)
#: Texts in a cell, unless a block has too few for SPREAD cells of at least FEWEST.
CELL, SPREAD, FEWEST = 16_384, 8, 1024
#: Pairs at a time for the common subsequence.
BATCH = 200_000

# Words that a normalised title leaves out.
STOP = "a an the to of in on for and or at by with from as is are be its it this that after amid over up down vs".split()


def normalised(title: Column) -> Column:
    """Lower case, without a publisher's name at the end, marks and stop words."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+[-|–]\s+[^-|–]{2,40}$", "")
    words = F.filter(F.split(F.regexp_replace(F.lower(t), r"[^a-z0-9 ]+", " "), r"\s+"), lambda w: (w != "") & ~w.isin(STOP))
    return F.array_join(words, " ")


def _by_words(titles: DataFrame) -> DataFrame:
    """(block, a, b), a before b: texts alike by words."""
    words = F.array_distinct(F.split("t", " "))
    rows = titles.select("block", "k", words.alias("ws")).select("block", "k", (F.size("ws") - F.ceil(F.size("ws") * JACCARD) + 1).alias("keep"), F.explode("ws").alias("word"))
    often = rows.groupBy("block", "word").count()
    place = F.row_number().over(W.partitionBy("block", "k").orderBy("count", "word"))
    rare = rows.join(often, ["block", "word"]).withColumn("place", place).where("place <= keep").select("block", "word", "k")
    left, right = rare.withColumnRenamed("k", "a"), rare.withColumnRenamed("k", "b")
    met = left.join(right, ["block", "word"]).where("a < b").select("block", "a", "b").distinct()
    ta, tb = titles.select("block", F.col("k").alias("a"), F.col("t").alias("ta")), titles.select("block", F.col("k").alias("b"), F.col("t").alias("tb"))
    wa, wb = F.array_distinct(F.split("ta", " ")), F.array_distinct(F.split("tb", " "))
    met = met.join(ta, ["block", "a"]).join(tb, ["block", "b"])
    return met.where(F.size(F.array_intersect(wa, wb)) >= JACCARD * F.size(F.array_union(wa, wb))).select("block", "a", "b")


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the characters of a normalised text (space, 0 to 9, a to z; 37 fills up), and the lengths."""
    size = np.array([len(t) for t in texts])
    table = np.full(128, 37, np.uint8)
    table[[32, *range(48, 58), *range(97, 123)]] = np.arange(37)
    wide = np.frombuffer("".join(t.ljust(size.max(), "\0") for t in texts).encode("ascii"), np.uint8)
    return table[wide].reshape(len(texts), -1), size


def _common(x: np.ndarray, y: np.ndarray, size: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows xs of x and ys of y, whose rows are of lengths size: a bit for each character of x, 64 a word."""
    parts = -(-x.shape[1] // 64)
    masks = np.zeros((len(x), 38, parts), np.uint64)
    for i in range(x.shape[1]):
        masks[np.arange(len(x)), x[:, i], i // 64] |= np.uint64(1) << np.uint64(i % 64)
    masks[:, 37] = 0
    out = np.empty(len(xs), np.int64)
    for at in range(0, len(xs), BATCH):
        p, q = xs[at : at + BATCH], ys[at : at + BATCH]
        v = np.full((parts, len(p)), ~np.uint64(0))
        for i in range(y.shape[1]):
            m, carry = masks[p, y[q, i]], np.zeros(len(p), np.uint64)
            for w in range(parts):
                u = v[w] & m[:, w]
                s = v[w] + u
                t = s + carry
                carry = ((s < u) | (t < s)).astype(np.uint64)
                v[w] = t | (v[w] & ~u)
        out[at : at + BATCH] = sum(np.bitwise_count(~v[w]).astype(np.int64) for w in range(parts))
    return out


def _alike(texts: list[str], first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i before j, of a text in ``first`` and one in ``second`` alike by characters: positions in ``texts``, which are in order, of one cell or of two without a text in common."""
    codes, size = _coded(texts)
    n = np.arange(len(texts))
    bag = np.stack([(codes == c).sum(1) for c in range(37)], 1).astype(np.uint8 if size.max() < 256 else np.int32)
    bits = np.zeros((4, len(texts)), np.uint64)
    for i in range(codes.shape[1] - 1):
        gram = (codes[:, i].astype(np.int64) * 101 + codes[:, i + 1]) % 256
        on = i + 1 < size
        bits[gram[on] // 64, n[on]] |= np.uint64(1) << (gram[on] % 64).astype(np.uint64)
    theirs, lengths, found = bits[:, second], size[second], []
    one = first[0] == second[0]
    for i in first:
        both = size[i] + lengths
        # of both lengths RATIO lies in matching blocks, at most one more than the characters outside: so many bigrams are shared
        shared = (RATIO * 1.5 - 1) * both - 1
        alone = sum(np.bitwise_count(bits[w, i] & ~theirs[w]) for w in range(4))
        others = sum(np.bitwise_count(theirs[w] & ~bits[w, i]) for w in range(4))
        ok = (2 * np.minimum(size[i], lengths) >= RATIO * both - 1e-9) & (alone <= size[i] - 1 - shared + 1e-9) & (others <= lengths - 1 - shared + 1e-9) & ((second > i) | (not one))
        near = second[ok]
        near = near[2 * np.minimum(bag[near], bag[i]).sum(1, dtype=np.int64) >= RATIO * (size[i] + size[near]) - 1e-9]
        found.append(np.stack([np.full(len(near), i), near], 1))
        if sum(map(len, found)) >= BATCH or i == first[-1]:
            x, y = np.concatenate(found).T
            found = []
            ok = 2 * _common(codes, codes, size, x, y) >= RATIO * (size[x] + size[y]) - 1e-9
            for a, b in zip(np.minimum(x, y)[ok].tolist(), np.maximum(x, y)[ok].tolist(), strict=True):
                m = difflib.SequenceMatcher(None, texts[b], texts[a])  # the later one first: the ratio is not symmetric
                if m.quick_ratio() >= RATIO and m.ratio() >= RATIO:
                    yield a, b


def _by_characters(titles: DataFrame) -> DataFrame:
    """(block, a, b), a before b: texts alike by characters, from all pairs of a block, two cells of texts at a time."""
    blocks = titles.groupBy("block").count().select("block", F.greatest(F.ceil(F.col("count") / CELL), F.least(F.ceil(F.col("count") / FEWEST), F.lit(SPREAD))).cast("int").alias("cells"))
    dealt = titles.join(blocks, "block").withColumn("cell", F.expr("CAST(pmod(xxhash64(k), cells) AS INT)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = dealt.select("block", "k", "t", "cell", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"))
    key = titles.schema["k"].dataType.simpleString()

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("k", ignore_index=True)
        low, high = (np.flatnonzero(g["cell"] == g[c]) for c in ("low", "high"))
        got = list(_alike(g["t"].tolist(), low, high)) if len(low) and len(high) else []
        ends = np.array(got, np.int64).reshape(-1, 2)
        return pd.DataFrame({"block": pd.Series([g["block"][0]] * len(got), dtype=object), "a": g["k"].to_numpy()[ends[:, 0]], "b": g["k"].to_numpy()[ends[:, 1]]})

    return dealt.groupBy("block", "low", "high").applyInPandas(pairs, f"block {titles.schema['block'].dataType.simpleString()}, a {key}, b {key}")


def leaders(titles: DataFrame) -> DataFrame:
    """(block, k, leader) for rows of (block, k, title): k is a title's place in its block's order, unique there; leader its first alike leader's, or its own.

    Null and empty normalised titles are alike to none.
    """
    rounds = Rounds(titles.sparkSession, "leaders")
    every = rounds.save(titles.select("block", "k", normalised(F.col("title")).alias("t")), "titles")
    # a later equal title is alike to the same leaders as the first, or to the first itself
    t = rounds.save(every.where("t <> ''").groupBy("block", "t").agg(F.min("k").alias("k")), "texts")
    edges = rounds.save(_by_words(t).union(_by_characters(t)).distinct(), "pairs")
    open_, led = edges, []
    for n in range(1, 10_000):
        if open_.isEmpty():
            break
        later = open_.select("block", F.col("b").alias("a")).distinct()
        first = rounds.save(open_.select("block", "a").distinct().join(later, ["block", "a"], "left_anti"), f"first-{n}")
        led.append(first)
        joined = open_.join(first, ["block", "a"], "left_semi").select("block", "b").distinct()
        rest = open_.join(first, ["block", "a"], "left_anti").join(joined, ["block", "b"], "left_anti")
        rest = rest.join(joined.withColumnRenamed("b", "a"), ["block", "a"], "left_anti")
        open_ = rounds.save(rest.select("block", "a", "b"), f"open-{n}")
        if n > 1:
            rounds.drop(f"open-{n - 1}")
    chosen = t.sparkSession.createDataFrame([], edges.select("block", "a").schema)
    for first in led:
        chosen = chosen.union(first)
    # a title that lost all its earlier neighbours to others leads its own later ones, though it was in no open pair's front
    behind = edges.join(chosen, ["block", "a"], "left_semi").select("block", F.col("b").alias("a")).distinct()
    chosen = rounds.save(edges.select("block", "a").distinct().join(behind, ["block", "a"], "left_anti"), "leaders")
    member = edges.join(chosen, ["block", "a"], "left_semi").groupBy("block", F.col("b").alias("k")).agg(F.min("a").alias("leader"))
    led_by = t.join(member, ["block", "k"], "left").select("block", "t", F.coalesce("leader", "k").alias("leader"))
    return every.join(led_by, ["block", "t"], "left").select("block", "k", F.coalesce("leader", "k").alias("leader"))
