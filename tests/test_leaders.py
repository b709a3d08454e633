"""Leaders of titles against the sequential loop."""

import difflib
import re

import numpy as np
import pytest

from tidemark.operators import leaders as L


def _norm(t):
    t = re.sub(r"\s+[-|–]\s+[^-|–]{2,40}$", "", t or "")
    return " ".join(w for w in re.sub(r"[^a-z0-9 ]+", " ", t.lower()).split() if w not in L.STOP)


def _alike(later, earlier):
    if not later or not earlier:
        return False
    a, b = set(later.split()), set(earlier.split())
    return len(a & b) / len(a | b) >= L.JACCARD or difflib.SequenceMatcher(None, later, earlier).ratio() >= L.RATIO


def _loop(rows):
    led, out = {}, {}
    for block, k, title in sorted(rows, key=lambda r: (r[0], r[1])):
        n = _norm(title)
        hit = next((lead for lead, m in led.setdefault(block, []) if _alike(n, m)), None)
        out[block, k] = k if hit is None else hit
        if hit is None:
            led[block].append((k, n))
    return out


def _titles(seed, n):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcdefgh"), int(r.integers(1, 9)))) for _ in range(40)]
    out = []
    for _ in range(n):
        kind = r.integers(4) if out else 0
        if kind == 0:
            t = " ".join(r.choice(words, int(r.integers(1, 12))))
        else:  # an earlier one with letters or words changed, so that chains of likeness run through a block
            t = list(out[r.integers(len(out))])
            for _ in range(int(r.integers(0, 4))):
                t[r.integers(len(t)) : r.integers(len(t)) + 1] = r.choice(list("abcdefgh "), int(r.integers(0, 3)))
                t = t or ["a"]
            t = "".join(t)
        out.append(t)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_against_the_loop(spark, seed):
    """One hot block of half the titles, others small; repeated, empty and null titles."""
    rows = [("hot" if i % 2 else f"b{i % 7}", i, t) for i, t in enumerate(_titles(seed, 400))]
    rows += [("hot", 1000, None), ("hot", 1001, ""), ("hot", 1002, "the of"), ("b0", 1003, "Fed holds rates steady - CNBC"), ("b0", 1004, "Fed holds rates steady"), ("b0", 1005, rows[0][2]), ("b0", 1006, "bitcoin"), ("b0", 1007, "bitcoins")]
    got = L.leaders(spark.createDataFrame(rows, "block string, k long, title string").repartition(3)).collect()
    assert {(x.block, x.k): x.leader for x in got} == _loop(rows) and len(got) == len(rows)


def test_a_chain_alternates(spark):
    """In a chain where only neighbours are alike every other title leads."""
    base = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [("x", i, (base * 3)[i * 3 : i * 3 + 30]) for i in range(20)]
    got = {x.k: x.leader for x in L.leaders(spark.createDataFrame(rows, "block string, k long, title string")).collect()}
    assert got == {k: v for (_, k), v in _loop(rows).items()} and len(set(got.values())) > 5


def test_no_titles(spark):
    assert L.leaders(spark.createDataFrame([], "block string, k long, title string")).collect() == []


def test_copies_write_no_pairs(spark, monkeypatch):
    """2,000 copies of one title: no pair of them is written, where each of the two million was."""
    rows = [("x", i, "a long title that many pages share between them") for i in range(2000)] + [("x", 2000, "something else entirely"), ("y", 0, "a long title that many pages share between them")]
    pairs = []

    class Counted(L.Rounds):
        def save(self, df, name):
            out = super().save(df, name)
            if name == "pairs":
                pairs.append(out.count())
            return out

    monkeypatch.setattr(L, "Rounds", Counted)
    got = {(x.block, x.k): x.leader for x in L.leaders(spark.createDataFrame(rows, "block string, k long, title string")).collect()}
    assert got == {(b, k): 0 if k < 2000 else k for b, k, _ in rows} and pairs == [0]


def test_common_subsequences(spark):
    """Bit rows against the table, over one word of bits and more, where carries run on."""
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("ab c"), int(r.integers(1, 150)))) for _ in range(60)] + ["a" * 64, "a" * 128, "b", "ab" * 70]

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    codes, size = L._coded(texts)
    x, y = np.triu_indices(len(texts))
    assert L._common(codes, codes, size, x, y).tolist() == [table(texts[i], texts[j]) for i, j in zip(x, y, strict=True)]


def test_no_alike_pair_is_lost_in_cells(spark, monkeypatch):
    monkeypatch.setattr(L, "FEWEST", 30)
    rows = [("x", i, t) for i, t in enumerate(_titles(3, 300))]
    got = L.leaders(spark.createDataFrame(rows, "block string, k long, title string").repartition(3)).collect()
    assert {(x.block, x.k): x.leader for x in got} == _loop(rows)
