"""Ranked search, language tagging and spelling variants against brute-force versions."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import crf_language, queries, spelling, treap_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SMALL = "/root/testdata/sf0.001"


def _ranked(docs, items, k=10):
    """(item place, rank, doc_id, score) by scoring every document."""
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n, total = sum(1 for _, c in docs if c), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        terms, found = Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c in docs:
            m = 25 + (75 * c.total() * n) // max(total, 1)
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i if i is not None else 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def _random_docs(seed, n):
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("abcdé9"), 3)) for _ in range(60)]
    texts = [" ".join(r.choice(vocabulary, int(r.integers(0, 40)))) for _ in range(n)]
    return [*enumerate(texts), (None, "Straße ABC\tabc-abc"), (None, None), (3, texts[5]), (900, ""), (901, "!?"), (902, " ".join(texts) * 3)], vocabulary


@pytest.mark.parametrize("segment", [treap_search.SEGMENT, 50])
def test_search_against_all_scores(spark, monkeypatch, segment):
    monkeypatch.setattr(treap_search, "SEGMENT", segment)
    monkeypatch.setattr(treap_search, "SLICE", 100)
    rows, vocabulary = _random_docs(1, 300)
    rows += [(1000 + k, rows[7][1]) for k in range(40)]  # copies tie
    r = np.random.default_rng(2)
    items = [(k, " ".join(r.choice(vocabulary, 8)) + " ABC") for k in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (53, "straße STRASSE abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("score", F.lit("x"))
    got = treap_search.search(docs.repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted([(x.item_id, x["rank"], x.doc_id, x.score) for x in got], key=str) == _ranked(rows, items)


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(treap_search, "QUERY_BYTES", 40)
    rows, vocabulary = _random_docs(3, 60)
    items = [(k, " ".join(vocabulary[k : k + 6])) for k in range(9)]
    got = treap_search.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3).collect()
    assert sorted([(x.item_id, x["rank"], x.doc_id, x.score) for x in got], key=str) == _ranked(rows, items, 3)


def test_search_of_nothing(spark):
    none, some = (spark.createDataFrame(r, "doc_id long, text string") for r in ([], [(1, "a b")]))
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert treap_search.search(none, items).collect() == []
    assert treap_search.search(some, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_treaps_are_search_trees_and_heaps():
    r = np.random.default_rng(0)
    pairs = sorted({(int(t), int(p)) for t, p in zip(r.integers(0, 5, 400), r.integers(0, 200, 400), strict=True)})
    term, place = (np.array(x) for x in zip(*pairs, strict=True))
    treaps = treap_search.Treaps(term, place.astype(np.int32), r.integers(1, 20, len(term)), 6)

    def below(node):
        if node == treaps.nil:
            return []
        kids = [c for c in (treaps.left[node], treaps.right[node]) if c != treaps.nil]
        assert all(treaps.impact[c] <= treaps.impact[node] for c in kids)
        return [*below(treaps.left[node]), int(treaps.place[node]), *below(treaps.right[node])]

    for t in range(6):
        assert below(treaps.root[t]) == [p for k, p in pairs if k == t]


def test_walk_prunes():
    """On impacts that fall steeply a walk scores a small part of the documents, and the right ones."""
    n = 4000
    r = np.random.default_rng(4)
    impact = (1e6 * r.random(n) ** 8).astype(np.int64) + 1
    treaps = treap_search.Treaps(np.zeros(n, np.int64), np.arange(n, dtype=np.int32), impact, 1)
    best = treap_search.Best(10)
    assert treap_search.walk(treaps, treaps.root, np.array([3]), list(range(n)), best) < n / 2
    assert [x[2] for x in best.rows] == np.lexsort((np.arange(n), -impact))[:10].tolist()


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _variants(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if abs(len(v) - len(w)) <= 1 and _one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        out[w] = [form, w, n, len(near), counts[form] if form else None]
    for w, x in out.items():
        while out[x[1]][0]:
            x[1] = out[x[1]][0]
    return {w: tuple(x) for w, x in out.items()}


@pytest.mark.parametrize("group,cells,pairs", [(spelling.GROUP, spelling.CELLS, spelling.PAIRS), (3, 40, 50), (1, 1, 1)])
def test_variants_against_all_pairs(spark, monkeypatch, group, cells, pairs):
    """Words over few letters, so that nearly every kind of edit, run of equal letters and tie occurs."""
    for name, value in (("GROUP", group), ("CELLS", cells), ("PAIRS", pairs)):
        monkeypatch.setattr(spelling, name, value)
    r = np.random.default_rng(5)
    counts = {}
    for _ in range(400):
        w = "".join(r.choice(list("abé"), int(r.integers(3, 9))))
        counts[w] = int(10 ** r.integers(0, 5) * r.integers(1, 3))
    counts |= {"x" * 200: 5, "x" * 201: 50, "x" * 100 + "y" + "x" * 100: 1, "q": 1, "ab😀cdefg": 3, "abcdefg": 40}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == _variants(counts) and len(got) == len(counts)


def test_corpus_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    r = np.random.default_rng(6)
    vocabulary = ["".join(r.choice(list("abÉéß×÷Zz"), int(r.integers(5, 12)))) for _ in range(80)]
    rows = [(k, "\n".join(r.choice(vocabulary, 30)) + " fiancée’s naïveté Ωmega_underscored") for k in range(120)] + [(None, "ordinary words ordinary"), (7, None), (8, "")]
    want = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            if len(w) >= 7:
                want[w] += 1
    got = spelling.corpus_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {x.word: x.n for x in got.collect()} == {w: n for w, n in want.items() if n >= 2}
    assert spelling.variants(got.limit(0)).collect() == []


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(7)
    k, active = 3, np.array([3, 2, 2, 1])
    emit, step, first = r.random((8, k)) + 0.1, r.random((k, k)) + 0.1, r.random(k) + 0.1
    ahead, back, _, at = crf_language.forward_backward(emit, active, step, first)
    for chain, length in ((0, 4), (1, 3), (2, 1)):
        rows = [at[t] + chain for t in range(length)]
        want = np.zeros((length, k))
        for path in itertools.product(range(k), repeat=length):
            p = first[path[0]] * np.prod([emit[row, y] for row, y in zip(rows, path, strict=True)]) * np.prod([step[a, b] for a, b in itertools.pairwise(path)])
            want[np.arange(length), path] += p
        assert np.allclose(ahead[rows] * back[rows], want / want.sum(axis=1, keepdims=True))


def test_words_and_features_do_not_depend_on_the_batch():
    assert crf_language.words("L'Été, naïve_2x ß!") == ["l", "été", "naïve", "x", "ß"]
    assert crf_language.words("L'Été, naïve_2x ß! “Ω”") == ["l", "été", "naïve", "x", "ß", "ω"]
    assert crf_language.words("1 ½ ² _ ×") == []
    one, many = crf_language.features(["abc"]), crf_language.features(["abc", "z" * 50, "é"])
    assert sorted(one[0][one[0] < crf_language.BINS]) == sorted(many[0][many[0] < crf_language.BINS])


@pytest.fixture(scope="module")
def tagged(spark):
    return queries.op12_language_crf(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()


def test_language_of_held_out_documents(tagged):
    own = [x for x in tagged if x.held_out]
    assert len(tagged) == 1000 and 200 < len(own) < 300
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in tagged)
    assert sum(x.lang_pred == x.lang for x in own) >= 0.98 * len(own)
    assert all(0 <= x.score <= 1 for x in tagged)


def test_code_switched_text(spark):
    """Runs of two languages in one text are told apart word by word; what has no letter is und."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = crf_language.learn(docs)
    clean = defaultdict(list)
    for x in docs.where("n_chars BETWEEN 300 AND 900").orderBy("doc_id").collect():
        clean[x.lang].append(" ".join(crf_language.words(x.text)[:30]))
    rows = [(k, f"{clean['de'][k]}. {clean['es'][k]}", None) for k in range(10)] + [(100, None, None), (101, "12 !? ½", "en"), (102, "", "x"), (103, clean["fr"][0] + " 漢字 " + "é" * 3000, None)]
    got = {x.doc_id: x for x in crf_language.tag(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), tagger).collect()}
    right = 0
    for k in range(10):
        truth = ["de"] * len(clean["de"][k].split()) + ["es"] * len(clean["es"][k].split())
        guess = [lang for run in got[k].runs for lang in [run.lang] * run.words]
        assert len(guess) == len(truth) == got[k].n_words and [r.start for r in got[k].runs] == np.r_[0, np.cumsum([r.words for r in got[k].runs])[:-1]].tolist()
        right += np.mean([a == b for a, b in zip(guess, truth, strict=True)]) / 10
    assert right > 0.9
    for k in (100, 101, 102):
        assert (got[k].lang_pred, got[k].score, got[k].n_words) == ("und", 0.0, 0)
    assert got[103].lang_pred == "fr"


def test_tagging_by_batches_and_without_labels(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tagger = crf_language.learn(docs)
    whole = {x.doc_id: x for x in crf_language.tag(docs, tagger, runs=False).collect()}
    monkeypatch.setattr(crf_language, "CELLS", 2000)
    monkeypatch.setattr(crf_language, "CACHE", 50)
    again = {x.doc_id: x for x in crf_language.tag(docs.repartition(7), tagger, runs=False).collect()}
    assert whole.keys() == again.keys()
    assert all(whole[i].lang_pred == again[i].lang_pred and whole[i].score == pytest.approx(again[i].score, abs=1e-4) for i in whole)
    none = crf_language.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {x.lang_pred for x in crf_language.tag(docs, none).collect()} == {"und"}
    one = crf_language.learn(docs.where("lang = 'fr'"))
    assert {x.lang_pred for x in crf_language.tag(docs.where("text rlike '[a-z]'"), one).collect()} == {"fr"}
    assert crf_language.tag(docs.limit(0), tagger).collect() == []
