"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, jaccard_join, line_dedup, lm_score, mixing, quality, queries, sharding, token_files, url_filter
from tidemark.llm.common import TIDY, Scratch, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _w string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def _sentence(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(n))


BASE = _sentence(1, 120)
NEAR = BASE + " one more"
LONG = _sentence(2, 9000)
ROWS = [(0, BASE), (1, BASE), (2, NEAR), (3, _sentence(3, 80)), (4, ""), (5, None), (6, LONG), (7, "a b"), (8, "a b"), (8, "a b"), (None, "lost row of text"), (None, None), (9, "Ünïcode  ß \n\n tab\tand\vmore"), (10, "x\nSame line here.\nSame line here!\ny"), (11, "same LINE, here\nother")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b"][k % 3], None, "clash", 1) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 1, 0), (6, 1, 0), (9, 0, 0), (None, 1, None), (1, None, 1)], "doc_id long, quality int, toxic int")


def test_bpe(spark, docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    own = bpe.kernel(RANKS, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = np.random.default_rng(0)
    texts = [t for _, t in ROWS] + ["".join(r.choice(list("ab \n\té1!'s"), 30)) for _ in range(400)] + ["a" * 300, "  lead", "trail  "]
    flat, ends = own.encode(pa.array(texts))
    for t, part in zip(texts, np.split(flat, ends[:-1]), strict=True):
        assert part.tolist() == enc.encode_ordinary(t or "")
        assert own.decode(part).decode() == (t or "")
    got = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert Counter((x.doc_id, x.text or "") for x in got) == Counter((x.doc_id, bytes(x.decoded).decode()) for x in got) == Counter((i, t or "") for i, t in ROWS)
    for x in bpe.round_trip(docs, RANKS, P.PATTERN).collect():
        assert x.decoded_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS}
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def test_exact_dedup(docs, empty):
    count = Counter(t or "" for _, t in ROWS)
    for options in ({}, {"key_bits": 2, "block_bytes": 16}):
        got = exact_dedup.exact_dedup(docs, **options).collect()
        assert len(got) == len(ROWS)
        by = defaultdict(list)
        for x in got:
            by[x.text_sha256].append(x)
        assert {k: len(v) for k, v in by.items()} == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in count.items()}
        for v in by.values():
            assert {x.group_size for x in v} == {len(v)} and sum(x.kept for x in v) == 1
            assert {x.keep_id for x in v} == {max((x.doc_id for x in v if x.doc_id is not None), default=None)}
            assert len({(x.level, x.name) for x in v}) == 1
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(count)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_first_copies(empty).count() == 0


def test_jaccard_join(docs, empty):
    got = jaccard_join.jaccard_join(docs).collect()
    assert len(got) == len(ROWS)
    assert {(x.class_id, x.n_links) for x in got if x.doc_id in (0, 1, 2)} == {(0, 2)}
    assert [x.n_links for x in got if x.doc_id in (3, 4, 5, 6)] == [0] * 4
    assert {x.n_links for x in got if x.doc_id in (7, 8)} == {2}
    assert sum(x.kept for x in got if x.doc_id in (0, 1, 2)) == 1
    assert jaccard_join.jaccard_join(empty).count() == 0
    kept = jaccard_join.keep_representatives(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (0, 1, 2)").count() == 1


def test_jaccard_join_against_all_pairs(spark):
    r = np.random.default_rng(4)
    texts = []
    for k in range(6):
        base = _sentence(100 + k, 150).split()
        for _ in range(12):
            w = list(base)
            for at in r.integers(0, len(w), r.integers(0, 8)):
                w[at] = "edit" + str(r.integers(1e6))
            texts.append(" ".join(w))
    grams = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]
    links = [sum(j != i and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(grams)) for i, a in enumerate(grams)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(jaccard_join.jaccard_join(df).collect())
    assert [x.n_links for x in got] == links
    near = [[j for j, b in enumerate(grams) if len(a & b) / len(a | b) >= 0.8] for a in grams]
    least = list(range(len(grams)))
    for _ in grams:
        least = [min(least[j] for j in js) for js in near]
    assert [x.class_id for x in got] == least and [x.kept for x in got] == [i == c for i, c in enumerate(least)]


def test_components(spark):
    r = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(400 + i, 401 + i) for i in range(60)]
    root = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "test"), "c").collect()
    assert {x.node: x.root for x in got} == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "c").count() == 0


def test_quality(docs, labels, empty):
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(ROWS)
    for x in got:
        t = x.text or ""
        w = WORD.findall(t)
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = Counter(g)
        hit = {i + k for i, y in enumerate(g) if c[y] > 1 for k in range(5)}
        lines = [y for y in t.split("\n") if WORD.search(y)]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(y in "#*$%&|<>" for y in t), len(lines) - len(set(lines)), len(hit))
        assert x.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (x.base_failed and x.kept)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.judge(empty, labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == len(ROWS)


def test_quality_rejects_what_the_trusted_never_say(spark):
    good = [(i, _sentence(i % 7, 60)) for i in range(40)]
    bad = [(100 + i, " ".join(f"{w}***" for w in _sentence(i + 50, 60).split())) for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string"), labels).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    size = defaultdict(int)
    for x in got:
        assert x._size == len(WORD.findall(x.text or "")) and x._copies * x._size <= 2 * x._size
        size[x.source] += x._size
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if per * weight[s] > 2 * size[s]}
        for s in over or open_:
            target[s] = 2.0 * size[s] if over else per * weight[s]
            left -= target[s] if over else 0
        open_ -= over or open_
    assert {x.source: pytest.approx(x._target) for x in got} == target
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    assert mixing.repeat_rows(docs).count() == sum(x._copies for x in got) and mixing.repeat_rows(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_sharding(spark, docs, empty):
    got = sharding.shuffle_shards(docs, Scratch(spark, "t").path("s"), bucket_bytes=2000)
    rows = got.collect()
    assert Counter((x.doc_id, x.text) for x in rows) == Counter(ROWS)
    by = defaultdict(list)
    for x in rows:
        by[x._shard].append(x._slot)
        assert x._grown in (x._shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    out = sharding.shuffle_shards(many, Scratch(spark, "t").path("m"), bucket_bytes=500).orderBy("_shard", "_slot").collect()
    ids = [x.doc_id for x in out if x._shard == 0]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.2 and 400 < len(ids) < 600
    assert sharding.shuffle_shards(empty, Scratch(spark, "t").path("e")).count() == 0


@pytest.mark.parametrize("most", [1, 2, 300, 1 << 40, 1 << 60])
def test_simple8b(most):
    r = np.random.default_rng(most % 97)
    for n in (0, 1, 5, 1023, 1024, 1025, 5000):
        ids = r.integers(0, most, n, dtype=np.uint64)
        ids[r.random(n) < 0.01] = np.uint64(2**64 - 1)
        words, offsets, at, full = token_files.pack(ids)
        assert (token_files.unpack(words, offsets, n, at, full) == ids).all()


@pytest.mark.parametrize("share", [0.0, 0.02, 0.2, 0.9])
def test_simple8b_packs_as_tight_as_the_greedy_choice(share):
    """Dense runs, few or many, among large ids: every word takes the most ids that the first fitting selector allows."""
    r = np.random.default_rng(8)
    ids = np.concatenate([r.integers(0, 1 << int(b), int(r.integers(1, 200))) if r.random() < share else r.integers(0, 1 << 16, 90) for b in r.integers(0, 14, 300)]).astype(np.uint64)
    want = 0
    for a in range(0, len(ids), token_files.BLOCK):
        block, at = ids[a : a + token_files.BLOCK], 0
        while at < len(block):
            at += next(int(n) for n, b in zip(token_files.COUNTS, token_files.BITS, strict=True) if (block[at : at + n] < (1 << int(b))).all())
            want += 1
    words, offsets, at, big = token_files.pack(ids)
    assert len(words) == want and (token_files.unpack(words, offsets, len(ids), at, big) == ids).all()


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = Scratch(spark, "t").path("f")
    token_files.write_token_files(docs, bpe.read_ranks(path), out)
    got = sorted(token_files.read_token_files(spark, out).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    at = 0
    for x in got:
        assert x.start == at
        at += len(x.ids)
    whole = {tuple(t.encode(text or "", add_special_tokens=False).ids + [2]) for _, text in ROWS}
    assert {tuple(x.ids) for x in got} == whole
    sums = {(x.start, x.n_tokens, x.ids_crc32) for x in token_files.checksums(spark, out).collect()}
    assert sums == {(x.start, len(x.ids), zlib.crc32(np.array(x.ids, "<u4").tobytes())) for x in got}
    token_files.write_token_files(empty, bpe.read_ranks(path), out)
    assert token_files.read_token_files(spark, out).count() == 0


def test_token_files_markers(spark):
    """Texts that hold the tokenizer's own markers get the ids of an untouched tokenizer."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [f"{a}{m}{b}" for m in ("<|endoftext|>", "<|startoftext|>") for a in ("Alpha ", "Alpha", "x.", "É", "") for b in (" beta", "beta", "!", "")]
    texts += ["<|endoftext|><|startoftext|>", "<|ENDOFTEXT|>", "<|end oftext|>", " <|endoftext|>  <|endoftext|>\n", "Alpha<|endoftext|>Beta<|startoftext|>, gamma"]
    out = Scratch(spark, "t").path("m")
    token_files.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bpe.read_ranks(path), out)
    got = {x.doc_id: list(x.ids) for x in token_files.read_token_files(spark, out).collect()}
    assert got == {k: t.encode(text, add_special_tokens=False).ids + [2] for k, text in enumerate(texts)}


def test_url_filter(spark):
    log = spark.createDataFrame([("b.com", "add", datetime(2024, 1, 2)), ("B.com", "remove", datetime(2024, 1, 5)), ("x.b.com", "add", datetime(2024, 1, 3)), (None, "add", datetime(2024, 1, 1)), ("c.com", "remove", datetime(2024, 1, 1))], "entry string, action string, at timestamp")
    rows = [("http://b.com/", 1), ("http://b.com/", 2), ("https://u@X.B.com.:80/p", 4), ("https://x.b.com", 6), ("http://b.com", 5), ("http://nob.com", 3), (None, 3), ("b.com", 3), ("http://b.com", None), ("http://c.com", 9)]
    df = spark.createDataFrame([(u, d and datetime(2024, 1, d), 7) for u, d in rows], "url string, fetched_at timestamp, entry int")
    got = [(x._blocked, x._entry) for x in url_filter.filter_urls(df, log).collect()]
    assert Counter(got) == Counter([(True, "b.com"), (True, "x.b.com"), (True, "x.b.com"), *[(False, None)] * 7])
    assert url_filter.filter_urls(df.limit(0), log).count() == 0 and url_filter.filter_urls(df, log.limit(0)).where("_blocked").count() == 0


def test_line_dedup(docs, empty):
    got = {(x.doc_id, x.mark): x for x in line_dedup.line_dedup(docs).collect()}
    ten = next(v for k, v in got.items() if k[0] == 10)
    eleven = next(v for k, v in got.items() if k[0] == 11)
    assert ten.removed_lines == [2] and eleven.removed_lines == [0] and ten.n_lines == 4
    one = next(v for k, v in got.items() if k[0] == 1)
    assert one.n_removed == 1
    clean = {x.doc_id: x.text for x in line_dedup.clean_texts(docs).collect()}
    assert clean[10] == "x\nSame line here.\ny" and clean[11] == "other" and clean[5] is None
    assert line_dedup.line_dedup(empty).count() == 0


def _families(r):
    """Lines of 12 to 600 characters, each family's edited at one place for every 100 characters, some in chains."""
    out = []
    for length in (12, 15, 18, 19, 20, 25, 30, 38, 45, 60, 80, 99, 105, 140, 160, 250, 400, 600):
        for _ in range(2):
            base = _sentence(int(r.integers(1 << 30)), length // 5 + 2)[:length].strip()
            out.append(base)
            for _ in range(5):
                t = list(base)
                for _ in range(int(r.integers(1, max(2, length // 100)))):
                    at = int(r.integers(len(t)))
                    if r.random() < 0.6:  # a few characters at one place: a word changes
                        t[at : at + 4] = r.choice(list("abcdefgh"), int(r.integers(3, 6)))
                    else:
                        t[at : at + 1] = r.choice(list("abcdefgh "), int(r.integers(0, 3)))
                out.append(" ".join("".join(t).split()))
                if r.random() < 0.3:
                    base = out[-1]
    return [x for x in dict.fromkeys(out) if x]


@pytest.mark.parametrize("block", [2, 2048])
def test_line_dedup_against_edit_similarity(spark, monkeypatch, block):
    """Of links by edit similarity alone, with edits strewn over the line, 0.9 at least are found, and groups are what these connect."""
    monkeypatch.setattr(line_dedup, "LINE_BLOCK", block)
    lines = _families(np.random.default_rng(9))
    lines = np.random.default_rng(1).permutation(lines).tolist()
    table = pa.table({"k": range(len(lines)), "t": lines})  # noqa: F841  read by name
    links = duckdb.sql("SELECT a.k, b.k FROM \"table\" a JOIN \"table\" b ON a.k < b.k WHERE abs(len(a.t) - len(b.t)) <= 70 AND levenshtein(a.t, b.t) <= floor(greatest(len(a.t), len(b.t)) * 0.1 + 1e-9)").fetchall()
    assert len(links) > 100
    df = spark.createDataFrame(list(enumerate(lines)), "k long, norm string").withColumn("node", F.unhex(F.md5("norm")))
    keys = defaultdict(set)
    blocks = line_dedup.with_simhash(df).select("k", line_dedup.block_keys().alias("keys"))
    for x in blocks.union(df.where("length(norm) < 20").select("k", line_dedup.deletion_keys(F.col("norm")))).collect():
        keys[x.k] |= {y for y in x["keys"] if y is not None}
    met = [(a, b) for a, b in links if keys[a] & keys[b]]
    assert len(met) >= 0.9 * len(links)

    def roots(edges):
        root = list(range(len(lines)))
        for a, b in edges:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if k == old else k for k in root]
        return root

    found, true = roots(met), roots(links)
    got = {x.doc_id: x.n_removed for x in line_dedup.line_dedup(df.select(F.col("k").alias("doc_id"), F.col("norm").alias("text"))).collect()}
    assert got == {k: int(found[k] != k) for k in range(len(lines))}
    assert sum(got.values()) >= 0.9 * sum(k != root for k, root in enumerate(true))


def _unspaced(r):
    """Lines of 60 Chinese characters, each with copies of which two characters differ."""
    out = []
    for _ in range(15):
        base = r.integers(0x4E00, 0x4E00 + 800, 60)
        out.append("".join(map(chr, base)))
        for _ in range(3):
            t = base.copy()
            t[r.integers(60, size=2)] = r.integers(0x4E00, 0x4E00 + 800, 2)
            out.append("".join(map(chr, t)))
    return list(dict.fromkeys(out))


def test_line_links_by_length(spark):
    """Of links by edit similarity alone 0.9 share a key, over several seeds, in every class of length and without spaces."""
    found, every = Counter(), Counter()
    for seed in (9, 10, 11, 12, 13, None):
        lines = _families(np.random.default_rng(seed)) if seed else _unspaced(np.random.default_rng(1))
        table = pa.table({"k": range(len(lines)), "t": lines})  # noqa: F841  read by name
        links = duckdb.sql("SELECT a.k, b.k, greatest(len(a.t), len(b.t)) FROM \"table\" a JOIN \"table\" b ON a.k < b.k WHERE abs(len(a.t) - len(b.t)) <= 70 AND levenshtein(a.t, b.t) <= floor(greatest(len(a.t), len(b.t)) * 0.1 + 1e-9)").fetchall()
        df = spark.createDataFrame(list(enumerate(lines)), "k long, norm string")
        keys = defaultdict(set)
        for x in line_dedup.with_simhash(df).select("k", line_dedup.block_keys().alias("keys")).union(df.where("length(norm) < 20").select("k", line_dedup.deletion_keys(F.col("norm")))).collect():
            keys[x.k] |= {y for y in x["keys"] if y is not None}
        for a, b, n in links:
            kind = next(top for top in (20, 40, 100, 150, 300, 9999) if n < top) if seed else "unspaced"
            every[kind] += 1
            found[kind] += bool(keys[a] & keys[b])
    assert len(every) == 7 and all(found[k] >= 0.9 * every[k] for k in every), {k: found[k] / every[k] for k in every}


def test_line_similarity_is_that_of_the_distance(spark):
    """Pieces and segments settle pairs as the distance does, whatever the length and script; segments never give less than the distance."""
    r = np.random.default_rng(4)
    lines = [*_families(r), *_unspaced(r), *(x + " " + y for x, y in itertools.pairwise(_families(r)) if len(x) > 200), "ab " * 900, "ab " * 890 + "cd"]
    table = pa.table({"k": range(len(lines)), "t": lines})  # noqa: F841  read by name
    pairs = duckdb.sql("SELECT a.t, b.t FROM \"table\" a JOIN \"table\" b ON a.k <> b.k WHERE abs(a.k - b.k) < 9").fetchall()
    df = spark.createDataFrame(pairs, "x string, y string")
    got = df.select("x", "y", F.levenshtein("x", "y").alias("d"), line_dedup.similar(F.col("x"), F.col("y"), 0.9).alias("similar"), line_dedup._distance_by_segments(F.col("x"), F.col("y")).alias("most")).collect()
    assert all(g.similar == (g.d <= int(max(len(g.x), len(g.y)) * (1 - 0.9) + 1e-9)) and (g.most is None or g.most >= g.d) for g in got)
    assert sum(g.similar and len(g.x) > 200 for g in got) > 100


def test_line_keys_of_short_words_alone(spark):
    """Long lines that share one half of three frequent short words and nothing else meet nowhere; with few words beside it they do."""
    r = np.random.default_rng(5)
    words = {a + b for a in "abcdefghij" for b in "klmnopqrst"} | {"".join(r.choice(list("abcdefgh"), 6)) for _ in range(3000)}
    hashed = spark.createDataFrame([(w,) for w in sorted(words)], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    first = {x.w for x in hashed if (x.h + (1 << 63)) * 12 >> 64 == 0}
    short, rest = sorted(w for w in first if len(w) == 2)[:3], sorted(w for w in words - first if len(w) == 6)
    assert len(short) == 3
    lines = [" ".join([*short, *r.choice(rest, 45, replace=False)]) for _ in range(20)] + [" ".join([*short, x * 160, y * 160]) for x, y in ("uv", "wx")]
    keys = [{y for y in x["keys"] if y is not None} for x in line_dedup.with_simhash(spark.createDataFrame(list(enumerate(lines)), "k long, norm string")).select("k", line_dedup.block_keys().alias("keys")).orderBy("k").collect()]
    assert not any(a & b for a, b in itertools.combinations(keys[:20], 2)) and keys[20] & keys[21]


def test_line_counts_rule_out_no_link(spark):
    r = np.random.default_rng(6)
    lines = [*_families(r), *_unspaced(r), "e" * 900, "e" * 960]
    df = spark.createDataFrame(list(enumerate(lines)), "k long, norm string").select("k", "norm", *line_dedup.counts(F.col("norm")))
    a, b = (df.select([F.col(c).alias(f"{p}_{c}") for c in df.columns]) for p in "ab")
    pairs = a.join(b, F.abs(F.col("a_k") - F.col("b_k")).between(1, 8))
    got = pairs.select(line_dedup.similar(F.col("a_norm"), F.col("b_norm"), 0.9).alias("similar"), line_dedup.may_be_alike("a_", "b_", 0.9).alias("open")).collect()
    assert all(x.open for x in got if x.similar) and sum(x.similar for x in got) > 100 and sum(not x.open for x in got) > 100


def test_line_dedup_leaves_no_shuffle_behind(spark, docs):
    files = lambda: {f.getName() for f in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    sc = spark.sparkContext
    before, setting = files(), spark.conf.get(TIDY)
    line_dedup.line_dedup(docs)
    assert not [f for f in files() - before if f.startswith("shuffle")] and spark.conf.get(TIDY) == setting


def test_line_dedup_normalised(spark):
    lines = ["  A--b  c d, e ", "x", " ", "Ä1  2!", "a b\tc", "a ! b", "ŉ٣-ß", "…a b…", "a\u00a0b  "]
    got = spark.createDataFrame(list(enumerate(lines)), "k long, t string").select(line_dedup.normalised(F.col("t")), F.trim(F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}]+", " "))).collect()
    assert [x[0] for x in got] == [x[1] for x in got]


def test_line_dedup_blocks_hold_still(spark):
    """One word more changes one part at most, and votes are majorities of the words' bits."""
    base = _sentence(4, 90)
    rows = {x.k: x for x in line_dedup.with_simhash(spark.createDataFrame([(0, base), (1, base + " more")], "k long, norm string")).collect()}
    hashed = spark.createDataFrame([(w,) for w in set(base.split())], "w string").select(F.xxhash64("w").alias("h")).collect()
    for p in range(6):
        own = [x.h & (2**64 - 1) for x in hashed if (x.h + (1 << 63)) * 6 >> 64 == p]
        assert rows[0][f"n{p}"] == len(own)
        block = sum(1 << (8 * i + k) for i in range(7) for k in range(4) if 2 * sum(h >> (8 * i + k) & 1 for h in own) > len(own))
        assert rows[0][f"b{p}"] == block


def test_line_dedup_empty_and_clashing(spark, docs):
    odd = docs.select("doc_id", "text", F.lit(1).alias("removed_lines"), F.lit(2).alias("row"), F.lit(3).alias("mark"), F.lit(4).alias("a.b"))
    out = line_dedup.clean_texts(odd)
    assert out.columns == odd.columns and {tuple(x)[2:] for x in out.collect()} == {(1, 2, 3, 4)}


def test_lm_score(spark, docs, empty):
    r = np.random.default_rng(8)
    pattern = ["the", "cat", "sat", "on", "a", "mat"]
    train = [(i, " ".join(pattern[(k + i) % 6] for k in range(120))) for i in range(300)]
    held = [(1000, " ".join(pattern[k % 6] for k in range(120))), (1001, " ".join(r.permutation([pattern[k % 6] for k in range(120)])))]
    got = {x.doc_id: x.mean_log_likelihood for x in lm_score.lm_score(spark.createDataFrame(train + held, "doc_id long, text string"), stride=1, rounds=3).collect()}
    assert got[1000] > got[1001] + 0.5 and got[1000] > -np.log(6)
    out = lm_score.lm_score(docs).collect()
    assert Counter((x.doc_id, x.n_tokens) for x in out) == Counter((i, len(WORD.findall(t or ""))) for i, t in ROWS)
    assert lm_score.lm_score(empty).count() == 0


def test_lm_score_trains_on_every_position(spark):
    """With the query's own parameters: what stands only at places 3, 19, 35, ... is learnt."""
    r = np.random.default_rng(8)
    text = lambda right: " ".join(w for x in r.integers(0, 2, 8) for w in ["f", "f", "ab"[x], "pq"[x if right else 1 - x], *"f" * 12])
    rows = [(k, text(True)) for k in range(600)] + [(1000, text(True)), (1001, text(False))]
    got = {x.doc_id: x.mean_log_likelihood for x in lm_score.lm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1000] - got[1001]) * 16 > 1


@pytest.mark.parametrize("safe", [60.0, 0.0])
def test_lm_network_against_plain_sums(monkeypatch, safe):
    """A step and the log-probabilities after it, with logits shifted or not, against gradients written out in double precision."""
    monkeypatch.setattr(lm_score, "SAFE", safe)
    r = np.random.default_rng(3)
    around, target = r.integers(0, lm_score.CLASSES + 1, (50, 2 * lm_score.SIDE)), r.integers(0, lm_score.CLASSES, 50)
    net = lm_score.Network()
    v = {k: getattr(net, k).astype(float) for k in net.SHAPES}

    def forward():
        x = v["embed"][around].reshape(50, -1)
        h = np.tanh(x @ v["w"] + v["b"])
        z = h @ v["out"] + v["bias"]
        return x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    x, h, z = forward()
    d = (np.exp(z) - np.eye(lm_score.CLASSES)[target]) * lm_score.RATE / 50 * 8
    dh = d @ v["out"].T * (1 - h * h)
    dx = (dh @ v["w"].T).reshape(50, 2 * lm_score.SIDE, -1)
    for k, g in {"out": h.T @ d, "bias": d.sum(axis=0), "w": x.T @ dh, "b": dh.sum(axis=0)}.items():
        v[k] -= g
    np.subtract.at(v["embed"], around, dx)
    net.fit(around, target)
    assert all(np.allclose(getattr(net, k), v[k], atol=1e-5) for k in v)
    assert np.allclose(net.log_prob(around, target), forward()[2][np.arange(50), target], atol=1e-4)


def test_lm_tokens_are_hashes_of_the_words():
    texts = pa.array(["left out", None, "", "  a\tÜber a ", "Über", "\u00a0x"])
    want = [[xxhash.xxh3_64_intdigest(w) >> 48 for w in WORD.findall(t or "")] for t in texts.to_pylist()]
    assert [x.tolist() for x in lm_score.tokens(texts)] == want
    assert [x.tolist() for x in lm_score.tokens(texts.slice(1, 4))] == want[1:5] and lm_score.tokens(texts.slice(0, 0)) == []


def test_lm_score_rare_words_have_context(spark):
    """Two rare words of one class and one frequency are told apart by the word before."""
    common = [f"c{k}" for k in range(200)]
    bin_of = lambda w: int(lm_score.tokens(pa.array([w]))[0][0])
    used = {bin_of(w) for w in [*common, "left", "right"]}
    rare = [w for w in (f"r{k}" for k in range(3000)) if bin_of(w) not in used]
    a, b = next((x, y) for x in rare[:1] for y in rare[1:] if (bin_of(x) - bin_of(y)) % 32 == 0 and bin_of(x) != bin_of(y))
    rows = [(k, " ".join(common)) for k in range(60)] + [(100 + k, f"left {a}" if k % 2 else f"right {b}") for k in range(40)]
    rows += [(1000, f"left {a}"), (1001, f"left {b}"), (1002, f"right {a}"), (1003, f"right {b}")]
    got = {x.doc_id: x.log_likelihood for x in lm_score.lm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] > got[1001] + 0.5 and got[1003] > got[1002] + 0.5


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    rel = con.sql(queries.oracle_sql()[name])
    order = sorted(got.columns)
    assert sorted(rel.columns) == order
    assert sorted(map(str, (tuple(x[c] for c in order) for x in got.collect()))) == sorted(map(str, (tuple(x[rel.columns.index(c)] for c in order) for x in rel.fetchall())))


def test_links_across_blocks():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 60 - k % 9], rng.integers(0, 1 << 62, k % 5).astype(np.uint64)])) for k in range(40)]
    whole = jaccard_join._links(sets, 0.8)
    assert whole.any() and not whole.all()
    across = jaccard_join._links(sets, 0.8, 15)
    own = np.arange(40) < 15
    assert (across == (whole & (own[:, None] != own[None, :]))).all()


def test_links_from_differences():
    """Sets given by what they differ in from a head, and sets given whole, have the same links as whole sets."""
    rng = np.random.default_rng(8)
    head = np.unique(rng.integers(0, 1 << 62, 50).astype(np.uint64))
    pool = np.unique(rng.integers(0, 1 << 62, 12).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(head)[: 50 - int(rng.integers(0, 9))], rng.permutation(pool)[: int(rng.integers(0, 9))]])) for _ in range(40)]
    given, minus, common = [], [], []
    for i, s in enumerate(sets):
        lacks = np.setdiff1d(head, s)
        common.append(len(head) - len(lacks))
        minus.append(-1 if i % 7 == 3 else len(lacks))
        given.append(s if i % 7 == 3 else np.concatenate([lacks, np.setdiff1d(s, head)]))
    want = np.array([[i != j and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert want.any() and not want.all()
    assert (jaccard_join._links(given, 0.8, None, np.array(minus), np.array(common), len(head)) == want).all()
    own = np.arange(40) < 15
    across = jaccard_join._links(given, 0.8, 15, np.array(minus), np.array(common), len(head))
    assert (across == (want & (own[:, None] != own[None, :]))).all()


def test_links_with_an_empty_block(spark, monkeypatch):
    """Clusters of 3 and 4 sets that their bytes split into blocks, some of them empty: each link counts once."""
    sets = [np.arange(60, dtype=np.uint64)] * 3
    assert not jaccard_join._links(sets, 0.8, 0).any() and not jaccard_join._links(sets, 0.8, 3).any()
    monkeypatch.setattr(jaccard_join, "VERIFY_BYTES", 1200)
    rows = []
    for f in range(24):
        base = _sentence(300 + f, 100).split()
        rows += [(10 * f + k, " ".join(base + [f"end{f}x{k}"])) for k in range(3 + f % 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard_join.jaccard_join(df).collect()}
    assert got == {i: (i // 10 * 10, 2 + i // 10 % 2) for i, _ in rows}


NAMES = ["_mix", "_base", "_bucket", "_place", "_rate", "_k", "_key", "_spans", "_hit", "_g", "_lines", "_again", "_own", "_id", "_mark", "row", "rows", "at", "source_size", "bin", "text_", "a.b"]


@pytest.mark.parametrize("apply", ["shard", "mix", "repeat", "urls", "judge", "keep"])
def test_clashing_columns_pass_through(spark, labels, apply):
    """Columns named as the operators' own helpers, and one with a dot, come back with their values."""
    rows = spark.createDataFrame([(k, _sentence(k, 30), "s", f"http://h{k}.com/") for k in range(4)], "doc_id long, text string, source string, url string")
    df = rows.select("*", *[(F.col("doc_id") * 100 + n).alias(name) for n, name in enumerate(NAMES)]).withColumn("fetched_at", F.lit("2024-01-02").cast("timestamp"))
    log = spark.createDataFrame([("h1.com", "add", datetime(2024, 1, 1))], "entry string, action string, at timestamp")
    ops = {"shard": lambda: sharding.shuffle_shards(df, Scratch(spark, "t").path("c")), "mix": lambda: mixing.mix(df), "repeat": lambda: mixing.repeat_rows(df), "urls": lambda: url_filter.filter_urls(df, log), "judge": lambda: quality.judge(df, labels), "keep": lambda: quality.keep_good(df, labels, threshold=-99.0)}
    out = ops[apply]()
    assert set(df.columns) <= set(out.columns)
    own = [n for n in NAMES if (apply, n) != ("mix", "_rate")]  # which mix adds itself
    got = {(x["doc_id"], *[x[n] for n in own]) for x in out.collect()}
    assert got == {(k, *[k * 100 + NAMES.index(n) for n in own]) for k in range(4)}


def test_shards_by_highest_hash(spark, docs):
    """shard_of and the grown shard against the hashes themselves."""
    hashes = docs.select("doc_id", F.array(*[F.xxhash64(F.lit(sharding.SEED), F.col("doc_id"), F.lit(j)) for j in range(9)]).alias("h"), sharding.shard_of(F.col("doc_id"), 8).alias("s"), sharding.shard_of(F.col("doc_id"), 9).alias("g"))
    for x in hashes.collect():
        assert x.s == max(range(8), key=lambda j: x.h[j]) and x.g == max(range(9), key=lambda j: x.h[j])


def test_quality_scores_against_counts(spark, docs, labels):
    """score and kept recomputed from the words, with Spark's hash for the bins only."""
    got = quality.judge(docs, labels).collect()
    texts = [WORD.findall(t or "") for _, t in ROWS]
    grams = lambda w: [(x,) for x in w] + list(zip(w, w[1:], strict=False))
    known = sorted({g for w in texts for g in grams(w)}, key=str)
    one = spark.createDataFrame([(k, *g, *[None] * (2 - len(g))) for k, g in enumerate(known)], "k int, a string, b string")
    bins = {known[x.k]: x.bin for x in one.select("k", F.when(F.col("b").isNull(), quality._bin(F.col("a"), n=quality.BINS)).otherwise(quality._bin(F.col("a"), F.col("b"), n=quality.BINS)).alias("bin")).collect()}
    raw, good = Counter(), Counter()
    for (i, _), w in zip(ROWS, texts, strict=True):
        raw.update(bins[g] for g in grams(w))
        good.update(bins[g] for g in grams(w) if i in (0, 3, 6))
    n, total, trusted = quality.BINS, sum(raw.values()), sum(good.values())
    table = {b: round(1e6 * (np.log((good[b] + 1) / (trusted + n)) - np.log((raw[b] + 1) / (total + n)))) for b in raw}
    for x in got:
        w = WORD.findall(x.text or "")
        if not x.base_failed:
            want = sum(table[bins[g]] for g in grams(w)) / (2 * len(w) - 1) / 1e6
            assert x.score == pytest.approx(want) and x.kept == (want >= quality.THRESHOLD)


def test_one_kept_in_each_class(spark, docs):
    got = jaccard_join.jaccard_join(docs).collect()
    kept = Counter(x.class_id for x in got if x.kept and x.doc_id in (7, 8))
    assert kept == {7: 1}
    assert jaccard_join.keep_representatives(docs).where("doc_id in (7, 8)").count() == 1
