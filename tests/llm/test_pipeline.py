"""The pipeline's rows against its five stages in plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from tidemark.llm import bpe, mixing, quality

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base_failed(text):
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, g in enumerate(windows) if often[g] > 1 for k in range(5)}
    return len(w) < 10 or 100 * len(repeated) > 20 * len(w)


def _near(rows):
    """Of texts connected by a Jaccard similarity of five-word shingles of 0.8 the least doc_id's."""
    sets = [set(zip(*[WORD.findall(t)[k:] for k in range(5)], strict=False)) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [r for i, r in enumerate(rows) if root[i] == i]  # rows are in order of doc_id


def _copies(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t))
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
    out = []
    for i, t, s in rows:
        rate = target[s] / size[s]
        draw = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert abs(rate % 1 - draw) > 1e-9  # no draw on the edge
        out += [(i, t, s)] * (math.floor(rate) + (draw < rate - math.floor(rate)))
    return out


def test_pipeline_against_plain_python(spark):
    tiktoken = pytest.importorskip("tiktoken")
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    judged = {x.doc_id: x for x in quality.judge(docs, labels).collect()}
    rows = sorted((x.doc_id, x.text, x.source) for x in docs.collect())
    assert all(judged[i].base_failed == _base_failed(t) for i, t, _ in rows)
    rows = [r for r in rows if not _base_failed(r[1]) and judged[r[0]].score >= quality.THRESHOLD]
    last = {t: i for i, t, _ in rows}
    rows = [r for r in rows if last[r[1]] == r[0]]
    distinct = len(rows)
    rows = _near(rows)
    assert len(rows) < distinct
    rows = _copies(rows)
    own = bpe.kernel(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    want = []
    for i, t, _ in rows:
        ids = np.array(enc.encode_ordinary(t), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, SMALL).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == docs.columns)
