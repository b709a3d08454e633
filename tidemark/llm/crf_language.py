"""Language of each word by a linear-chain conditional random field, and of each document by its words.

A word's features are its prefixes and suffixes of one to three characters, its
character bigrams and trigrams (ends included), hashed into BINS, and a lexicon:
in which share of its occurrences in the fitting sample it stood in a document
of each language. Transitions between languages are learned too: the training
chains are snippets of documents of changing languages set end to end, which is
what code-switched text looks like. Forward-backward gives every word's
distribution over languages; a document's score for a language is the mean over
its words, the highest wins.

The model is fitted on the driver to a bounded sample: of each language about
FIT_DOCS distinct labelled texts, told by the hash of the text, and of each up
to SNIPPETS snippets of SNIPPET words, spread evenly over the whole text. It
holds BINS x languages numbers and the sample's words. Prediction reads every
word of every text; texts are taken together up to a number of words, so memory
is bounded, and a chain costs time in proportion to its length.

A null text or one without a letter has no word: ``und``, score 0. So has every
text if no row was labelled. Rows are independent: repeats, ties and nulls of
other columns change nothing. Equal scores go to the language first in order.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import carried, given, one_blas_thread

BINS = 1 << 16
#: The fitting sample: texts of each language, snippets of a text, words of a snippet, characters of a word.
FIT_DOCS, SNIPPETS, SNIPPET, FIT_CHARS = 400, 40, 12, 40
#: Training: words of a chain, chains of a step, passes over the sample, rate.
CHAIN, CHAINS, PASSES, RATE = 48, 48, 2, 0.2
#: Numbers (words by languages) that are scored together, words whose emissions are kept, characters of one pass over new words.
CELLS, CACHE, SLAB = 6 << 20, 1 << 18, 1 << 20
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LATIN = bytes(b if chr(b).isalpha() else 32 for b in range(256))
UNKNOWN = "und"


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and the marks on them."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(text)


def features(batch: list[str]) -> np.ndarray:
    """A row of bins for each word, BINS where a row is shorter. Bin of a feature: hash of its kind and characters."""
    size = np.array([len(w) for w in batch])
    width = int(size.max()) + 2
    char = np.zeros((len(batch), width + 1), np.uint64)
    char[:, 1:][np.arange(width)[None, :] < size[:, None]] = np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32)
    two = _mix(char[:, :-1] * np.uint64(0x110000) + char[:, 1:], 2)
    three = _mix((char[:, :-2] * np.uint64(0x110000) + char[:, 1:-1]) * np.uint64(0x110000) + char[:, 2:], 3)
    at = np.arange(width)
    out = [np.where(at[None, :] <= size[:, None], two, BINS), np.where(at[None, : width - 1] < size[:, None], three, BINS)]
    row = np.arange(len(batch))
    head, tail = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
    for k in range(1, 4):
        there = size >= k
        head = head * np.uint64(0x110000) + char[:, min(k, width)]
        tail = tail * np.uint64(0x110000) + char[row, np.maximum(size - k + 1, 0)]
        out += [np.where(there, _mix(head, 10 + k), BINS)[:, None], np.where(there, _mix(tail, 20 + k), BINS)[:, None]]
    return np.concatenate(out, axis=1).astype(np.int32)


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x ^ np.uint64(kind << 56)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)


def forward_backward(emit: np.ndarray, active: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward values and scales of chains laid out by time: at time t the first ``active[t]`` chains have a word.

    ``emit`` holds what the words' scores count, a row each, ``step`` the
    transitions' and ``first`` the start's, all as exponentials. The product of
    both results is each word's distribution.
    """
    ahead, back, scale = np.empty_like(emit), np.ones_like(emit), np.empty(len(emit), emit.dtype)
    at = np.concatenate([[0], np.cumsum(active)]).tolist()
    for t in range(len(active)):
        a, b = at[t], at[t + 1]
        x = emit[a:b] * (ahead[at[t - 1] : at[t - 1] + b - a] @ step if t else first)
        scale[a:b] = x.sum(axis=1)
        np.divide(x, scale[a:b, None], out=ahead[a:b])
    turned = np.ascontiguousarray(step.T)
    for t in range(len(active) - 1, 0, -1):
        a, b = at[t], at[t + 1]
        x = emit[a:b] * back[a:b]
        x /= scale[a:b, None]
        np.matmul(x, turned, out=back[at[t - 1] : at[t - 1] + b - a])
    return ahead, back, scale, np.asarray(at)


class Tagger:
    """The fitted field: weights of bins, of the lexicon's shares, of transitions and of the start."""

    def __init__(self, labels: list[str], lexicon: dict[str, np.ndarray]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.bins, self.shares = np.zeros((BINS + 1, k), np.float32), np.zeros((k, k), np.float32)
        self.steps, self.start = np.zeros((k, k), np.float32), np.zeros(k, np.float32)
        self._cache: dict[str, int] = {}
        self._known = np.zeros((0, k), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}, "_known": self._known[:0]}

    def emissions(self, batch: list[str]) -> np.ndarray:
        """Each word's scores; words of like length are taken together, so that one long word costs only itself."""
        out = np.zeros((len(batch), len(self.labels)), np.float32)
        order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * (len(batch[order[end]]) + 2) <= SLAB:
                end += 1
            part = order[at:end]
            rows = features([batch[i] for i in part])
            total = np.zeros((len(part), len(self.labels)), np.float32)
            for column in rows.T:
                total += self.bins[column]
            out[part] = total
            at = end
        shares = [self.lexicon.get(w) for w in batch]
        some = [i for i, s in enumerate(shares) if s is not None]
        if some:
            out[some] += np.array([shares[i] for i in some], np.float32) @ self.shares
        return out

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """The scores of all words of the texts, one row each, each distinct word's computed once."""
        if len(self._cache) > CACHE:
            self._cache, self._known = {}, self._known[:0]
        cache, new = self._cache, []
        known = len(cache)
        for word in {w for text in texts for w in text}:
            if word not in cache:
                cache[word] = known + len(new)
                new.append(word)
        if new:
            self._known = np.concatenate([self._known, self.emissions(new)])
        get = cache.__getitem__
        return self._known[np.concatenate([np.fromiter(map(get, text), np.int64, len(text)) for text in texts])]

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Every word's distribution over languages, text by text, and where each text's words end; no text is empty."""
        size = np.array([len(x) for x in texts])
        ends = np.cumsum(size)
        score = self.scores(texts)
        order = np.argsort(-size, kind="stable")
        active = np.searchsorted(-size[order], -np.arange(size.max()), side="left")
        # word t of the i-th longest text comes after the words of earlier times and of longer texts
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size))
        time = np.arange(ends[-1]) - np.repeat(ends - size, size)
        to = np.concatenate([[0], np.cumsum(active)[:-1]])[time] + np.repeat(rank, size)
        emit = np.empty_like(score)
        emit[to] = np.exp(score - score.max(axis=1, keepdims=True)) + np.float32(1e-9)
        ahead, back, _, _ = forward_backward(emit, active, *self._odds())
        out = (ahead * back)[to]
        return out / out.sum(axis=1, keepdims=True), ends

    def _odds(self) -> tuple[np.ndarray, np.ndarray]:
        return np.exp(self.steps - self.steps.max()), np.exp(self.start - self.start.max())


def fit(sample: list[tuple[str, list[str]]], seed: int = 5) -> Tagger:
    """The field fitted to snippets (language, words) by stochastic gradient with a rate for each weight."""
    labels = sorted({lang for lang, _ in sample})
    number, counts = {x: i for i, x in enumerate(labels)}, Counter()
    for lang, snippet in sample:
        counts.update((w, number[lang]) for w in snippet)
    lexicon: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(labels), np.float32))
    for (w, lang), n in counts.items():
        lexicon[w][lang] = n
    lexicon = {w: x / (x.sum() + 2) for w, x in lexicon.items() if x.sum() >= 3}
    out = Tagger(labels, lexicon)
    names = list({w for _, snippet in sample for w in snippet})
    place = {w: i for i, w in enumerate(names)}
    if not names:
        return out
    rows = features(names)
    none = np.zeros(len(labels), np.float32)
    share = np.array([lexicon.get(w, none) for w in names], np.float32)
    by_lang = [[np.array([place[w] for w in s]) for lang, s in sample if lang == x and s] for x in labels]
    r, k = np.random.default_rng(seed), len(labels)
    grown = {n: np.full(getattr(out, n).shape, 1e-3, np.float32) for n in ("bins", "shares", "steps", "start")}
    active = np.full(CHAIN, CHAINS)
    total = sum(len(s) for x in by_lang for s in x)
    for _ in range(max(1, -(-PASSES * total // (CHAIN * CHAINS)))):
        word, truth = np.empty((CHAIN, CHAINS), np.int64), np.empty((CHAIN, CHAINS), np.int64)
        for c in range(CHAINS):
            at = 0
            while at < CHAIN:
                lang = r.integers(k)
                snippet = by_lang[lang][r.integers(len(by_lang[lang]))] if by_lang[lang] else np.zeros(0, np.int64)
                snippet = snippet[: CHAIN - at]
                word[at : at + len(snippet), c], truth[at : at + len(snippet), c] = snippet, lang
                at += len(snippet)
        word, truth = word.reshape(-1), truth.reshape(-1)
        score = share[word] @ out.shares
        for column in rows[word].T:
            score += out.bins[column]
        step, first = out._odds()
        emit = np.exp(score - score.max(axis=1, keepdims=True)) + np.float32(1e-9)
        ahead, back, scale, _ = forward_backward(emit, active, step, first)
        off = ahead * back
        off /= off.sum(axis=1, keepdims=True)
        both = step * (ahead[:-CHAINS].T @ (emit * back / scale[:, None])[CHAINS:])
        np.subtract.at(both, (truth[:-CHAINS], truth[CHAINS:]), 1)
        off[np.arange(len(off)), truth] -= 1
        flat = rows[word].reshape(-1)
        bins = np.stack([np.bincount(flat, np.repeat(off[:, j], rows.shape[1]), BINS + 1) for j in range(k)], axis=1).astype(np.float32)
        bins[BINS] = 0
        for name, slope in (("bins", bins), ("shares", share[word].T @ off), ("steps", both), ("start", off[:CHAINS].sum(axis=0))):
            slope = slope / CHAINS
            grown[name] += slope * slope
            getattr(out, name)[...] -= RATE * slope / np.sqrt(grown[name])
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Tagger:
    """The field fitted to a bounded sample of the labelled rows of ``docs``."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = dict(rows.select("lang").groupBy("lang").count().collect())  # a row for each language
    if not counts:
        return fit([])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.create_map(*[F.lit(x) for lang_, n in counts.items() for x in (lang_, FIT_DOCS / n)])[F.col("lang")]
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lists = [], []
            for x, value in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                own = [w for w in words(value.as_py()) if len(w) <= FIT_CHARS]
                starts = range(0, len(own), SNIPPET)
                starts = [starts[i * len(starts) // SNIPPETS] for i in range(SNIPPETS)] if len(starts) > SNIPPETS else starts
                langs += [x] * len(starts)
                lists += [own[a : a + SNIPPET] for a in starts]
            yield pa.RecordBatch.from_arrays([pa.array(langs, arrow.field(0).type), pa.array(lists, arrow.field(1).type)], schema=arrow)

    sample = rows.where(draw < rate).dropDuplicates(["lang", "text"]).mapInArrow(cut, schema)
    found = sorted((x.lang, tuple(x.words)) for x in sample.toLocalIterator())
    return fit([(lang_, list(w)) for lang_, w in found])


def tag(docs: DataFrame, tagger: Tagger, text: str = "text", runs: bool = True) -> DataFrame:
    """All columns, with ``lang_pred``, ``score``, ``n_words``, ``languages`` (each one's share of the words) and ``runs`` of words of one language."""
    share = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    run = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("words", T.LongType())]))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("languages", share), T.StructField("runs", run)]
    frame = docs.select(F.col(text).cast("string").alias("text"), carried(docs))
    schema = T.StructType([frame.schema["row"], *added])
    arrow = to_arrow_schema(schema)
    k = len(tagger.labels)

    def flush(held: list[list[str]], where: list[int], out: dict[int, tuple]) -> None:
        marginal, ends = tagger.marginals(held)
        starts = np.r_[0, ends[:-1]]
        mean = np.add.reduceat(marginal.astype(np.float64), starts, axis=0) / (ends - starts)[:, None]
        best = marginal.argmax(axis=1)
        for i, a, b, m in zip(where, starts.tolist(), ends.tolist(), mean, strict=True):
            top = int(m.argmax())
            found = None
            if runs:
                turn = np.r_[0, 1 + np.flatnonzero(best[a + 1 : b] != best[a : b - 1])]
                found = [{"lang": tagger.labels[best[a + s]], "start": s, "words": n} for s, n in zip(turn.tolist(), np.diff(np.r_[turn, b - a]).tolist(), strict=True)]
            out[i] = (tagger.labels[top], min(1.0, float(m[top])), b - a, [{"lang": x, "share": float(y)} for x, y in zip(tagger.labels, m, strict=True)], found)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in batches:
            out: dict[int, tuple] = {}
            held, where, size = [], [], 0
            for i, value in enumerate(batch.column(0)):
                own = words(value.as_py()) if value.is_valid and k else []
                if own:
                    held.append(own)
                    where.append(i)
                    size += len(own) * k
                if size >= CELLS:
                    flush(held, where, out)
                    held, where, size = [], [], 0
            if held:
                flush(held, where, out)
            rows = [out.get(i, (UNKNOWN, 0.0, 0, [], [] if runs else None)) for i in range(len(batch))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(added)
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(arrow.field(0).type), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]], schema=arrow)

    names = [f.name for f in added]
    return frame.mapInArrow(predict, schema).select(*given(docs, *names), *names)


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of the id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
