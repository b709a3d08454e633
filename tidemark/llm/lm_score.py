"""Masked pseudo-likelihood of documents under a small bidirectional network.

Words are hashed into BINS tokens, and tokens into classes: the most frequent
have one each, the others share. A network sees the classes of the two tokens
before and the two after a masked one (embeddings, one hidden layer) and
predicts its class. The token within its class follows the corpus counts next
to the token before and next to the one after, half each; for these the most
frequent tokens are a context each, the other classes share some, and the counts
are smoothed by the class's own. A document's score is the sum over its tokens of the
log-probability of each given both sides.

All documents are counted, and every position of theirs gives a training window
in each round: each task fits the network to its own windows, and the weights of
all tasks are averaged by their number of windows, for some rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .common import Scratch, one_blas_thread

BINS = 1 << 16
CLASSES, OWN = 128, 96
EDGE = CLASSES  # what stands beyond a text's ends
SIDE, WIDTH, HIDDEN = 2, 12, 24
STRIDE, ROUNDS, BATCH, RATE = 1, 2, 256, 0.1
#: What a neighbour counts as within a class: one of the most frequent tokens, a share of the other classes, an edge (the last); and the weight of the class's own counts.
CONTEXTS, PRIOR = 32, 8.0
CONTEXT = np.concatenate([np.arange(16), 16 + np.arange(16, CLASSES) % (CONTEXTS - 17), [CONTEXTS - 1]])
SLICE = 1 << 15
#: Places in one pass through the network when scoring.
ROWS = 1 << 10
#: Logits whose exponentials, and their sum over classes, stay within single precision.
SAFE = 60.0
ALL = np.ones(CLASSES, np.float32)
#: The cells of each class's embedding.
CELLS = np.arange((CLASSES + 1) * WIDTH).reshape(CLASSES + 1, WIDTH)


def tokens(texts: pa.Array) -> list[np.ndarray]:
    """The hashed words of each text; null gives none."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = (np.asarray(cut.offsets) - cut.offsets[0].as_py()).tolist()
    code = cut.flatten().dictionary_encode()
    names = code.dictionary
    at = np.frombuffer(names.buffers()[1], np.int64, len(names) + 1, names.offset * 8).tolist() if len(names) else [0]
    raw = memoryview(names.buffers()[2] or b"")
    bin_ = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) >> 48 for a, b in pairwise(at)], np.uint16)
    full = np.diff(at) > 0
    codes = code.indices.to_numpy(zero_copy_only=False)
    return [bin_[c[full[c]]] if len(c) else np.array([], np.uint16) for c in (codes[a:b] for a, b in zip(offsets, offsets[1:], strict=False))]


class Network:
    """Embeddings of the tokens around, one hidden layer, a softmax over classes."""

    SHAPES = {"embed": (CLASSES + 1, WIDTH), "w": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,), "out": (HIDDEN, CLASSES), "bias": (CLASSES,)}

    def __init__(self, flat: np.ndarray | None = None, seed: int = 3):
        sizes = [int(np.prod(s)) for s in self.SHAPES.values()]
        if flat is None:
            r = np.random.default_rng(seed)
            flat = np.concatenate([r.normal(0, 0.3 if len(s) > 1 else 0.0, int(np.prod(s))) for s in self.SHAPES.values()])
        self.flat = np.array(flat, np.float32)
        for (name, shape), part in zip(self.SHAPES.items(), np.split(self.flat, np.cumsum(sizes)[:-1]), strict=True):
            setattr(self, name, part.reshape(shape))

    def _forward(self, around: np.ndarray):
        """Inputs by row; hidden values and logits by column, where sums over classes run along memory."""
        x = self.embed.take(around, axis=0).reshape(len(around), -1)
        h = self.w.T @ x.T
        h += self.b[:, None]
        np.tanh(h, out=h)
        z = self.out.T @ h
        z += self.bias[:, None]
        if (np.abs(self.out).sum(axis=0) + np.abs(self.bias)).max() > SAFE:
            z -= z.max(axis=0)
        return x, h, z

    def log_prob(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target))
        for x in range(0, len(target), ROWS):  # so many logits stay in the core's cache
            own = slice(x, x + ROWS)
            z = self._forward(around[own])[2]
            at = z[target[own], np.arange(z.shape[1])]
            out[own] = at - np.log(ALL @ np.exp(z, out=z))
        return out

    def fit(self, around: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
        """One step of gradient descent on a batch."""
        x, h, p = self._forward(around)
        np.exp(p, out=p)
        total = ALL @ p
        p[target, np.arange(len(target))] -= total
        # each place's share is divided by its total not over all classes, but where these are summed up
        share = np.float32(rate / len(target) * 8) / total
        d = self.out @ p
        d *= share
        d *= 1 - h * h
        dx = d.T @ self.w.T
        h *= share
        self.out -= h @ p.T
        self.bias -= p @ share
        self.w -= x.T @ d.T
        self.b -= d.sum(axis=1)
        cell = CELLS.take(around, axis=0)
        self.embed -= np.bincount(cell.ravel(), dx.ravel(), minlength=self.embed.size).reshape(self.embed.shape)


def windows(classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The classes of the SIDE tokens before and after each place."""
    padded = np.concatenate([np.full(SIDE, EDGE), classes, np.full(SIDE, EDGE)])
    return padded[at[:, None] + np.array([k for k in range(2 * SIDE + 1) if k != SIDE])]


def _within(encoded: DataFrame, held, counts: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """The probability of each bin in its class: one row for each side, in it one value for each bin and context."""
    cells = BINS * CONTEXTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * cells, np.int64)
        for b in batches:
            raw = [np.frombuffer(x, np.uint16) for x in b.column("bins").to_pylist()]
            ends = np.cumsum([len(x) for x in raw if len(x)])
            if not len(ends):
                continue
            bins = np.concatenate(raw).astype(np.int64)
            context = CONTEXT[held.value[bins]]
            left, right = np.roll(context, 1), np.roll(context, -1)
            right[ends - 1] = left[np.concatenate([[0], ends[:-1]])] = CONTEXTS - 1
            for part, context in ((total[:cells], left), (total[cells:], right)):
                cell = bins * CONTEXTS + context
                if len(cell) > cells // 8:  # counting over all cells then costs less than sorting
                    part += np.bincount(cell, minlength=cells)
                else:
                    cell, n = np.unique(cell, return_counts=True)
                    part[cell] += n
        some = np.flatnonzero(total)
        for x in range(0, len(some), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(some[x : x + SLICE], pa.int32()), pa.array(total[some[x : x + SLICE]])], ["cell", "n"])

    got = encoded.select("bins").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * cells rows
    near = np.zeros(2 * cells)
    near[got["cell"].to_numpy()] = got["n"].to_numpy()
    near = near.reshape(2, BINS, CONTEXTS)
    own = (counts + 1) / np.bincount(class_of, counts + 1, minlength=CLASSES)[class_of]
    mass = np.zeros((2, CLASSES, CONTEXTS))
    for side in (0, 1):
        np.add.at(mass[side], class_of, near[side])
    return ((near + PRIOR * own[:, None]) / (mass[:, class_of] + PRIOR)).astype(np.float32).reshape(2, cells)


def fit_model(encoded: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each bin, probability of each bin in its class by side and context, weights); each of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            for raw in b.column("bins").to_pylist():
                total += np.bincount(np.frombuffer(raw, np.uint16), minlength=BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bin", "n"])

    counts = np.zeros(BINS)
    for r in encoded.select("bins").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most BINS rows
        counts[r.bin] = r.n
    class_of = OWN + np.arange(BINS) % (CLASSES - OWN)
    class_of[np.argsort(-counts, kind="stable")[:OWN]] = np.arange(OWN)
    held = encoded.sparkSession.sparkContext.broadcast(class_of)
    within = _within(encoded, held, counts, class_of)

    weights = Network().flat
    for k in range(rounds):
        start = encoded.sparkSession.sparkContext.broadcast(weights)

        def train(batches: Iterator[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:
            one_blas_thread()
            net, seen, around, target = Network(start.value), 0, [], []
            held_n = 0

            def step() -> None:
                a, t = np.concatenate(around), np.concatenate(target)
                order = np.random.default_rng(seen).permutation(len(t))
                for x in range(0, len(order), BATCH):
                    net.fit(a[order[x : x + BATCH]], t[order[x : x + BATCH]])

            for b in batches:
                for raw in b.column("bins").to_pylist():
                    c = held.value[np.frombuffer(raw, np.uint16)]
                    at = np.arange((seen + k * stride // rounds) % stride, len(c), stride)
                    seen += len(c)
                    if len(at):
                        around.append(windows(c, at))
                        target.append(c[at])
                        held_n += len(at)
                    if held_n >= SLICE:
                        step()
                        around, target, held_n = [], [], 0
            if held_n:
                step()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(net.flat)), pa.int32()), pa.array(net.flat.astype(float) * seen), pa.array(np.full(len(net.flat), float(seen)))], ["at", "x", "n"])

        got = encoded.select("bins").mapInArrow(train, "at int, x double, n double").groupBy("at").agg((F.sum("x") / F.sum("n")).alias("x")).collect()  # as many rows as weights
        if got:
            weights = weights.copy()
            weights[[r["at"] for r in got]] = [r.x for r in got]
    return class_of, within, weights


def lm_score(df: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS, stride: int = STRIDE) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for each row.

    A text without words (empty or null) has 0 tokens, sum 0.0 and a null
    mean. Repeated rows are scored alike. An empty table gives an empty
    result. Texts are scored whole, in slices of bounded size. Other columns
    are not read.
    """
    scratch = Scratch(df.sparkSession, "lm")
    slim = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t.tobytes() for t in tokens(b.column("text"))], pa.binary())], ["doc_id", "bins"])

    encoded = scratch.save(slim.mapInArrow(encode, "doc_id long, bins binary"), "tokens")
    class_of, within, weights = fit_model(encoded, rounds, stride)
    held = df.sparkSession.sparkContext.broadcast((class_of, within, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        class_of, within, weights = held.value
        net = Network(weights)
        for b in batches:
            raw = [np.frombuffer(x, np.uint16) for x in b.column("bins").to_pylist()]
            ends = np.cumsum([len(x) for x in raw])
            sums = np.zeros(len(raw))
            # texts one after another, edges between them, so that short ones are scored together
            gap = np.full(SIDE, EDGE)
            line = np.concatenate([np.concatenate([gap, class_of[x], gap]) for x in raw])
            bins = np.concatenate(raw) if len(raw) else np.array([], np.uint16)
            owner = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
            place = np.arange(len(bins)) + SIDE + 2 * SIDE * owner
            near = np.array([k for k in range(-SIDE, SIDE + 1) if k])
            for x in range(0, len(bins), SLICE):
                at = place[x : x + SLICE]
                cell = bins[x : x + SLICE].astype(np.int64) * CONTEXTS
                token = (within[0, cell + CONTEXT[line[at - 1]]] + within[1, cell + CONTEXT[line[at + 1]]]) / 2
                got = net.log_prob(line[at[:, None] + near], line[at]) + np.log(token)
                sums += np.bincount(owner[x : x + SLICE], got, minlength=len(raw))
            n = np.diff(np.concatenate([[0], ends]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums), pa.array([s / m if m else None for s, m in zip(sums.tolist(), n.tolist(), strict=True)], pa.float64())], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return encoded.mapInArrow(score, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")
