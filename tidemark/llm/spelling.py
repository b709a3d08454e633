"""Spelling variants: words one edit apart, each with its far more frequent neighbour and the root of that chain.

One edit (a code point inserted, deleted or replaced) leaves one half of a word
as it was, a place to the side at most. So the inverted index is dealt out by
half-word grams under length and position: words meet in a group where they
share a half and their lengths are as the group says. The group's postings are
the positional bigrams of the other, open part. A word of r open code points has
r + 1 bigrams (with both ends); one edit spares all but two, so of any three
(two towards longer words) one is shared. A word therefore merges its three
shortest postings only, under the same limits of length and position. What comes
out must pass the count filter (shared bigrams at the overlap bound of one edit
or above) and is then verified over the whole word.

Groups of more than GROUP rows are halved again in their open part until they
are small or a single code point is open, when a group holds no more words than
an alphabet (or pairs of it) has characters. A pair that could meet in several
groups counts in one, told by where the two words first differ. No pair leaves
its task: each group gives per word how many near words it has and which is the
most frequent, and one aggregation by word adds these up.

Null texts and empty tables give no words. Equal rows count as often as they
stand. Ties between forms go to the smaller word in code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a group from which it is halved again.
GROUP = 4096
#: Words that a task counts before it hands counts on; characters in one pass over groups; candidates compared at once.
HELD, CELLS, PAIRS = 1 << 20, 1 << 20, 1 << 18
#: How many times as frequent a word's form must be.
TIMES = 10
#: Latin-1 bytes of a text: A-Z to lower case, what is no letter (from C0 on all are) to a space.
FOLD = bytes(b if b >= 192 else ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 for b in range(256))


def corpus_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slip: int = 31, least: int = 7, times: int = 2) -> DataFrame:
    """Words of at least ``least`` code points (runs of Latin letters, A-Z lower-cased) that occur at least ``times`` times, and how often.

    Where ``slip`` divides the checksum of ``<doc_id>:<word>`` one code point of
    the word is dropped, told by the checksum: a misspelling that any run of
    this over the same rows repeats. A null id is written ``null``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not value.is_valid:
                    continue
                start = zlib.crc32(f"{key}:".encode())
                found = Counter([w for w in value.as_py().encode("latin-1", "replace").translate(FOLD).split() if len(w) >= least])
                for word, n in found.items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % slip == 0:
                        h %= len(word)
                        word = word[:h] + word[h + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) >= HELD:
                    yield _counted(total)
                    total = Counter()
        yield _counted(total)

    ids = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    parts = docs.select(ids.alias("id"), F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: by the first half of its open part, the second open, and the other way round.

    ``long`` words have one code point more than their group's shorter ones, so
    their second half starts one later.
    """
    half = F.floor((F.col("b") - F.col("a") - F.col("long")) / 2).cast("int")
    middle = F.col("a") + F.col("half") + F.col("long")
    cut = lambda a, b: F.substring(F.col("word"), a + 1, b - a)
    first = F.struct(F.xxhash64("key", F.lit(0), cut(F.col("a"), F.col("a") + F.col("half"))).alias("key"), (F.col("a") + F.col("half")).alias("a"), F.col("b").alias("b"))
    second = F.struct(F.xxhash64("key", F.lit(1), cut(middle, F.col("b"))).alias("key"), F.col("a").alias("a"), middle.alias("b"))
    return rows.withColumn("half", half).select("size", "word", "n", "long", F.explode(F.array(first, second)).alias("x")).select("size", "x.key", "word", "n", "long", "x.a", "x.b")


def _groups(words: DataFrame, scratch: Scratch) -> DataFrame:
    """Words by the groups they meet in, none of more than GROUP rows while more than one code point is open."""
    length = F.char_length("word").cast("int")
    role = F.explode(F.array(F.lit(0), F.lit(1))).alias("long")
    rows = words.select("word", "n", role).select((length - F.col("long")).alias("size"), F.xxhash64(length - F.col("long")).alias("key"), "word", "n", "long", F.lit(0).alias("a"), length.alias("b")).where("size > 0")
    rows, out, level = scratch.save(_halves(rows), "rows-0"), [], 0
    while True:
        crowd = rows.where("b - a - long > 1").groupBy("key").count().where(F.col("count") > GROUP).select("key")
        crowd = scratch.save(crowd, f"crowd-{level}")
        if crowd.isEmpty():
            break
        level += 1
        split = scratch.save(_halves(rows.join(crowd, "key", "left_semi")), f"rows-{level}")
        out.append(rows.join(crowd, "key", "left_anti").select(split.columns))
        rows = split
    for part in out:
        rows = rows.unionByName(part)
    return rows


def _hash(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = (out ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return out


class Postings:
    """Rows by positional bigram: lists of rows that share a code, each list in ascending order of rows."""

    def __init__(self, codes: np.ndarray, valid: np.ndarray, rows: np.ndarray):
        flat = codes[valid]
        row = np.repeat(rows, valid.sum(axis=1))
        order = np.argsort(flat, kind="stable")
        self.code, self.row = flat[order], row[order]

    def spans(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.code, codes), np.searchsorted(self.code, codes, side="right")


def _merged(query: np.ndarray, start: np.ndarray, end: np.ndarray, postings: Postings, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each query's lists, merged: every (query, row) once, a bounded number of list entries at a time.

    Spans are sorted by query; a query's lists stay in one piece.
    """
    size = np.cumsum(end - start)
    last = np.flatnonzero(np.r_[query[1:] != query[:-1], True])
    at = 0
    while at < len(query):
        done = size[at - 1] if at else 0
        k = np.searchsorted(size[last], done + PAIRS)
        stop = last[min(k, len(last) - 1)] + 1
        each = (end - start)[at:stop]
        q = np.repeat(query[at:stop], each)
        entry = np.arange(len(q)) + np.repeat(start[at:stop] - (np.cumsum(each) - each), each)
        pair = np.unique(q.astype(np.int64) * n + postings.row[entry])
        yield pair // n, pair % n
        at = stop


def near_pairs(words: list[str], group: np.ndarray, long: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose words are one edit apart and whose canonical group this is."""
    n, size = len(words), np.array([len(w) for w in words])
    width = int(size.max()) + 2
    char = np.zeros((n, width), np.uint32)
    char[np.arange(width)[None, :] < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    r = b - a
    wide = int(r.max())
    at = np.arange(wide + 2)
    inside = (at[None, :] >= 1) & (at[None, :] <= r[:, None])
    open_ = np.where(inside, np.take_along_axis(char, np.minimum(a[:, None] + np.maximum(at - 1, 0)[None, :], width - 1), axis=1) + 2, (at[None, :] > r[:, None]).astype(np.uint32))
    gram = (open_[:, :-1].astype(np.uint64) << np.uint64(32)) | open_[:, 1:].astype(np.uint64)
    valid = np.arange(wide + 1)[None, :] <= r[:, None]
    place = np.arange(wide + 1, dtype=np.uint64)[None, :]
    base = _hash(group[:, None], gram)
    rows = np.arange(n)
    short, more = rows[long == 0], rows[long == 1]
    left, right = [], []

    def best_lists(sizes: np.ndarray, lists: int) -> np.ndarray:
        return np.argsort(sizes, axis=1, kind="stable")[:, :lists] if sizes.shape[1] > lists else np.broadcast_to(np.arange(sizes.shape[1]), sizes.shape)

    # equal length: a bigram stands at the same place in both
    code = _hash(base, place)
    code[r <= 1, 0] = _hash(group)[r <= 1]  # a single open code point: all of the group meet
    own = Postings(code[short], valid[short], short)
    start, end = own.spans(code[short])
    start = np.where(valid[short], start, 0)
    end = np.where(valid[short], end, 0)
    sizes = np.where(valid[short], end - start, 1 << 40)
    pick = best_lists(sizes, 3)
    pick_code = lambda x: np.take_along_axis(x, pick, axis=1).reshape(-1)
    ids = np.repeat(short, pick.shape[1])
    for i, j in _merged(ids, pick_code(start), pick_code(end), own, n):
        keep = i < j
        i, j = i[keep], j[keep]
        shared = ((gram[i] == gram[j]) & valid[i]).sum(axis=1)
        keep = shared >= r[i] - 1
        i, j = i[keep], j[keep]
        differ = char[i] != char[j]
        first = differ.argmax(axis=1)
        keep = (differ.sum(axis=1) == 1) & (first >= a[i]) & ((b[i] == size[i]) | (first < b[i]))
        left.append(i[keep])
        right.append(j[keep])
    # one more: a bigram of the shorter word stands there or one later
    if len(more) and len(short):
        code = _hash(base, place)
        other = Postings(code[more], valid[more], more)
        here, later = other.spans(code[short]), other.spans(_hash(base[short], place + np.uint64(1)))
        start, end = (np.where(np.tile(valid[short], 2), np.concatenate([here[k], later[k]], axis=1), 0) for k in (0, 1))
        half = wide + 1
        sizes = np.where(valid[short], (end - start)[:, :half] + (end - start)[:, half:], 1 << 40)
        pick = best_lists(sizes, 2)
        pick = np.concatenate([pick, pick + half], axis=1)
        ids = np.repeat(short, pick.shape[1])
        for i, j in _merged(ids, pick_code(start), pick_code(end), other, n):
            after = np.concatenate([gram[j][:, 1:], np.zeros((len(j), 1), np.uint64)], axis=1)
            shared = (((gram[i] == gram[j]) | (gram[i] == after)) & valid[i]).sum(axis=1)
            keep = shared >= r[i]
            i, j = i[keep], j[keep]
            ahead = char[i][:, :-1] == char[j][:, :-1]
            first = np.minimum(np.where(ahead.all(axis=1), width, ahead.argmin(axis=1)), size[i])
            behind = (char[i][:, :-1] == char[j][:, 1:]) | (np.arange(width - 1)[None, :] < first[:, None])
            keep = behind.all(axis=1) & (first >= a[i]) & ((b[i] == size[i]) | (first < b[i]))
            left.append(i[keep])
            right.append(j[keep])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(left), join(right)


def _found(table: pa.Table) -> pa.RecordBatch:
    """Per row of whole groups that has near words: how many, and the most frequent if it is frequent enough."""
    key, words, n = table["key"].to_numpy(), table["word"].to_pylist(), table["n"].to_numpy()
    long, a, b = (table[c].to_numpy() for c in ("long", "a", "b"))
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    out = ([], [], [], [], [])
    if len(some):
        words = [words[i] for i in some.tolist()]
        n = n[some]
        i, j = near_pairs(words, group[some], long[some], a[some], b[some])
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        near = np.bincount(i, minlength=len(words))
        form: dict[int, tuple[int, str]] = {}
        much = n[j] >= TIMES * n[i]
        for x, y in zip(i[much].tolist(), j[much].tolist(), strict=True):
            at = (-int(n[y]), words[y])
            if x not in form or at < form[x]:
                form[x] = at
        for x in np.flatnonzero(near).tolist():
            best = form.get(x)
            for column, value in zip(out, (words[x], 0, int(near[x]), best and best[1], best and -best[0]), strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n", "n_near", "form", "form_n"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups are whole in a task and sorted; passes take as many as fit CELLS, one at least."""
    held, cells = [], 0
    for batch in batches:
        key, size = batch.column("key").to_numpy(), batch.column("size").to_numpy()
        starts = np.flatnonzero(np.r_[bool(held) and held[-1].column("key")[-1].as_py() != key[0], key[1:] != key[:-1]])
        at = 0
        while at < len(key):
            sums = np.cumsum(size[at:])
            enough = at + np.searchsorted(sums, CELLS - cells)
            cut = starts[starts >= max(enough, at if held else at + 1)][:1]
            if not len(cut):
                held.append(batch.slice(at))
                cells += int(sums[-1])
                break
            held.append(batch.slice(at, cut[0] - at))
            yield _found(pa.Table.from_batches(held))
            held, cells, at = [], 0, int(cut[0])
    if held:
        yield _found(pa.Table.from_batches(held))


def variants(words: DataFrame) -> DataFrame:
    """For each row of (word, n), words distinct and not null: form, root, n, n_near and form_n."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words.select("word", F.col("n").cast("long").alias("n")), "words")
    met = _groups(words, scratch).repartition("size", "key").sortWithinPartitions("size", "key")
    parts = met.mapInArrow(_near, "word string, n long, n_near long, form string, form_n long")
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    best: Column = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("k"), "form")))
    out = every.union(parts).groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    out = scratch.save(out.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.k")).alias("form_n")), "forms")
    roots = _roots(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), scratch)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) with each root followed to the last, doubling the way in each round.

    Frequencies grow tenfold at each step, so no chain is longer than 18 steps and five rounds do.
    """
    steps = scratch.save(steps, "roots-0")
    for k in range(1, 6):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        far, seen = scratch.save_seen(far, f"roots-{k}", F.count_if("moved").alias("n"))
        steps = far.select("word", "root")
        if not seen["n"]:
            break
    return steps
