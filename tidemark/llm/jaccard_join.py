"""Jaccard self-join of documents on word n-grams, with Bayesian candidate pruning.

1. Each text becomes its set of hashed word n-grams and a MinHash signature.
   Equal sets form one class, so copies are carried once.
2. Classes that share a band of the signature meet in a bucket. Inside it
   MinHash values are compared in growing prefixes; a pair goes as soon as the
   posterior probability that its similarity reaches the threshold falls below
   the tolerance. What is left only has to connect, so a bucket gives a
   spanning forest, never its pairs.
3. Within each connected cluster all pairs of classes are verified exactly, in
   blocks; each block gives link counts and a spanning forest. A set travels as
   its difference from one set of the cluster, which for near copies is small;
   intersections follow from the differences without loss.

Buckets and clusters larger than a block (of rows or bytes) are compared block
by block, so that no task holds a whole group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .common import Scratch, components, one_blas_thread, pick_rows

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
#: Posterior probability below which a pair is dropped.
TOLERANCE = 1e-6
STEPS = (16, 32, 64, BANDS * ROWS)
BUCKET_BLOCK = 4096
VERIFY_BLOCK = 1024
VERIFY_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20

_MULTIPLY = np.random.default_rng(5).integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = np.random.default_rng(6).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingles(texts: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word k-grams.

    A text of 1 to k-1 words has one gram, all its words; one without words
    (or null) has none.
    """
    cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.asarray(cut.offsets).astype(np.int64)
    offsets -= offsets[0]
    code = cut.flatten().dictionary_encode()
    word = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in code.dictionary.to_pylist()], np.uint64)
    codes = code.indices.to_numpy(zero_copy_only=False)
    hashed = word[codes] if len(codes) else np.array([], np.uint64)
    out = []
    present = (np.asarray(pc.binary_length(code.dictionary)) > 0)[codes] if len(codes) else np.array([], bool)
    for a, b in zip(offsets, offsets[1:], strict=False):
        h = hashed[a:b][present[a:b]]
        if not len(h):
            out.append(h)
            continue
        n, width = max(1, len(h) - k + 1), min(k, len(h))
        mix = np.full(n, width, np.uint64)
        for i in range(width):
            mix = (mix ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
        out.append(np.unique(mix))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, BANDS integers of 64 bits, each the low 16 bits of ROWS MinHash values; sets must not be empty."""
    low = np.concatenate(sets).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), BANDS * ROWS), np.uint16)
    for i in range(BANDS * ROWS):
        out[:, i] = np.minimum.reduceat(low * _MULTIPLY[i] + _ADD[i], at).astype(np.uint16)
    return out.view(np.int64)


@lru_cache
def needed(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each step, the least number of agreeing values for which the posterior (uniform prior) of reaching the threshold is at least the tolerance."""
    out = []
    for m in STEPS:
        total, c = 0.0, -1
        while total < tolerance:  # P(J >= t | c of m agree) = P(Binomial(m + 1, t) <= c)
            c += 1
            total += comb(m + 1, c) * threshold**c * (1 - threshold) ** (m + 1 - c)
        out.append(c)
    return tuple(out)


def alike(one: np.ndarray, many: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which rows of ``many`` (16-bit values) are still candidates for ``one`` after each step's pruning."""
    left, seen, done = np.arange(len(many)), np.zeros(len(many), np.int64), 0
    for m, least in zip(STEPS, needed(threshold, tolerance), strict=True):
        seen = seen + (many[left, done:m] == one[done:m]).sum(axis=1)
        ok = seen >= least
        left, seen, done = left[ok], seen[ok], m
    return left


def forest(n: int, neighbours) -> list[tuple[int, int]]:
    """Edges that connect what ``neighbours(i, candidates)`` says are neighbours: breadth first over nodes not reached yet."""
    rest, edges = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            got = neighbours(i, rest)
            if len(got):
                edges += [(i, int(j)) for j in rest[got]]
                queue += rest[got].tolist()
                rest = np.delete(rest, got)
    return edges


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in a sorted stream."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            c = b.column(k)
            change |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)))
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            part = b.slice(x, y - x)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _in_blocks(df: DataFrame, blocks: Column, node: str, keys: list[str]) -> DataFrame:
    """Deal each group's rows into that many blocks and repeat a row for each pair of blocks that it is in: columns i and j, and own, the row's block."""
    own = df.withColumn("many", F.ceil(blocks).cast("int")).withColumn("own", F.pmod(F.xxhash64(node), F.col("many")).cast("int"))
    out = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    out = out.withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with")}).drop("with", "many")
    cols = [*keys, "i", "j"]
    return out.repartition(*cols).sortWithinPartitions(*cols)


def jaccard_join(df: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links, kept, mark) for each row.

    Rows whose texts' n-gram sets have Jaccard similarity of at least
    ``threshold`` are linked; class_id is the least doc_id of those connected
    by links, n_links the number of rows linked with this one, copies
    included; kept holds for one row of each class, that of least (doc_id,
    mark), mark being the text's hash, and one of the rows that repeat both. A
    text without words (empty or null) has no links. Null ids are least. An
    empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "jaccard")
    slim = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", CHUNK_BYTES):
            sets = shingles(b.column("text"), k)
            some = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in some]).tolist() if some else []
            rows: list = [None] * len(sets)
            for i, s in zip(some, sig, strict=True):
                rows[i] = s
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(digest, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "mark", "node", "sig"])

    signed = slim.mapInArrow(sign, "doc_id long, mark long, node binary, sig array<long>")
    signed = scratch.save(signed.withColumn("rid", F.monotonically_increasing_id()), "signed")  # rid tells apart rows that repeat both
    least = F.min(F.struct("doc_id", "mark", "rid")).alias("first")
    classes = scratch.save(signed.where("sig is not null").groupBy("node").agg(least, F.count(F.lit(1)).alias("size"), F.first("sig").alias("sig")), "classes")

    # candidates: classes in a bucket with others, cut to what Bayesian pruning leaves connected
    bands = classes.select("node", F.posexplode("sig").alias("band", "key"))
    # bands under which the same classes meet tell nothing new: one of them stays, known by count, sum and exclusive or of its members' hashes
    who = F.xxhash64("node")
    alike_ = [F.count(F.lit(1)).alias("n"), F.sum(who.cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), who)).alias("xor")]
    full = bands.groupBy("band", "key").agg(*alike_).where("n > 1").groupBy("n", "sum", "xor").agg(F.min(F.struct("band", "key")).alias("at"))
    full = scratch.save(full.select("at.band", "at.key", "n"), "buckets")
    met = scratch.save(bands.join(full, ["band", "key"]), "met")
    dealt = _in_blocks(met.join(classes.select("node", "sig"), "node"), F.col("n") / F.lit(BUCKET_BLOCK), "node", ["band", "key"]).drop("n")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["band", "key", "i", "j"]):
            sig = np.array(g.column("sig").to_pylist(), np.int64).view(np.uint16).reshape(g.num_rows, -1)
            found = forest(len(sig), lambda i, rest, sig=sig: alike(sig[i], sig[rest], threshold, tolerance))
            if found:
                node = g.column("node").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([node[x] for x, _ in found], pa.binary()), pa.array([node[y] for _, y in found], pa.binary())], ["a", "b"])

    edges = scratch.save(dealt.mapInArrow(connect, "a binary, b binary"), "edges")
    clusters = scratch.save(components(edges, scratch, "near"), "clusters")
    scratch.drop("met", "edges")

    # exact verification of all pairs within each cluster, on differences from the set of its root
    wanted = clusters.join(classes.select("node", "size", "first.doc_id", "first.mark"), "node")
    wanted = scratch.save(wanted.withColumnsRenamed({"doc_id": "w_id", "mark": "w_mark"}), "wanted")

    def texts_of(some: DataFrame) -> DataFrame:
        # the keys grow with the input: never broadcast, the same plan at every size
        return slim.join(some.hint("merge"), F.col("mark").eqNullSafe(F.col("w_mark")) & F.col("doc_id").eqNullSafe(F.col("w_id")))

    heads = texts_of(wanted.where("node = root")).select("root", F.col("text").alias("head"))
    pairs = texts_of(wanted).select("root", "node", "size", "text").join(heads.dropDuplicates(["root"]), "root")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, head = None, np.array([], np.uint64)
        for b in chunks(batches, "text", CHUNK_BYTES):
            out: dict[str, list] = {c: [] for c in ("grams", "minus", "common", "n_head")}
            for at, own in enumerate(shingles(b.column("text"), k)):
                if (name := b.column("root")[at].as_py()) != root:
                    root, head = name, shingles(b.column("head").slice(at, 1), k)[0]
                shared = np.isin(own, head, assume_unique=True)
                minus = np.setdiff1d(head, own, assume_unique=True)
                near = len(minus) <= int(shared.sum())  # else the set itself is shorter than its difference
                for c, x in zip(out, (np.concatenate([minus, own[~shared]]) if near else own, len(minus) if near else -1, int(shared.sum()), len(head)), strict=True):
                    out[c].append(x.tobytes() if c == "grams" else x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("root", "node", "size")), pa.array(out["grams"], pa.binary()), *(pa.array(out[c], pa.int64()) for c in ("minus", "common", "n_head"))], ["root", "node", "size", *out])

    schema = "root binary, node binary, size long, grams binary, minus long, common long, n_head long"
    diffs = scratch.save(pairs.mapInArrow(differ, schema).dropDuplicates(["node"]), "diffs")  # rows that repeat an id and text give one
    sizes = diffs.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("grams")).alias("bytes"))
    sizes = sizes.select("root", F.greatest(F.col("n") / F.lit(VERIFY_BLOCK), F.col("bytes") / F.lit(VERIFY_BYTES)).alias("blocks"))
    blocks = _in_blocks(diffs.join(sizes, "root"), F.col("blocks"), "node", ["root"]).drop("blocks")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for g in _groups(batches, ["root", "i", "j"]):
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            g = g.sort_by("own")
            first = int((g.column("own").to_numpy() == i).sum()) if i != j else None
            minus, common, n_head = (g.column(c).to_numpy() for c in ("minus", "common", "n_head"))
            link = _links([np.frombuffer(x, np.uint64) for x in g.column("grams").to_pylist()], threshold, first, minus, common, n_head[0])
            node, size = g.column("node").to_pylist(), g.column("size").to_numpy()
            counts = link @ size
            ok = np.flatnonzero(counts)
            found = forest(len(node), lambda i, rest, link=link: np.flatnonzero(link[i, rest]))
            yield pa.RecordBatch.from_arrays([pa.array([node[x] for x in ok] + [node[x] for x, _ in found], pa.binary()), pa.array([None] * len(ok) + [node[y] for _, y in found], pa.binary()), pa.array(counts[ok].tolist() + [0] * len(found), pa.int64())], ["a", "b", "n"])

    verified = scratch.save(blocks.mapInArrow(verify, "a binary, b binary, n long"), "verified")
    scratch.drop("wanted", "diffs")
    links = verified.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    groups = scratch.save(components(verified.where("b is not null").select("a", "b"), scratch, "linked"), "groups")
    heads = scratch.save(groups.join(classes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("head")), "heads")
    own = groups.join(heads, "root").select("node", "head")
    known = classes.join(own, "node", "left").join(links, "node", "left")
    known = scratch.save(known.select("node", F.coalesce("head", "first").alias("head"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    some = signed.where("sig is not null").join(known, "node")
    mine = F.struct("doc_id", "mark", "rid")
    linked = some.select("doc_id", F.col("head.doc_id").alias("class_id"), F.col("n_links").cast("long").alias("n_links"), mine.eqNullSafe(F.col("head")).alias("kept"), "mark")
    bare = signed.where("sig is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "mark")
    return linked.union(bare)


def _links(sets: list[np.ndarray], threshold: float, first: int | None = None, minus: np.ndarray | None = None, common: np.ndarray | None = None, n_head: int = 0) -> np.ndarray:
    """Which pairs of sets reach the threshold, exactly: intersections are counted gram by gram.

    With ``first``, only pairs of one of the first so many sets and one of the rest; none if either is empty.
    Where ``minus`` is not negative, the set is given by its difference from a
    head of ``n_head`` grams, ``common`` of which it has: first the grams of
    the head that it lacks, so many, then those that the head lacks. A gram
    lacked counts as -1 in the product, which corrects the part that the heads
    give: both sets' common grams less the head's for two such sets, the other
    set's common grams for one.
    """
    n = len(sets)
    if first is not None and not 0 < first < n:
        return np.zeros((n, n), bool)
    held = np.array([len(s) for s in sets])
    lacked = np.full(n, -1) if minus is None else minus
    by_head, lacks = lacked >= 0, np.maximum(lacked, 0)
    common = np.zeros(n, np.int64) if common is None else common
    size = held - lacks + np.where(by_head, common, 0)
    values, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), held)
    sign = np.where(np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) < lacks[row], -1, 1)
    shared = df > 1  # a gram of one set adds to no intersection
    name = np.cumsum(shared) - 1
    ok = shared[code]
    row, col, sign = row[ok], name[code[ok]], sign[ok]
    order = np.argsort(col, kind="stable")
    row, col, sign = row[order], col[order], sign[order]
    one, two = (slice(0, n), slice(0, n)) if first is None else (slice(0, first), slice(first, n))
    x_by, y_by, x_common, y_common = by_head[one][:, None], by_head[two][None, :], common[one][:, None], common[two][None, :]
    both = np.where(x_by & y_by, x_common + y_common - n_head, np.where(x_by, y_common, np.where(y_by, x_common, 0))).astype(np.float64)
    for at in range(0, int(shared.sum()), 4096):
        x, y = np.searchsorted(col, [at, at + 4096])
        dense = np.zeros((n, 4096), np.float32)
        dense[row[x:y], col[x:y] - at] = sign[x:y]
        both += dense[one] @ dense[two].T
    near = both >= threshold * (size[one][:, None] + size[two][None, :] - both) - 1e-9
    if first is None:
        np.fill_diagonal(near, False)
        return near
    link = np.zeros((n, n), bool)
    link[one, two] = near
    link[two, one] = near.T
    return link


def keep_representatives(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The input's rows, all columns, one of each class; rows without words all stay."""
    found = jaccard_join(df, text, doc_id, **options)
    n = F.when(F.every("kept"), F.lit(1)).otherwise(F.count(F.lit(1)))  # repeats of one key that all stay aren't merged
    keys = found.groupBy("doc_id", "mark").agg(F.max("kept").alias("kept"), n.alias("n")).where("kept").select("doc_id", "mark", "n")
    return pick_rows(df, keys, doc_id, F.xxhash64(F.coalesce(F.col(text), F.lit(""))), Scratch(df.sparkSession, "jaccard-keep"))
