"""Token ids in binary files, packed by Simple-8b.

A file set is a Parquet folder that Spark commits; each row is a segment: the
ids of some whole documents in turn. A segment's ids are cut into blocks of
BLOCK, each packed into 64-bit words whose low 4 bits select how many ids of
how many bits the other 60 hold. ``offsets`` gives the word at which each block
begins, so any block, or all at once, can be decoded without the ones before
it. Ids of 60 bits or more stand as 0 in the words and in full among the
segment's escapes. Parts ascend by document id, segments ascend within a part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import _gather, chunks

# For each selector the ids in a word and the bits of each.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

BLOCK = 1024
SEGMENT_IDS = 1 << 18
CACHE_WORDS = 800_000
SEGMENT = "part int, segment int, first long, docs array<long>, counts array<long>, offsets array<int>, words binary, escape_at array<long>, escape_id array<long>"

# Letters that the tokenizer's normaliser only lowers, and marks that it leaves and splits off.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
MARKS = '.,!?;:*$%&#|()"<>[]{}=+-_/@~^'


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, offsets, escape_at, escape_id) of non-negative 64-bit ids."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    escape_at = np.flatnonzero(ids >> np.uint64(60))
    escape_id = ids[escape_at]
    low = ids.copy()
    low[escape_at] = 0
    end = np.minimum((np.arange(n) // BLOCK + 1) * BLOCK, n)
    top = int(low.max()) if n else 0
    narrow = low.astype(np.uint32) if not top >> 32 else low
    choice = np.full(n, len(BITS) - 1, np.int8)
    free = np.ones(n, bool)  # positions whose selector is still open
    for s in range(len(BITS) - 1):
        small = np.flatnonzero(narrow < narrow.dtype.type(1 << int(BITS[s]))) if top >> int(BITS[s]) else None
        if small is None:  # all fit from here on
            choice[free] = s
            break
        if not len(small):
            continue
        # each run of small ids, and where it ends; a selector fits if its ids, or the block's last ones, lie in one run
        last = np.flatnonzero(np.r_[small[1:] != small[:-1] + 1, True])
        until = np.repeat(small[last] + 1, np.diff(np.r_[-1, last]))
        fits = small[free[small] & (until >= np.minimum(small + COUNTS[s], end[small]))]
        choice[fits] = s
        free[fits] = False
    step = np.minimum(np.arange(n) + COUNTS[choice], end).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = step[at]
    starts = np.array(starts, np.int64)
    select = choice[starts] if n else np.array([], np.int8)
    words = select.astype(np.uint64)
    stop = end[starts] if n else starts
    for s in range(len(BITS)):
        if not (which := np.flatnonzero(select == s)).size or not BITS[s]:
            continue
        at = starts[which][:, None] + np.arange(COUNTS[s])
        values = np.where(at < stop[which][:, None], low[np.minimum(at, n - 1)], 0).astype(np.uint64)
        words[which] |= (values << (np.arange(COUNTS[s]) * BITS[s] + 4).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    offsets = np.searchsorted(starts, np.arange(0, n, BLOCK))
    return words, offsets, escape_at, escape_id


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, escape_at=(), escape_id=()) -> np.ndarray:
    """The n ids; all blocks are decoded at once."""
    words = np.asarray(words, np.uint64)
    select = (words & np.uint64(15)).astype(np.int64)
    count = COUNTS[select]
    block = np.searchsorted(np.asarray(offsets), np.arange(len(words)), "right") - 1
    run = np.cumsum(count) - count
    first = block * BLOCK + run - (run[np.asarray(offsets)[block]] if len(words) else run)
    stop = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in range(len(BITS)):
        if not (which := np.flatnonzero(select == s)).size or not BITS[s]:
            continue
        values = (words[which][:, None] >> (np.arange(COUNTS[s]) * BITS[s] + 4).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
        at = first[which][:, None] + np.arange(COUNTS[s])
        ok = at < stop[which][:, None]
        out[at[ok]] = values[ok]
    out[np.asarray(escape_at, np.int64)] = np.asarray(escape_id, np.uint64)
    return out


class WordEncoder:
    """A tokenizer of the ``tokenizers`` library that drops white space, asked once for each distinct word.

    Its splits never span ASCII white space, so a text's ids are its words'
    ids in turn. A word of Latin letters before marks is two splits, of which
    the first is only lowered: it goes straight to the tokenizer's model.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        byte = {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}
        self.mapped = {c: "".join(byte[b] for b in chr(c).lower().encode()) for c in range(0xC0, 0x100)}
        self.letters: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}

    def _runs(self, names: list[str]) -> list[bytes]:
        """Ids of lower-cased runs of Latin letters."""
        known = self.letters
        if len(known) + len(names) > CACHE_WORDS:  # what is in use stays
            known = self.letters = {w: known[w] for w in names if w in known}
        for w in [w for w in names if w not in known]:
            known[w] = np.array([t.id for t in self.model.tokenize(w if w.isascii() else w.translate(self.mapped))], np.uint32).tobytes()
        return [known[w] for w in names]

    def _others(self, names: list[str]) -> list[bytes]:
        known = self.whole
        if len(known) + len(names) > CACHE_WORDS:
            known = self.whole = {w: known[w] for w in names if w in known}
        new = [w for w in names if w not in known]
        known |= {w: np.array(e.ids, np.uint32).tobytes() for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)}
        return [known[w] for w in names]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct words: each is a run of letters and marks after it, or neither."""
        heads = pc.utf8_rtrim(words, characters=MARKS)
        plain = pc.match_substring_regex(heads, pattern=f"^{LETTERS}$")
        is_plain = plain.to_numpy(zero_copy_only=False)
        runs = pc.utf8_lower(heads.filter(plain)).dictionary_encode()
        cut = pc.utf8_length(heads).to_numpy()
        more = is_plain & (cut < pc.utf8_length(words).to_numpy())
        tails = [w[n:] for w, n in zip(words.filter(pa.array(more)).to_pylist(), cut[more].tolist(), strict=True)]
        rest = words.filter(pc.invert(plain)).to_pylist()
        names = list(dict.fromkeys([*rest, *tails]))
        place = {w: k for k, w in enumerate(names)}
        pieces = [*self._runs(runs.dictionary.to_pylist()), *self._others(names), b""]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        first_other, none = len(runs.dictionary), len(pieces) - 1
        parts = np.full((len(words), 2), none, np.int64)
        parts[is_plain, 0] = runs.indices.to_numpy(zero_copy_only=False)
        parts[~is_plain, 0] = [first_other + place[w] for w in rest]
        parts[more, 1] = [first_other + place[w] for w in tails]
        flat = _gather(np.frombuffer(b"".join(pieces), np.uint32), np.cumsum(size) - size, size, parts.reshape(-1))
        return flat, size[parts].sum(axis=1)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of all texts, each with the end id after it; null counts as empty."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = np.asarray(cut.offsets)[1:] - cut.offsets[0].as_py()
        code = cut.flatten().dictionary_encode()
        ids, size = self.words(code.dictionary)
        ids, size = np.append(ids, np.uint32(end_id)), np.append(size, 1)
        codes = np.insert(code.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(size) - 1)
        total = np.concatenate([[0], np.cumsum(size[codes])])
        return _gather(ids, np.cumsum(size) - size, size, codes), total[ends + np.arange(1, len(ends) + 1)]


_LOADED: dict[bytes, WordEncoder] = {}


def write_token_files(df: DataFrame, tokenizer: bytes, path: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every text, the end id after it, and write the segments to ``path`` in ascending doc_id order.

    A null text counts as empty and gives the end id alone. Null ids come
    first; rows of one id are ordered by their texts' hashes, then the texts,
    so that even one id with very many rows is dealt to many parts. An empty
    table gives an empty file set. Other columns are not read.
    """
    held = df.sparkSession.sparkContext.broadcast(tokenizer)
    slim = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = slim.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _LOADED.get(held.value) or _LOADED.setdefault(held.value, WordEncoder(held.value))
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        for b in chunks(batches, "text"):
            flat, ends = coder.encode(b.column("text"), end_id)
            docs = b.column("doc_id").to_pylist()
            at = doc = 0
            while doc < len(docs):
                upto = max(doc + 1, int(np.searchsorted(ends, at + SEGMENT_IDS, "right")))
                counts = np.diff(np.concatenate([[at], ends[doc:upto]]))
                words, offsets, escape_at, escape_id = pack(flat[at : ends[upto - 1]])
                row = {"part": part, "segment": segment, "first": first, "docs": docs[doc:upto], "counts": counts.tolist(), "offsets": offsets.tolist(), "words": words.astype("<u8").tobytes(), "escape_at": escape_at.tolist(), "escape_id": escape_id.view(np.int64).tolist()}
                yield pa.RecordBatch.from_pylist([row], _ARROW)
                segment, first, at, doc = segment + 1, first + int(counts.sum()), int(ends[upto - 1]), upto

    ordered.mapInArrow(run, SEGMENT).write.mode("overwrite").parquet(path)


_LONGS = pa.list_(pa.int64())
_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("docs", _LONGS), ("counts", _LONGS), ("offsets", pa.list_(pa.int32())), ("words", pa.binary()), ("escape_at", _LONGS), ("escape_id", _LONGS)])


def _decoded(b: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for row in b.to_pylist():
        counts = np.array(row["counts"], np.int64)
        ids = unpack(np.frombuffer(row["words"], "<u8"), np.array(row["offsets"], np.int64), int(counts.sum()), row["escape_at"], np.array(row["escape_id"], np.int64).view(np.uint64))
        yield row, np.cumsum(counts) - counts, ids


def _based(segments: DataFrame) -> DataFrame:
    """Segments with ``base``, the ids in all parts before theirs: one row per part, joined by size."""
    parts = segments.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    base = F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return segments.join(parts.select("part", base.alias("base")), "part")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in a file set; start counts the ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, at, ids in _decoded(b):
                lists = pa.ListArray.from_arrays(pa.array([*at.tolist(), len(ids)], pa.int32()), pa.array(ids.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(at + row["base"] + row["first"]), lists], ["doc_id", "start", "ids"])

    return _based(spark.read.schema(SEGMENT).parquet(path)).mapInArrow(run, "doc_id long, start long, ids array<long>")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the ids that the files hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, at, ids in _decoded(b):
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(at.tolist(), row["counts"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(at + row["base"] + row["first"]), pa.array(row["counts"], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _based(spark.read.schema(SEGMENT).parquet(path)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
