"""Byte-level BPE encoding and decoding by merge replay over a chunk of the corpus.

A task takes its documents in chunks of bounded size. The chunk's distinct
pieces (matches of the split pattern) form one token sequence with links to
neighbours; an inverted index maps each mergeable pair, under the rank of what
it merges to, to the positions where it stands. Merges are then replayed over
the whole chunk in rank order, each touching only its own positions and their
two neighbours. No shuffle is needed, nothing grows with the corpus, and a lost
task repeats only its own partition.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_BYTES = 12 << 20
CACHE_PIECES = 600_000
#: Positions up to which a merge is applied one by one.
FEW = 8
#: A space after white space that no visible character follows: here a cut before the space would change the split.
UNSAFE = regex.compile(r"\s\x20(?!\S)")


def read_ranks(path: str) -> bytes:
    """The rank file's content; its size is that of a vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


class MergeReplay:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}
        self.piece = regex.compile(pattern)
        self.plain = r" ?\p{L}+|" in pattern
        size = max(self.ranks.values()) + 1
        self.token = [b""] * size
        for t, r in self.ranks.items():
            self.token[r] = t
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.byte_pair = np.full((256, 256), -1, np.int64)
        for t, r in self.ranks.items():
            if len(t) == 2:
                self.byte_pair[t[0], t[1]] = r
        self.token_len = np.array([len(t) for t in self.token])
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])[:-1]
        self.token_flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.pairs = {}  # left id, right id -> rank of what they merge to; as many as tokens have cuts into two tokens
        for t, r in self.ranks.items():
            for cut in range(1, len(t)):
                left, right = self.ranks.get(t[:cut]), self.ranks.get(t[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = r
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}

    def _ranks_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def replay(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece: every merge in rank order at all its positions.

        The library's rule is to merge the lowest rank of a piece first, the
        leftmost on a tie. A merge can form a pair of lower rank than its own;
        the piece's further positions then wait until that pair is merged.
        """
        if not pieces:
            return []
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces])
        ends = np.cumsum(size)
        n = len(raw)
        owner = np.repeat(np.arange(len(pieces)), size)
        tok = self.byte_id[raw]
        nxt = np.arange(1, n + 1)
        nxt[ends[size > 0] - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[(ends - size)[size > 0]] = -1
        rank = np.where(owner[:-1] == owner[1:], self.byte_pair[raw[:-1], raw[1:]], -1) if n > 1 else np.array([], np.int64)
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        found, first = np.unique(rank[at], return_index=True)
        index = {int(r): p.tolist() for r, p in zip(found, np.split(at, first[1:]), strict=True)} if len(at) else {}
        pair = np.append(rank, -1) if n else rank  # rank of the pair that starts at a position, -1 if none or no longer
        heap = list(index)
        heapq.heapify(heap)

        def push(q: int, at: int) -> None:
            if q in index:
                index[q].append(at)
            else:
                index[q] = [at]
                heapq.heappush(heap, q)

        # the same arrays twice: a rank with many positions is merged at all of them at once, one with few position by position
        tok_, nxt_, prv_, pair_, owner_ = map(memoryview, (tok, nxt, prv, pair, owner))
        rank_of = self.pairs.get
        while heap:
            r = heapq.heappop(heap)
            positions = index.pop(r, None)
            if positions is None:
                continue
            if len(positions) > FEW:
                here = np.sort(np.array(positions))
                here = here[pair[here] == r]
                own = owner[here]
                first = np.ones(len(here), bool)
                first[1:] = own[1:] != own[:-1]
                if not first.all():  # the piece's next position, once its first is merged and what that gave of lower rank
                    index[r] = here[~first].tolist()
                    heapq.heappush(heap, r)
                    here = here[first]
                gone = nxt[here]
                after, before = nxt[gone], prv[here]
                tok[here], tok[gone], pair[here], pair[gone], nxt[here] = r, -1, -1, -1, after
                ok = after >= 0
                right, after = here[ok], after[ok]
                prv[after] = right
                left = before[before >= 0]
                at = np.concatenate([right, left])
                found = self._ranks_of(np.concatenate([tok[after] + (r << 32), (tok[left] << 32) + r]))
                pair[at] = found
                ok = found >= 0
                for q, i in zip(found[ok].tolist(), at[ok].tolist(), strict=True):
                    push(q, i)
                continue
            positions.sort()
            held, later = set(), []
            for i in positions:
                if pair_[i] != r:
                    continue
                if owner_[i] in held:
                    later.append(i)
                    continue
                j = nxt_[i]
                k = nxt_[j]
                tok_[i], tok_[j], pair_[i], pair_[j], nxt_[i] = r, -1, -1, -1, k
                p = prv_[i]
                for at, key in ((i, r << 32 | tok_[k] if k >= 0 else -1), (p, tok_[p] << 32 | r if p >= 0 else -1)):
                    if key >= 0:
                        q = rank_of(key, -1)
                        pair_[at] = q
                        if q >= 0:
                            push(q, at)
                            if q < r:
                                held.add(owner_[i])
                if k >= 0:
                    prv_[k] = i
            if later:
                index.setdefault(r, []).extend(later)
                heapq.heappush(heap, r)
        alive = tok
        counts = np.add.reduceat((alive >= 0).astype(np.int64), (ends - size)[size > 0]) if n else np.array([], np.int64)
        flat = alive[alive >= 0].tolist()
        out, at_ = [], 0
        it = iter(counts.tolist())
        for s in size.tolist():
            c = next(it) if s else 0
            out.append(tuple(flat[at_ : at_ + c]))
            at_ += c
        return out

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids, as 32-bit integers, of texts that are each split by the pattern on their own."""
        known = self.known
        new = [u for u in units if u not in known]
        if len(known) + len(new) > CACHE_PIECES:
            known.clear()
            new = list(dict.fromkeys(units))
        # a space and letters are one match of the pattern
        split = [[u] if u[:1] == " " and u[1:].isalpha() and self.plain else self.piece.findall(u) for u in new]
        raw = {p: p.encode("utf-8", "surrogatepass") for s in split for p in s}
        ids = {p: (self.ranks[t],) for p, t in raw.items() if t in self.ranks}
        rest = [p for p in raw if p not in ids]
        ids.update(zip(rest, self.replay([raw[p] for p in rest]), strict=True))
        ready = {p: array("I", i).tobytes() for p, i in ids.items()}
        known.update((u, ready[s[0]] if len(s) == 1 else b"".join([ready[p] for p in s])) for u, s in zip(new, split, strict=True))
        return [known[u] for u in units]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): ids of all texts in turn, and where each text's ids end. Null counts as empty.

        Texts are cut before spaces, where no match of the pattern crosses, so
        that repeated words are split and merged once; a text in which such a
        cut could change the split stays whole.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.array([UNSAFE.search(t) is not None for t in texts.to_pylist()], bool)
        cut = pc.split_pattern(pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts), " ")
        ends = np.asarray(cut.offsets)[1:] - cut.offsets[0].as_py()
        starts = np.concatenate([[0], ends[:-1]])
        code = cut.flatten().dictionary_encode()
        units, codes = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        opening = sorted(set(codes[starts].tolist())) if len(starts) else []
        kept = [t for t, w in zip(texts.to_pylist(), whole, strict=True) if w]
        ids = self.encode_units([" " + u for u in units] + [units[c] for c in opening] + kept)
        renamed = {c: len(units) + k for k, c in enumerate(opening)}
        if len(starts):
            codes[starts] = [renamed[c] for c in codes[starts].tolist()]
            codes[starts[whole]] = np.arange(len(kept)) + len(units) + len(opening)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        out = _gather(flat, np.cumsum(size) - size, size, codes)
        total = np.concatenate([[0], np.cumsum(size[codes])])
        return out, total[ends]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; an id outside the vocabulary raises IndexError."""
        return _gather(self.token_flat, self.token_at, self.token_len, np.asarray(ids, np.int64)).tobytes()


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """flat's runs named by codes, one after the other."""
    n = size[codes]
    shift = at[codes] - (np.cumsum(n) - n)
    return flat[np.repeat(shift, n) + np.arange(int(n.sum()))]


_LOADED: dict[tuple[bytes, str], MergeReplay] = {}


def kernel(ranks: bytes, pattern: str) -> MergeReplay:
    """One kernel for each worker process and vocabulary."""
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _LOADED:
        _LOADED[key] = MergeReplay(ranks, pattern)
    return _LOADED[key]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many bytes of text, or of one row."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(size[at:]), most, "right")))
            yield batch.slice(at, n)
            at += n


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The input with one more column, an array of token ids, replacing a column of that name.

    Ids are those of the rank file's library, without special tokens. A null
    or empty text gives an empty array. Other columns and repeated rows pass
    through untouched; an empty table gives an empty result.
    """
    held = df.sparkSession.sparkContext.broadcast(ranks)
    own = df.drop(ids)
    schema = T.StructType(list(own.schema.fields)).add(ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kernel(held.value, pattern)
        for b in chunks(batches, text):
            flat, ends = coder.encode(b.column(text))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, ids])

    return own.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The input with one more binary column: the bytes of each row's ids; null ids give null."""
    held = df.sparkSession.sparkContext.broadcast(ranks)
    own = df.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kernel(held.value, pattern)
        for b in batches:
            out = [None if x is None else coder.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, to])

    return own.mapInArrow(run, T.StructType(list(own.schema.fields)).add(to, "binary"))


def round_trip(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row: what encode and decode give, in one pass."""
    held = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kernel(held.value, pattern)
        for b in chunks(batches, "text"):
            flat, ends = coder.encode(b.column("text"))
            raw = flat.astype("<u4", copy=False).tobytes()
            back = coder.decode(flat)
            byte_ends = np.concatenate([[0], np.cumsum(coder.token_len[flat])])[ends].tolist()
            at = [0, *ends.tolist()]
            sha = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(at, at[1:], strict=False)]
            own = [hashlib.sha256(back[x:y]).hexdigest() for x, y in zip([0, *byte_ends], byte_ends, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(sha, pa.string()), pa.array(own, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
