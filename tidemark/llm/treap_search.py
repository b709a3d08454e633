"""Ranked lexical search over inverted treaps.

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased. One pass over the documents counts the terms that the queries hold
(a document's other terms only count in its length) and writes postings; the
corpus figures N, L and each term's df come from all documents. A second pass
takes each task's documents in segments of bounded size. A segment has one treap
for each term: search order is the documents' (by id), heap order is the impact
in the score, so a subtree's root bounds all documents below it. A query walks
its terms' treaps together: a range of documents whose roots' impacts sum to too
little for the k best so far is dropped, else it is split at the document of the
largest impact, which is scored. Segments share a task's k best; a window over
the tasks' k best gives the result. Nothing is sampled or cut: the walk is exact.

Queries are taken in blocks of at most QUERY_BYTES of text, of at least one
query each; only a block's terms are sent to the tasks.

Null and term-free texts match nothing. Rows that repeat an id are documents of
their own, null ids sort last. Of equal scores the lower id comes first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch

QUERY_BYTES = 4 << 20
#: Postings of one segment, cells (ranges by terms) of one step of a walk, and bytes of a text that are split at once.
SEGMENT, CELLS, SLICE = 1 << 20, 1 << 15, 4 << 20
#: ASCII bytes that end a term become spaces; bytes from 128 on belong to characters that don't.
CLEAN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term stands in a UTF-8 text, a slice at a time."""
    text = text.lower().translate(CLEAN)
    counts, at = Counter(), 0
    while at < len(text):
        end = len(text) if len(text) - at <= SLICE else text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        counts.update(text[at:end].split())
        at = end
    return counts


@dataclass
class Query:
    """A query row: its id and its terms with how often each stands in it."""

    item_id: object
    terms: Counter


def _blocks(items: DataFrame, item_id: str, text: str, scratch: Scratch) -> Iterator[list[Query]]:
    """The queries in blocks of bounded text; the text of one block at a time is on the driver."""
    rows = items.select(F.col(item_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n > QUERY_BYTES:
        rows = scratch.save(rows.repartitionByRange(F.col("id")), "queries")
    block, held = [], 0
    for row in rows.toLocalIterator():
        size = len(row.text)
        if block and held + size > QUERY_BYTES:
            yield block
            block, held = [], 0
        block.append(Query(row.id, term_counts(row.text.encode())))
        held += size
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """Each document's id, length n in terms, and the vocabulary's terms in it with their counts."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, terms, tfs = [], [], []
            for value in batch.column(1):
                found = term_counts(value.as_buffer().to_pybytes()) if value.is_valid else Counter()
                hit = [*(found.keys() & vocabulary.keys())]
                length.append(found.total())
                terms.append([vocabulary[t] for t in hit])
                tfs.append([found[t] for t in hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(length, pa.int64()), pa.array(terms, arrow.field(2).type), pa.array(tfs, arrow.field(3).type)], schema=arrow)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, schema)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term's occurrences count in a document of n terms, before the term's weight; all in 64-bit integers."""
    m = 25 + (75 * n * documents) // max(length, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Treaps:
    """The treaps of one segment: a node is a posting, ``left`` and ``right`` its children, ``root`` a term's topmost node.

    Nodes lie by term and place of the document; one empty node of infinite rank stands after each term's.
    """

    def __init__(self, term: np.ndarray, place: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((place, term))
        shift = np.arange(len(order)) + (1 + term[order])
        size = len(order) + n_terms + 1
        self.place, self.impact = np.full(size, -1, np.int32), np.zeros(size, np.int64)
        self.place[shift], self.impact[shift] = place[order], impact[order]
        node = np.arange(size)
        # equal impacts are ranked by a hash of the node, so that runs of copies give no long paths
        rank = np.where(self.place < 0, np.int64(1) << 62, (self.impact << 32) + (node * 2654435761 & 0xFFFFFFFF))
        before, after = self._greater(rank, -1), self._greater(rank, 1)
        real = self.place >= 0
        self.nil = size - 1
        self.left, self.right = np.full(size, self.nil, np.int32), np.full(size, self.nil, np.int32)
        lower = rank[before] < rank[after]
        top = real & (self.place[before] < 0) & (self.place[after] < 0)
        a, b = node[real & lower & ~top], node[real & ~lower & ~top]
        self.right[before[a]], self.left[after[b]] = a, b
        self.root = np.full(n_terms, self.nil, np.int32)
        self.root[np.cumsum(self.place < 0)[node[top]] - 1] = node[top]

    @staticmethod
    def _greater(rank: np.ndarray, step: int) -> np.ndarray:
        """For each node the nearest one of higher rank before (step -1) or after it, by jumping over those known to be lower."""
        at = np.clip(np.arange(len(rank)) + step, 0, len(rank) - 1)
        todo = np.flatnonzero(rank[at] < rank)
        while len(todo):
            at[todo] = at[at[todo]]
            todo = todo[rank[at[todo]] < rank[todo]]
        return at

    def within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Below each node the topmost one in its row's range of places [low, high)."""
        out = nodes.copy()
        flat, wide = out.reshape(-1), out.shape[1]
        at = self.place[flat].reshape(out.shape)
        todo = np.flatnonzero(((at < low[:, None]) | (at >= high[:, None])) & (out != self.nil))
        while len(todo):
            cur, row = flat[todo], todo // wide
            cur = np.where(self.place[cur] >= high[row], self.left[cur], self.right[cur])
            flat[todo] = cur
            at = self.place[cur]
            todo = todo[((at < low[row]) | (at >= high[row])) & (cur != self.nil)]
        return out


class Best:
    """The k best of one query: score, then id, nulls last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def bar(self) -> int:
        """The score that a document needs at least."""
        return -self.rows[-1][0] if len(self.rows) >= self.k else 1

    def offer(self, scores: np.ndarray, ids: list) -> None:
        self.rows = sorted(self.rows + [(-int(s), i is None, i if i is not None else 0) for s, i in zip(scores, ids, strict=True)])[: self.k]

    def beaten(self, doc_id: object) -> bool:
        """Whether a document of this id or a later one, at the bar, would come after the k-th."""
        return len(self.rows) >= self.k and (doc_id is None, doc_id if doc_id is not None else 0) >= self.rows[-1][1:]


def walk(treaps: Treaps, roots: np.ndarray, weight: np.ndarray, ids: list, best: Best) -> int:
    """Offer ``best`` every document that can enter it; returns how many were scored. ``ids`` is in search order."""
    width = max(1, CELLS // max(1, len(roots)))
    first = roots[None, :].astype(np.int32)
    stack = [(first, np.zeros(1, np.int32), np.full(1, len(ids), np.int32), (treaps.impact[first] * weight).sum(axis=1))]
    seen = 0
    while stack:
        nodes, low, high, bound = stack.pop()
        go = bound >= best.bar
        tie = np.flatnonzero(go & (bound == best.bar))
        go[tie] = [not best.beaten(ids[p]) for p in low[tie].tolist()]
        if not go.any():
            continue
        nodes, low, high = nodes[go], low[go], high[go]
        split = treaps.place[nodes[np.arange(len(nodes)), (treaps.impact[nodes] * weight).argmax(axis=1)]]
        score = (treaps.impact[treaps.within(nodes, split, split + 1)] * weight).sum(axis=1)
        seen += len(score)
        enter = np.flatnonzero(score >= best.bar)
        best.offer(score[enter], [ids[p] for p in split[enter].tolist()])
        low, high = np.concatenate([low, split + 1]), np.concatenate([split, high])
        some = np.flatnonzero(low < high)
        low, high = low[some], high[some]
        nodes = treaps.within(nodes[some % len(split)], low, high)
        bound = (treaps.impact[nodes] * weight).sum(axis=1)
        some = np.flatnonzero(bound >= best.bar)
        some = some[np.argsort(bound[some], kind="stable")]  # the highest bounds on top of the stack
        for a in range(0, len(some), width):
            part = some[a : a + width]
            stack.append((nodes[part], low[part], high[part], bound[part]))
    return seen


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of SEGMENT postings or of one batch."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(2).flatten())
        if size >= SEGMENT:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _search(index: DataFrame, block: list[Query], vocabulary: dict[bytes, int], weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """The k best of each task for each query of the block, as (query, doc_id, score)."""
    kind = index.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)
    wanted = []
    for q in block:
        terms = np.array([vocabulary[t] for t in q.terms], np.int64)
        own = weight[terms] * np.array([*q.terms.values()], np.int64)
        wanted.append((terms[own > 0], own[own > 0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in wanted]
        for table in _segments(batches):
            ids = table.column(0).to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            place = np.empty(len(ids), np.int32)
            place[order] = np.arange(len(ids))
            ids = [ids[i] for i in order]
            lists = table.column(2).combine_chunks()
            each = np.diff(lists.offsets.to_numpy())
            term, tf = lists.flatten().to_numpy(), table.column(3).combine_chunks().flatten().to_numpy()
            n = np.repeat(table.column(1).to_numpy(), each)
            treaps = Treaps(term.astype(np.int64), np.repeat(place, each), impacts(tf, n, documents, length), len(weight))
            for (terms, own), top in zip(wanted, best, strict=True):
                roots = treaps.root[terms]
                there = roots != treaps.nil
                if there.any():
                    walk(treaps, roots[there], own[there], ids, top)
        rows = [(q, None if null else i, -s) for q, top in enumerate(best) for s, null, i in top.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ([], [], []), arrow, strict=True)], schema=arrow)

    return index.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k highest-scoring documents of each item with a score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    ids = T.StructType([T.StructField("item_id", items.schema[item_id].dataType)])
    parts = []
    for b, block in enumerate(_blocks(items, item_id, item_text, scratch)):
        vocabulary = {t: i for i, t in enumerate(sorted({t for q in block for t in q.terms}))}
        figures = [F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")]
        index, seen = scratch.save_seen(postings(docs, vocabulary, doc_id, text), f"postings-{b}", *figures)
        index = index.where(F.size("terms") > 0)
        df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator())
        documents, length = seen["documents"], seen["length"]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
        found = _search(index, block, vocabulary, weight, documents, length, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, q.item_id) for i, q in enumerate(block)], T.StructType([T.StructField("query", T.IntegerType()), *ids.fields]))
        parts.append(scratch.save(ranked.join(names, "query").select("item_id", "rank", "doc_id", "score"), f"found-{b}"))
    if not parts:
        return spark.createDataFrame([], T.StructType([*ids.fields, T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())]))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
