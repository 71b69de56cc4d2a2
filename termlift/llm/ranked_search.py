"""Ranked lexical search: windowed bucket scoring.

The first pass over the documents writes an index of the query terms: a window is up to `window` consecutive documents of
a partition, one row, with the documents' ids and lengths and, term by term, the slots of the documents that hold it and how
often. Totals and document frequencies are sums over windows. The second pass scores: a posting's share of the score
depends on the term and the document alone, so it is computed once a window; then each query traverses the postings
of its terms and adds their shares into one array with a bucket for each slot, which stays in the cache. Bit sets
of the terms, joined, say which slots were met, and only these are harvested into the query's heap of `k`, kept for the
whole partition, and set back. What partitions hold is ranked at the end.

    w = floor(1000 ln((2N + 2) / (2 df + 1)))     m = 100 - 75 + (75 n N) div L
    score = sum over the query's terms, repeats included, of w ((10^9 tf) div (1000 tf + 8 m))

Terms are the maximal runs of letters and digits of ASCII and of all characters beyond it, A to Z lower-cased. Queries are taken in
blocks of at most `block_bytes` of text, by a hash, each with a pass of its own, so what a task is sent has a bound;
a single longer query is a block. Rows to be ranked at the end are k for each query and partition, never all scores.

Defined cases: a null or empty text has no terms, is not counted and never found; a text of any length is read whole,
in parts cut between terms; equal scores go by ascending doc_id, null last, rows that repeat a doc_id are documents of their own;
rows that repeat an item are items of their own; an item without a term, or whose terms no document holds, has no
result, nor has an empty table; further columns of either table, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import forget, text_parts, word_spans, written

K, WINDOW, BLOCK_BYTES = 10, 8192, 1 << 24
#: Postings after which a window of long documents ends early.
MOST_POSTINGS = 1 << 21
#: Bytes that are no part of a term.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of rows of text end to end, and the index of each row's first one."""
    starts, ends, first = word_spans(data, offs, APART)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = _LOWER[data[~APART[data]]]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(letters.tobytes())]).dictionary_encode(), first


# ------------------------------------------------------------------ the index


class _Window:
    """Postings of consecutive documents, until they are one row of the index."""

    def __init__(self):
        self.ids, self.lengths, self.postings, self.size = [], [], [], 0

    def add(self, ids: pa.Array, lengths: np.ndarray, slots: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        self.ids.append(ids), self.lengths.append(lengths), self.postings.append((slots, terms, tf))
        self.size += len(terms)

    def row(self) -> pa.RecordBatch:
        slots, terms, tf = (np.concatenate([p[i] for p in self.postings]) for i in range(3))
        order = np.lexsort((slots, terms))
        slots, terms, tf = slots[order], terms[order], tf[order]
        first = np.flatnonzero(np.diff(terms, prepend=-1))
        raw = lambda a, kind: pa.array([a.astype(kind).tobytes()], pa.binary())
        lengths = np.concatenate(self.lengths)
        ids = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(self.ids).cast(pa.int64()))
        cols = [ids, raw(lengths, "<i8"), raw(terms[first], "<i4"), raw(np.append(first, len(terms)), "<i4"), raw(slots, "<u2"), raw(tf, "<i4"), pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["ids", "lengths", "terms", "starts", "slots", "tf", "n_docs", "n_terms"])


_INDEX = "ids array<long>, lengths binary, terms binary, starts binary, slots binary, tf binary, n_docs long, n_terms long"


def index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a window, as _INDEX has it: a term is its place in the vocabulary, and its postings are slots[starts[i]:starts[i + 1]]."""
    if not 0 < window <= 1 << 16:
        raise ValueError(f"window must lie between 1 and 65536, not {window}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_, n = pa.array(vocabulary, pa.binary()), _Window(), 0
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray, int]] = []  # of a row that is not at its end
            for i, j, data, offs, whole in text_parts(batch.column(1), APART):
                found, first = _terms(data, offs)
                place = pa.compute.index_in(found.dictionary, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                terms = place[found.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
                rows = np.repeat(np.arange(j - i), np.diff(first))
                keys, tf = np.unique(rows[terms >= 0] * len(vocabulary) + terms[terms >= 0], return_counts=True)
                lengths = np.diff(first)
                if not whole or held:
                    held.append((keys, tf, int(lengths.sum())))
                    if not whole:
                        continue
                    keys, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                    tf = np.bincount(back, np.concatenate([h[1] for h in held]), len(keys)).astype(np.int64)
                    lengths, held = np.array([sum(h[2] for h in held)]), []
                at = 0
                while at < j - i:
                    upto = min(j - i, at + window - n)
                    a, b = np.searchsorted(keys, [at * len(vocabulary), upto * len(vocabulary)])
                    open_.add(batch.column(0).slice(i + at, upto - at), lengths[at:upto], keys[a:b] // len(vocabulary) - at + n, keys[a:b] % len(vocabulary), tf[a:b])
                    n, at = n + upto - at, upto
                    if n == window or open_.size >= MOST_POSTINGS:
                        yield open_.row()
                        open_, n = _Window(), 0
        if n:
            yield open_.row()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _INDEX)


def frequencies(windows: DataFrame) -> DataFrame:
    """(term, df) from the numbers of postings, combined before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cols = [pa.array(np.frombuffer(terms, "<i4")), pa.array(np.diff(np.frombuffer(starts, "<i4")).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["term", "df"])

    return windows.select("terms", "starts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


# ------------------------------------------------------------------ scoring


class _Scorer:
    """One window's shares, and the buckets in which queries add them up."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = row["ids"]
        lengths = np.frombuffer(row["lengths"], "<i8")
        terms, self.starts, slots, tf = (np.frombuffer(row[c], k) for c, k in (("terms", "<i4"), ("starts", "<i4"), ("slots", "<u2"), ("tf", "<i4")))
        self.slots, tf = slots.astype(np.int64), tf.astype(np.int64)
        m = 100 - 75 + 75 * lengths * n_docs // n_terms
        self.shares = np.repeat(weights[terms], np.diff(self.starts)) * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.slots]))
        self.at = dict(zip(terms.tolist(), range(len(terms))))
        self.buckets = np.zeros(len(lengths), np.int64)
        self.bits: dict[int, int] = {}

    def _bits_of(self, i: int) -> int:
        """The slots of a term's postings as a bit set."""
        if i not in self.bits:
            met = np.zeros(-(-len(self.buckets) // 8) * 8, np.uint8)
            met[self.slots[self.starts[i] : self.starts[i + 1]]] = 1
            self.bits[i] = int.from_bytes(np.packbits(met, bitorder="little").tobytes(), "little")
        return self.bits[i]

    def harvest(self, query: list[tuple[int, int]], heap: list, k: int) -> None:
        """Add up the shares of the query's terms and offer what was met to its heap of (score, -id or so)."""
        occupied = 0
        for term, times in query:
            i = self.at.get(term)
            if i is None:
                continue
            a, b = self.starts[i], self.starts[i + 1]
            self.buckets[self.slots[a:b]] += self.shares[a:b] if times == 1 else times * self.shares[a:b]
            occupied |= self._bits_of(i)
        if not occupied:
            return
        size = -(-len(self.buckets) // 8)
        met = np.flatnonzero(np.unpackbits(np.frombuffer(occupied.to_bytes(size, "little"), np.uint8), bitorder="little"))
        scores = self.buckets[met]
        self.buckets[met] = 0
        least = heap[0][0] if len(heap) == k else 1
        good = np.flatnonzero(scores >= max(1, least))
        if len(good) > 4 * k:  # only those that can be among the k best of this window, with all that tie
            good = good[scores[good] >= np.partition(scores[good], len(good) - k)[len(good) - k]]
        for s, slot in zip(scores[good].tolist(), met[good].tolist()):
            found = self.ids[slot]
            entry = (s, -math.inf if found is None else -found)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _scored(windows: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of each query in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                scorer = _Scorer(batch.slice(i, 1).to_pylist()[0], weights, n_docs, n_terms)
                for q, query in queries:
                    scorer.harvest(query, heaps.setdefault(q, []), k)
        rows = [(q, None if d == -math.inf else -d, s) for q, heap in heaps.items() for s, d in heap]
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(cols, names=["query", "doc_id", "score"])

    return windows.select("ids", "lengths", "terms", "starts", "slots", "tf").mapInArrow(run, "query long, doc_id long, score long")


def _counted(text: str) -> dict[bytes, int]:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    found, _ = _terms(data, np.array([0, len(data)]))
    return dict(zip(found.dictionary.to_pylist(), np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)).tolist())) if len(found) else {}


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    rows = items.select(F.monotonically_increasing_id().alias("query"), F.col(item_id_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # twice as many as would do if the hash were even
    blocks = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    found = None
    for b in range(blocks):
        chosen = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("query"), F.lit(blocks)) == b))
        counted = [(r.query, _counted(r.text)) for r in chosen.select("query", "text").toLocalIterator()]
        vocabulary = sorted({t for _, c in counted for t in c})
        if not vocabulary:
            continue
        windows = written(index(docs, vocabulary, id_col, text_col, window), "windows")
        sums = windows.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
        if not sums["l"]:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        for r in frequencies(windows).toLocalIterator():
            weights[r.term] = math.floor(1000 * math.log((2 * sums["n"] + 2) / (2 * r.df + 1)))
        place = {t: i for i, t in enumerate(vocabulary)}
        queries = [(q, sorted((place[t], n) for t, n in c.items())) for q, c in counted]
        part = written(_scored(windows, queries, weights, sums["n"], sums["l"], k), "scored")
        forget(spark, windows)
        found = part if found is None else found.unionByName(part)
    kind = dict(rows.dtypes)["item"]
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long").withColumnRenamed("item_id", item_id_col).withColumnRenamed("doc_id", id_col)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(rows.select("query", "item"), "query").select(F.col("item").alias(item_id_col), "rank", F.col("doc_id").alias(id_col), "score")
