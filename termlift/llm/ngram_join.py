"""Jaccard similarity join on word n-grams with Bayesian candidate pruning (BayesLSH, Satuluri and
Parthasarathy, 2012).

1. A text's words are `[^\\x20\\x09-\\x0D]+`; its shingles are the runs of `n` words, as 64-bit hashes (a text
   of fewer words has one shingle, all its words). Texts with the same words are one class, known by a
   128-bit hash; the class's smallest document id represents it.
2. Classes that share all values of a band of the MinHash signature are candidates. With 24 bands of 4 a
   pair at similarity 0.8 is missed with probability 4e-6, closer pairs with less.
3. Candidates' signatures are compared a few values at a time. With a uniform prior, after m of k agree,
   the similarity is at least t with probability P(Binomial(k + 1, t) <= m); a pair for which that falls
   below the tolerance is dropped.
4. What is left is verified exactly on the whole shingle sets.

A bucket is compared in pairs of blocks (see _shared.blocked), so that one of any size is spread over
many groups, and a pair counts in the first band it shares only. Steps 3 and 4 return counts and local
roots for each class, never the pairs; texts travel only for classes with a pair that survived step 3.

Defined cases: a text that is null or has no word links with nothing, nor does a row whose id is null;
rows that repeat an id are one document for components, and each repeated text counts as a link; a pair exactly at the
threshold links, and of several documents the smallest id names the component; a text of any length is shingled whole; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import blocked, components, group_starts, local_roots, mix64, runs_hashes, sequence_hashes, text_steps, whole_groups, word_hashes, word_spans, written

_U = np.uint64
N, THRESHOLD, BANDS, ROWS, TOLERANCE, BLOCK, CHUNK, SEED = 5, 0.8, 24, 4, 1e-6, 768, 16, 77


def shingles(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, the index of each row's first one, and the rows' 128-bit hashes."""
    starts, ends, first = word_spans(buf, offs)
    words = word_hashes(buf, starts, ends)
    one, two = sequence_hashes(words, first)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    keep = np.arange(len(words)) + n <= first[1:][row] if len(words) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        keep[first[short]] = True
    out = runs_hashes(words, n)
    if len(short):
        out[first[short]] = one[short]
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    return out[keep], np.concatenate([[0], np.cumsum(per)]), one, two


@cache
def _functions(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) * _U(2) + _U(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signatures(hashes: np.ndarray, first: np.ndarray, k: int, seed: int) -> np.ndarray:
    """MinHash values (rows with no shingle: zeros)."""
    out = np.zeros((len(first) - 1, k), np.uint32)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        a, b = _functions(k, seed)
        at = first[some]
        for j in range(k):
            out[some, j] = np.minimum.reduceat(((hashes * a[j] + b[j]) >> _U(32)).astype(np.uint32), at)
    return out


@cache
def least_matches(k: int, threshold: float, tolerance: float) -> int:
    """The fewest of k matches with which a pair is kept."""
    below = 0.0
    for m in range(k + 1):
        below += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        if below >= tolerance:
            return m
    return k


def _signer(n: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in text_steps(batch.column(1)):
                hashes, first, one, two = shingles(buf, offs, n)
                sig = signatures(hashes, first, bands * rows, seed)
                some = np.diff(first) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(one.view(np.int64), mask=~some),
                        pa.array(two.view(np.int64), mask=~some),
                        pa.array([x.tobytes() for x in sig], pa.binary(), mask=~some),
                    ],
                    names=["id", "c1", "c2", "sig"],
                )

    return run


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = sig.reshape(len(sig), bands, rows).astype(_U)
    h = np.tile(np.arange(bands, dtype=_U) + _U(1), (len(sig), 1))
    for j in range(rows):
        h = mix64(h * _U(0x9E3779B97F4A7C15) + s[:, :, j])
    return h.view(np.int64)


def _bander(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(1)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), bands))),
                        pa.array(np.tile(np.arange(bands, dtype=np.int32), len(sig))),
                        pa.array(_band_keys(sig, bands, rows).ravel()),
                    ],
                    names=["rep", "band", "key"],
                )

    return run


def _candidates(cuts: np.ndarray, lo: np.ndarray, hi: np.ndarray, blk: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows to compare, group by group for large groups and across all small ones."""
    size = np.diff(cuts)
    small = size <= 16
    within = np.repeat(cuts[1:], size)
    fits = np.repeat(small, size)
    for d in range(1, int(size[small].max(initial=1))):
        a = np.flatnonzero(fits & (np.arange(len(within)) + d < within))
        b = a + d
        use = (lo[a] == hi[a]) | (blk[a] != blk[b])
        if use.any():
            yield a[use], b[use]
    for g in np.flatnonzero(~small):
        s, e = cuts[g], cuts[g + 1]
        if lo[s] == hi[s]:
            left = right = np.arange(s, e)
        else:
            left, right = s + np.flatnonzero(blk[s:e] == lo[s]), s + np.flatnonzero(blk[s:e] == hi[s])
        for f in range(0, len(left), 32):
            a, b = np.repeat(left[f : f + 32], len(right)), np.tile(right, len(left[f : f + 32]))
            if left is right:
                use = a < b
                a, b = a[use], b[use]
            if len(a):
                yield a, b


def _survivors(sig: np.ndarray, band: np.ndarray, pairs, bands: int, rows: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those that incremental comparison keeps and that share no earlier band."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    k = bands * rows
    for a, b in pairs:
        same = np.zeros(len(a), np.int64)
        for c in range(0, k, CHUNK):
            upto = min(c + CHUNK, k)
            same = same + (sig[a, c:upto] == sig[b, c:upto]).sum(1)
            keep = same >= least_matches(upto, threshold, tolerance)
            if not keep.all():
                a, b, same = a[keep], b[keep], same[keep]
            if not len(a):
                break
        if len(a):
            shared = (sig[a] == sig[b]).reshape(len(a), bands, rows).all(2)
            keep = shared.any(1) & (shared.argmax(1) == band[a])
            out_a.append(a[keep]), out_b.append(b[keep])
    return np.concatenate(out_a), np.concatenate(out_b)


_GROUP = ["band", "key", "lo", "hi"]


def _read(table: pa.Table) -> dict:
    x = {c: table.column(c).to_numpy() for c in [*_GROUP, "blk", "rep", "copies"]}
    x["sig"] = np.stack([np.frombuffer(v.as_buffer(), np.uint32) for c in table.column("sig").chunks for v in c])
    x["cuts"] = group_starts([x[c] for c in _GROUP])
    return x


def _pruner(bands: int, rows: int, threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _GROUP):
            x = _read(table)
            a, b = _survivors(x["sig"], x["band"], _candidates(x["cuts"], x["lo"], x["hi"], x["blk"]), bands, rows, threshold, tolerance)
            if len(a):
                yield from table.take(pa.array(np.unique(np.concatenate([a, b])))).to_batches()

    return run


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(a) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = n[at] > 1
    column = np.cumsum(n > 1)[at[often]] - 1
    owner, width = owner[often], int((n > 1).sum())
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for f in range(0, width, 2048):
        s, e = np.searchsorted(column, [f, f + 2048])
        x = np.zeros((len(sets), min(2048, width - f)), np.float32)
        x[owner[s:e], column[s:e] - f] = 1
        total += x @ x.T
    return total[a, b].astype(np.int64)


def _verifier(n: int, bands: int, rows: int, threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _GROUP):
            sets, good = [], []
            c1, c2 = table.column("c1").to_numpy(), table.column("c2").to_numpy()
            done = 0
            for chunk in table.column("text").chunks:
                for i, j, buf, offs in text_steps(chunk):
                    hashes, first, one, two = shingles(buf, offs, n)
                    at = slice(done + i, done + j)
                    good.append((one.view(np.int64) == c1[at]) & (two.view(np.int64) == c2[at]))
                    sets += [np.unique(hashes[s:e]) for s, e in zip(first[:-1], first[1:])]
                done += len(chunk)
            good = np.flatnonzero(np.concatenate(good))  # not another row's text under a repeated id
            place = np.searchsorted(group_starts([table.column(c).to_numpy() for c in _GROUP]), good, "right")
            _, once = np.unique(np.stack([place, c1[good], c2[good]]), axis=1, return_index=True)
            good = good[np.sort(once)]  # nor the same class again for a repeated row
            x = _read(table.take(pa.array(good)))
            sets = [sets[i] for i in good]
            group = np.repeat(np.arange(len(x["cuts"]) - 1), np.diff(x["cuts"]))
            a, b = _survivors(x["sig"], x["band"], _candidates(x["cuts"], x["lo"], x["hi"], x["blk"]), bands, rows, threshold, tolerance)
            order = np.argsort(group[a], kind="stable")
            a, b = a[order], b[order]
            size = np.array([len(s) for s in sets], np.int64)
            links = np.zeros(len(sets), np.int64)
            root = np.arange(len(sets))
            ends = np.append(np.flatnonzero(np.diff(group[a])) + 1, len(a)) if len(a) else []
            p = 0
            for q in ends:
                s, e = x["cuts"][group[a[p]]], x["cuts"][group[a[p]] + 1]
                common = _common(sets[s:e], a[p:q] - s, b[p:q] - s)
                ok = common >= threshold * (size[a[p:q]] + size[b[p:q]] - common) - 1e-9
                i, j = a[p:q][ok], b[p:q][ok]
                np.add.at(links, i, x["copies"][j])
                np.add.at(links, j, x["copies"][i])
                order = np.argsort(x["rep"][s:e], kind="stable")
                rank = np.empty(e - s, np.int64)
                rank[order] = np.arange(e - s)
                root[s:e] = s + order[local_roots(e - s, rank[i - s], rank[j - s])[rank]]
                p = q
            hit = np.flatnonzero(links)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (c1[good][hit], c2[good][hit], x["rep"][hit], links[hit], x["rep"][root[hit]])], names=["c1", "c2", "rep", "n", "root"])

    return run


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per document: the id, class_id (smallest id with the same words), n_copies of that class,
    n_links (other documents at the threshold or above), component_id (smallest id reachable), kept."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(texts.mapInArrow(_signer(n, bands, rows, seed), "id long, c1 long, c2 long, sig binary"), "signed")
    of_class = signed.where("id is not null and c1 is not null").groupBy("c1", "c2")
    classes = written(of_class.agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")).withColumn("cid", F.monotonically_increasing_id()), "classes")

    light = classes.select("cid", "sig").mapInArrow(_bander(bands, rows), "rep long, band int, key long")
    light = written(light, "bands")
    counts = light.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    dealt = blocked(light.join(counts, ["band", "key"]), "key", F.col("rep"), "m", block)
    facts = classes.select("cid", "c1", "c2", "rep", "copies", "sig")
    fat = dealt.withColumnRenamed("rep", "cid").join(facts, "cid").select(*_GROUP, "blk", "c1", "c2", "rep", "copies", "sig")
    kinds = "band int, key long, lo int, hi int, blk int, c1 long, c2 long, rep long, copies long, sig binary"
    pruned = written(fat.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_pruner(bands, rows, threshold, tolerance), kinds), "pruned")

    needed = pruned.join(texts.withColumnRenamed("id", "rep"), "rep").select(*_GROUP, "blk", "c1", "c2", "rep", "copies", "sig", "text")
    found = needed.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_verifier(n, bands, rows, threshold, tolerance), "c1 long, c2 long, rep long, n long, root long")
    found = written(found, "links")
    links = found.groupBy("c1", "c2").agg(F.sum("n").alias("links"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    facts = classes.select("c1", "c2", "rep", "copies").join(links, ["c1", "c2"], "left").join(comps, F.col("rep") == F.col("node"), "left")
    facts = facts.select("c1", "c2", F.col("rep").alias("class_id"), F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # a table of its own, so that the join's two sides are plain exchanges and a large class is split
    out = signed.select("id", "c1", "c2").join(written(facts, "facts"), ["c1", "c2"], "left")
    alone = F.col("class_id").isNull() | F.col("id").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("component_id") == F.col("id"))).alias("kept"),
    )
