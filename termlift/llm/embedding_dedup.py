"""Near-duplicate embeddings by Euclidean p-stable hashing (Datar et al., 2004).

Vectors of length one at cosine c lie sqrt(2 - 2c) apart. A table's key is k quantised random
projections floor((a.v + b) / w); vectors that share a key in any table are compared, in the end by their exact
cosine in double precision. k follows from the number of rows, so that unrelated vectors share a key
with about `bucket` others; the number of tables follows from k and the recall wanted for a pair that
lies just at the threshold (closer pairs are found with higher probability); w is the width that needs the fewest tables.

1. Identical vectors are one class, known by a 128-bit hash; only classes are hashed into buckets and compared,
   and a link counts all copies.
2. To its bucket in each table a class sends its number and a sketch of 256 sign bits, not its vector. Pairs whose sketches
   differ in more bits than a pair at the threshold does (but for one in a million) are dropped, and what is left of a
   bucket falls into small groups of linked classes. Groups that several tables find alike are one.
3. The vectors travel to these groups only, where all pairs are compared exactly. A pair that shares keys in several
   tables counts in the first only, which is seen from the keys that travel with the vectors.

A bucket of more than `block` classes is compared in pairs of blocks of about that many, so one with a third of all
classes is spread over many tasks. Tasks return a count and a local root for each class, never the pairs.

Defined cases: a vector that is null, empty, zero or has null or non-finite components links with
nothing, nor does a row with a null id; vectors of different lengths are not compared; repeated rows
are vectors of their own and count as links; an empty table gives an empty result; further columns
of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import components, forget, group_starts, local_roots, mix64, whole_groups, written

_U = np.uint64
THRESHOLD, BUCKET, BLOCK, RECALL, BITS, MISSED, SEED = 0.9, 512, 1024, 0.95, 256, 1e-6, 20240901
_WIDTHS = [x / 20 for x in range(8, 80)]


def collision(distance: float, width: float) -> float:
    """Probability that one quantised projection agrees for two vectors so far apart."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(rows: int, threshold: float = THRESHOLD, bucket: int = BUCKET, recall: float = RECALL) -> tuple[int, int, float]:
    """(projections a table, tables, width) for so many rows; unrelated vectors are taken to be orthogonal."""

    def at(width: float) -> tuple[int, int, float]:
        far, near = collision(math.sqrt(2), width), collision(math.sqrt(2 - 2 * threshold), width)
        k = max(3, math.ceil(math.log(max(rows, 1) / bucket) / -math.log(far)))
        return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k)))), width

    return min(map(at, _WIDTHS), key=lambda p: (p[1], p[0], p[2]))


def most_differing(threshold: float, bits: int = BITS, missed: float = MISSED) -> int:
    """The fewest sign bits that a pair at the threshold exceeds with at most this probability."""
    p, above = math.acos(threshold) / math.pi, 1.0
    for n in range(bits + 1):
        above -= math.comb(bits, n) * p**n * (1 - p) ** (bits - n)
        if above <= missed:
            return n
    return bits


def _matrix(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) for each length that occurs; vectors with any fault are left out."""
    wide = pa.types.is_large_list(col.type)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col)].astype(np.int64)
    values = col.values.to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        x = values[offs[rows][:, None] + np.arange(d)]
        with np.errstate(all="ignore"):
            y = x.astype(np.float64)
            good = np.isfinite(y).all(1) & (np.abs(y).max(1) > 0)
        yield rows[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # lengths neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hasher(k: int, tables: int, width: float, seed: int):
    """rid, id and vectors to rid, id, the vector's bytes, its key in each table and its sketch (null for vectors with a fault)."""
    names = ["rid", "id", "item", "vec", "keys", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            faulty = np.ones(batch.num_rows, bool)
            for rows, x in _matrix(batch.column(2)):
                if not len(rows):
                    continue
                faulty[rows] = False
                d = x.shape[1]
                if d not in drawn:
                    rng = np.random.default_rng([seed, d])
                    drawn[d] = rng.standard_normal((d, k * tables)), rng.random(k * tables) * width, rng.standard_normal((d, BITS))
                a, b, signs = drawn[d]
                unit = _unit(x)
                q = np.floor((unit @ a + b) / width).astype(np.int64).astype(_U).reshape(len(rows), tables, k)
                h = np.full((len(rows), tables), _U(d))
                for j in range(k):
                    h = mix64(h * _U(0x9E3779B97F4A7C15) + q[:, :, j])
                keys = (h >> _U(33)).astype(np.int32)
                sketch = np.packbits(unit @ signs > 0, axis=1)
                raw = x if x.dtype in (np.float32, np.float64) else x.astype(np.float64)
                take = pa.array(rows)
                edges = pa.array(np.arange(0, len(rows) * tables + 1, tables), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array(np.full(len(rows), raw.dtype.itemsize, np.int32)),
                        pa.array([r.tobytes() for r in raw], pa.binary()),
                        pa.ListArray.from_arrays(edges, pa.array(keys.ravel())),
                        pa.array([r.tobytes() for r in sketch], pa.binary()),
                    ],
                    names=names,
                )
            if faulty.any():
                left, n = pa.array(np.flatnonzero(faulty)), int(faulty.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(left), batch.column(1).take(left), *(pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary()))], names=names)

    return run


def _grouper(threshold: float):
    """Sketches sorted by bucket and pair of blocks to groups of linked classes: grp, side (of a pair of two blocks), tbl, rid."""
    most = most_differing(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "blocks"]):
            bucket, blocks, blk, rid = (table.column(c).to_numpy() for c in ("bucket", "blocks", "blk", "rid"))
            sketch = np.frombuffer(b"".join(x.as_py() for x in table.column("sketch")), np.uint8).reshape(len(rid), -1)
            out: list[list[np.ndarray]] = [[], [], [], []]
            cuts = group_starts([bucket, blocks])
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e - s < 2:
                    continue
                bits = np.unpackbits(sketch[s:e], axis=1).astype(np.float32) * 2 - 1
                lo, hi = int(blocks[s]) >> 21, int(blocks[s]) & 0x1FFFFF
                least = BITS - 2 * most
                if lo == hi:
                    side = np.full(e - s, -1, np.int32)
                    a, b = np.nonzero(np.triu(bits @ bits.T >= least, 1))
                else:
                    side = (blk[s:e] == hi).astype(np.int32)
                    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                    a, b = np.nonzero(bits[left] @ bits[right].T >= least)
                    a, b = left[a], right[b]
                if not len(a):
                    continue
                root = local_roots(e - s, np.minimum(a, b), np.maximum(a, b))
                hit = np.unique(np.concatenate([a, b]))
                # a group is known by its members, in whatever order and table they are found
                mark = mix64(rid[s:e][hit].astype(_U) * _U(4) + (side[hit] + 1).astype(_U))
                total = np.zeros(e - s, _U)
                np.add.at(total, root[hit], mark)
                out[0].append(mix64(total[root[hit]]).view(np.int64)), out[1].append(side[hit])
                out[2].append(np.full(len(hit), bucket[s] >> 32, np.int32)), out[3].append(rid[s:e][hit])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names=["grp", "side", "tbl", "rid"])

    return run


def _comparer(threshold: float):
    """Vectors sorted by group to rid, id, n (links that count here) and root (the smallest id that is linked here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["grp", "tbl"]):
            grp, tbl, side, rid, ids, copies, item = (table.column(c).to_numpy() for c in ("grp", "tbl", "side", "rid", "id", "copies", "item"))
            vec = table.column("vec").combine_chunks()
            keys = np.asarray(pa.concat_arrays([c.flatten() for c in table.column("keys").chunks])).reshape(len(rid), -1)
            out_r, out_i, out_n, out_root = [], [], [], []
            cuts = group_starts([grp, tbl])
            for s, e in zip(cuts[:-1], cuts[1:]):
                raw = [np.frombuffer(v.as_buffer(), np.float32 if w == 4 else np.float64).astype(np.float64) for v, w in zip(vec[s:e], item[s:e])]
                sizes = np.array([len(r) for r in raw])
                for d in np.unique(sizes):  # several only by a shared key by chance
                    part = np.flatnonzero(sizes == d)
                    rows, x = s + part, _unit(np.stack([raw[i] for i in part]))
                    left, right = (np.flatnonzero(side[rows] != 1 - k) for k in (0, 1))
                    a, b = np.nonzero(x[left] @ x[right].T >= threshold)
                    a, b = left[a], right[b]
                    one = side[rows[a]] == -1  # within a block each pair is met twice
                    a, b = a[~one | (a < b)], b[~one | (a < b)]
                    t, fresh = int(tbl[s]), np.empty(len(a), bool)
                    for f in range(0, len(a), 65536):
                        g = slice(f, f + 65536)
                        same = keys[rows[a[g]], : t + 1] == keys[rows[b[g]], : t + 1]
                        fresh[g] = same[:, t] & ~same[:, :t].any(1)
                    a, b = a[fresh], b[fresh]
                    if not len(a):
                        continue
                    n = np.zeros(len(part), np.int64)
                    np.add.at(n, a, copies[rows[b]])
                    np.add.at(n, b, copies[rows[a]])
                    order = np.argsort(ids[rows], kind="stable")  # so that a local root has the smallest id
                    rank = np.empty(len(part), np.int64)
                    rank[order] = np.arange(len(part))
                    root = order[local_roots(len(part), rank[a], rank[b])[rank]]
                    hit = np.flatnonzero(n)
                    out_r.append(rid[rows[hit]]), out_i.append(ids[rows[hit]]), out_n.append(n[hit]), out_root.append(ids[rows[root[hit]]])
            if out_r:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in (out_r, out_i, out_n, out_root)], names=["rid", "id", "n", "root"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per vector: the id, n_links, component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    k, tables, width = plan(vectors.count(), threshold, bucket, recall)
    base = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.when(F.col(id_col).isNotNull(), F.col(vector_col)).alias("v"))
    seen = base.mapInArrow(_hasher(k, tables, width, seed), "rid long, id long, item int, vec binary, keys array<int>, sketch binary")
    known = F.col("vec").isNotNull()
    seen = written(seen.withColumns({"h1": F.when(known, F.xxhash64("item", "vec")), "h2": F.when(known, F.xxhash64(F.lit(1), "item", "vec"))}), "hashed")
    of_class = seen.where("h1 is not null").groupBy("h1", "h2")
    classes = written(of_class.agg(F.min("id").alias("id"), F.min("rid").alias("rid"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "classes")

    light = classes.select("rid", "sketch", F.posexplode("keys").alias("tbl", "key")).select("rid", "sketch", (F.shiftleft(F.col("tbl").cast("long"), 32) + F.col("key")).alias("bucket"))
    # at most one row for every `block` rows of light, and a table of its own: the planner knows whether it is small
    heavy = written(light.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block), "heavy")
    parts = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(block)).cast("int")
    dealt = light.join(heavy, "bucket", "left").withColumn("parts", parts).withColumn("blk", F.pmod(F.xxhash64("rid", F.lit(7)), "parts").cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("bucket", (F.shiftleft(F.least("blk", "other"), 21) + F.greatest("blk", "other")).alias("blocks"), "blk", "rid", "sketch")
    linked = dealt.repartition("bucket", "blocks").sortWithinPartitions("bucket", "blocks").mapInArrow(_grouper(threshold), "grp long, side int, tbl int, rid long")
    groups = written(linked.groupBy("grp", "side", "rid").agg(F.min("tbl").alias("tbl")), "groups")
    fat = groups.join(seen.select("rid", "item", "vec", "keys"), "rid").join(classes.select("rid", "id", "copies"), "rid")
    found = written(fat.repartition("grp", "tbl").sortWithinPartitions("grp", "tbl").mapInArrow(_comparer(threshold), "rid long, id long, n long, root long"), "links")
    links = found.groupBy("rid").agg(F.sum("n").alias("n"))
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    facts = classes.join(links, "rid", "left").join(comps, F.col("id") == F.col("node"), "left")
    facts = facts.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # a table of its own, so that the join's two sides are plain exchanges and a large class is split
    facts = written(facts, "facts")
    forget(spark, classes, heavy, groups, found)
    out = seen.select("rid", "id", "h1", "h2").join(facts, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
