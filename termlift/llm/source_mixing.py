"""Mixing sources to target weights by cube-method balanced sampling (Deville and Tillé, 2004).

A source whose target is r times its size takes every document floor(r) times, and one time more with
inclusion probability r - floor(r). These fractional probabilities are balanced on two totals, words and
documents: in the flight phase any three undecided documents have a direction in which their probabilities
can move without changing either total, and they move, by a martingale step, until one of them is 0 or 1.
At most two are left undecided in a group, which is the landing problem.

The flight runs in groups of a source's documents dealt by a hash (a source with a third of all rows is
many groups), the undecided of all groups fly again in fewer groups, and so on until a source is one group;
its last few undecided documents land on the choice with the least error in words, then in documents. Short documents
fly first: a long one needs others of its kind to make up for it, and the sums of the few longest, left for the landing,
lie close together. Steps are drawn from a hash of the id and the seed, the order
of documents of one size is another hash, and groups are sorted, so reruns agree.

Defined cases: a null text has size 0; null is a source of its own, ordered last; documents of size 0 are
balanced by number only; rows that repeat an id are documents of their own; a source without words has
target 0 and takes its documents no more than it would a source of size 0; an empty table gives an empty
result; further columns of the input are ignored by `mix` and kept by `mixed_rows`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import few_rows, text_steps, word_spans, written

WEIGHTS, MOST, GROUP, LANDING, SEED = (5, 2, 1), 3, 8192, 16, 11


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, most: float = MOST, share: float = 1.0) -> dict[str | None, float]:
    """Target words of each source: in proportion to the weights, at most `most` times its size; what is
    cut off is shared by weight among the others until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total = list(order), share * sum(sizes.values())
    out: dict[str | None, float] = {}
    while left:
        whole = sum(weight[s] for s in left)
        above = [s for s in left if total * weight[s] / whole > most * sizes[s]]
        if not above:
            return out | {s: total * weight[s] / whole for s in left}
        for s in above:
            out[s] = float(most * sizes[s])
        total -= sum(out[s] for s in above)
        left = [s for s in left if s not in above]
    return out


def _flight(size: np.ndarray, p: np.ndarray, u: np.ndarray, stop: int) -> np.ndarray:
    """Move probabilities p, balanced on their sum and the sum of p * size, until at most `stop` lie
    strictly between 0 and 1 (or no three are left)."""
    p = p.astype(np.float64).copy()
    eps = 1e-9
    open_ = [int(i) for i in np.flatnonzero((p > eps) & (p < 1 - eps))]
    left = len(open_)
    x = size.astype(float).tolist()
    q = p.tolist()
    hand: list[int] = []
    for i in open_:
        hand.append(i)
        while len(hand) == 3 and left > max(stop, 2):
            a, b, c = hand
            # orthogonal to (1, 1, 1) and (x_a, x_b, x_c)
            v = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
            if v == (0.0, 0.0, 0.0):
                v = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for j, w in zip(hand, v):
                if w > 0:
                    up, down = min(up, (1 - q[j]) / w), min(down, q[j] / w)
                elif w < 0:
                    up, down = min(up, q[j] / -w), min(down, (1 - q[j]) / -w)
            step = up if u[a] * (up + down) < down else -down
            u[a] = (u[a] * 997.0 + 0.6180339887498949) % 1.0
            kept = []
            for j, w in zip(hand, v):
                q[j] += step * w
                if q[j] <= eps or q[j] >= 1 - eps:
                    q[j] = float(round(q[j]))
                    left -= 1
                else:
                    kept.append(j)
            if len(kept) == 3:  # only by rounding: the nearest to a bound is there
                j = min(kept, key=lambda j: min(q[j], 1 - q[j]))
                q[j] = float(round(q[j]))
                kept.remove(j)
                left -= 1
            hand = kept
        if len(hand) == 3:  # enough are decided
            break
    return np.array(q)


def _landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decide the last few: the choice with the least error in words, then in documents."""
    p = p.copy()
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    p[(p <= 1e-9)], p[p >= 1 - 1e-9] = 0.0, 1.0
    if len(open_):
        bits = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        words = np.abs(bits @ size[open_] - float(p[open_] @ size[open_]))
        number = np.abs(bits.sum(1) - p[open_].sum())
        p[open_] = bits[np.lexsort((number, np.round(words, 6)))[0]]
    return p


def _flyer(landing: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "place", "draw", "rid"], kind="stable", ignore_index=True)
        last = int(pdf["groups"].iloc[0]) <= 1
        size, p = pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64)
        u = (pdf["draw"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        p = _flight(size, p, u, landing if last else 2)
        return pdf.assign(p=_landing(size, p) if last else p)

    return run


def word_counts(docs: DataFrame, keys: dict[str, str], text_col: str) -> DataFrame:
    """Columns of docs under new names (keys: new to old) and `size`, the number of words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.zeros(0, np.int64)]
            for _, _, buf, offs in text_steps(batch.column(batch.num_columns - 1)):
                sizes.append(np.diff(word_spans(buf, offs)[2]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(sizes))], names=[*batch.schema.names[:-1], "size"])

    picked = docs.select(*[F.col(o).alias(n) for n, o in keys.items()], F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{schema}, size long")


def _decide(rows: DataFrame, weights: Sequence[float], most: float, share: float, group: int, landing: int, seed: int) -> DataFrame:
    """rows(rid, id, source, text), rid being unique: adds size, source_size, target and times, without text.
    The draws depend on id and size, not on rid, so they are the same however the rows are laid out."""
    spark = rows.sparkSession
    sized = written(word_counts(rows, {"rid": "rid", "id": "id", "source": "source"}, "text"), "sized")
    # one row per source: a mix has a weight for each, so they are few
    found = {r["source"]: (int(r["w"]), int(r["n"])) for r in sized.groupBy("source").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()}
    aim = targets({s: w for s, (w, _) in found.items()}, weights, most, share)
    facts = few_rows(
        spark,
        [(s, w, float(aim[s]), min(aim[s] / w, float(most)) if w else 0.0, -(-n // group)) for s, (w, n) in found.items()],
        "src string, source_size long, target double, rate double, groups int",
    )
    rated = sized.join(F.broadcast(facts), F.col("src").eqNullSafe(F.col("source"))).drop("src")
    rated = rated.withColumn("base", F.floor(F.col("rate") + F.lit(1e-12)).cast("int"))
    now = rated.select(
        "rid", "source", "size", "groups",
        F.xxhash64(F.lit(seed), "id", "size").alias("draw"), F.xxhash64(F.lit(seed + 2), "id", "size").alias("place"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "id", "size"), F.col("groups")).cast("int").alias("g"),
        F.greatest(F.lit(0.0), F.col("rate") - F.col("base")).alias("p"),
    )
    kinds = "rid long, source string, size long, groups int, draw long, place long, g int, p double"
    settled = (F.col("p") <= 1e-9) | (F.col("p") >= 1 - 1e-9)
    most_groups, done = max([-(-n // group) for _, n in found.values()], default=1), []
    shrink = max(2, group // 4)  # a group leaves two documents at most
    while True:
        flown = written(now.groupBy("source", "g").applyInPandas(_flyer(landing), kinds), "flown")
        done.append(flown.where(settled).select("rid", "p"))
        if most_groups <= 1:
            break
        now = flown.where(~settled).withColumns({"g": (F.col("g") / shrink).cast("int"), "groups": F.ceil(F.col("groups") / shrink).cast("int")})
        most_groups = -(-most_groups // shrink)
    decided = done[0]
    for d in done[1:]:
        decided = decided.unionByName(d)
    times = F.col("base") + F.round("p").cast("int")
    return rated.join(decided, "rid").select("rid", "id", "source", "size", "source_size", "target", times.alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST, share: float = 1.0, group: int = GROUP, landing: int = LANDING, seed: int = SEED) -> DataFrame:
    """One row per document: id, source, size, source_size, target (of the source), times, taken."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    out = _decide(rows, weights, most, share, group, landing, seed)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "times", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST, share: float = 1.0, group: int = GROUP, landing: int = LANDING, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it, with all columns."""
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    numbered = written(docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(v) for c, v in at.items()]), "numbered")
    rows = numbered.select(F.col("_row").alias("rid"), F.col(at[id_col]).alias("id"), F.col(at[source_col]).cast("string").alias("source"), F.col(at[text_col]).alias("text"))
    taken = _decide(rows, weights, most, share, group, landing, seed).where("times > 0").select(F.col("rid").alias("_row"), "times")
    repeated = numbered.join(taken, "_row").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select(*[F.col(v).alias(c) for c, v in at.items()])
