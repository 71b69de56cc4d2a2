"""Exact order statistics and quantiles of a column in bounded memory, by distributed selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlift.functions.lineage import cut

#: Into how many classes a round parts the values, and how many rows are few enough to be sorted.
CLASSES, FEW = 1000, 50_000


def _classes(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """Adds c: 2i for the i-th cut itself, 2i + 1 for what lies between it and the next one."""
    found = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="v", outputCol="_at").transform(rows)
    at = F.col("_at").cast("int") - 1  # of the last cut that is not above
    equal = F.coalesce(F.get(F.array(*map(F.lit, cuts)), at) == F.col("v"), F.lit(False)) & (at >= 0)
    return found.withColumn("c", 2 * at + F.when(equal, 0).otherwise(1)).drop("_at")


def _select(rows: DataFrame, ranks: list[int], classes: int, few: int) -> dict[int, float]:
    """The values at the ranks (from 0, ascending) of rows(v, w), w times each."""
    n = rows.count()
    out, seen, todo = {}, 0, list(ranks)
    if n <= few:
        for r in rows.groupBy("v").agg(F.sum("w").alias("w")).orderBy("v").collect():
            seen += r.w
            while todo and todo[0] < seen:
                out[todo.pop(0)] = r.v
        return out
    cuts = sorted(set(rows.agg(F.percentile_approx("v", [i / classes for i in range(1, classes)], 20 * classes)).first()[0]))
    for r in _classes(rows, cuts).groupBy("c").agg(F.sum("w").alias("w")).orderBy("c").collect():  # a row for each class
        here = []
        while todo and todo[0] < seen + r.w:
            here.append(todo.pop(0))
        if here and r.c % 2 == 0:
            out |= dict.fromkeys(here, cuts[r.c // 2])
        elif here:
            low, high = (r.c - 1) // 2, (r.c + 1) // 2
            # what lies between two cuts is about 1 / classes of the rows, and never all of them
            inner = rows.where(F.lit(True) if low < 0 else F.col("v") > cuts[low]).where(F.lit(True) if high >= len(cuts) else F.col("v") < cuts[high])
            found = _select(cut(inner) if n > 20 * few else inner, [k - seen for k in here], classes, few)
            out |= {k + seen: v for k, v in found.items()}
        seen += r.w
    return out


def quantiles(rows: DataFrame, value: str, probabilities: Sequence[float], weight: str | None = None, classes: int = CLASSES, few: int = FEW) -> list[float | None]:
    """The quantiles of a column as F.percentile has them (between two values, in proportion), each row counting
    `weight` times; None where there is no value. Nulls, NaN and rows with a weight below 1 do not count.

    A round parts the rows at approximate quantiles, counts the classes exactly and goes on with the one that holds the
    rank, so no task holds more than a sketch, the classes' counts, or `few` rows; nothing is sorted but those.
    rows are read three times, and once for each class that holds a rank: cut their lineage where it is dear."""
    if not all(0 <= p <= 1 for p in probabilities):
        raise ValueError(f"probabilities must lie in [0, 1], not {probabilities}")
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    rows = rows.select(F.col(value).cast("double").alias("v"), w.alias("w")).where("v is not null and not isnan(v) and w > 0")
    n = rows.agg(F.sum("w")).first()[0]
    if not n:
        return [None] * len(probabilities)
    places = [(n - 1) * p for p in probabilities]
    known = _select(rows, sorted({k for at in places for k in (math.floor(at), math.ceil(at))}), classes, few)
    out = []
    for at in places:
        low, high = math.floor(at), math.ceil(at)
        out.append(known[low] if known[low] == known[high] else known[low] * (high - at) + known[high] * (at - low))
    return out
