"""Exact tests on 2x2 tables, odds ratios and bounded scores, as Spark expressions.

A table is (a, k, m, n): co-occurrences, entities with the feature, entities with the term, all entities. Tables repeat: pairs
are many, different tables few. test_tables() groups rows by their table, tests each different one once and joins
the values back, so that the work is that of the tables; equal tables have equal values, bit by bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A point of the two-sided tail counts if its probability is at most the observed one times this.
TWO_SIDED_SLACK = 1 + 1e-7
ALTERNATIVES = ("greater", "less", "two-sided")
_SMALL = 32
_HALF_LOG_2PI = 0.9189385332046727418


def ln_factorial(x: Column) -> Column:
    """log(x!): looked up below 32, Stirling's series from there on."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(_SMALL)])
    y = x.cast("double") + 1
    z = 1 / (y * y)
    series = (1 / 12 + z * (-1 / 360 + z * (1 / 1260 - z / 1680))) / y
    return F.when(x < _SMALL, F.get(table, x.cast("int"))).otherwise((y - 0.5) * F.log(y) - y + _HALF_LOG_2PI + series)


def log_point(a: Column, k: Column, m: Column, n: Column) -> Column:
    """log P(X = a) for the hypergeometric X."""

    def choose(n, k):
        return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)

    return choose(k, a) + choose(n - k, m - a) - choose(n, m)


def _with_right_tail(t: DataFrame, a: str, k: str, m: str, n: str, out: str) -> DataFrame:
    """Adds P(X >= a).

    The side beyond the mean is summed, its mirror image (k - X, with n - m) having the other side. A term follows from the one
    before by a ratio that falls, so the sum is 1 + r1 (1 + r2 (1 + ...)), made from its far end. That is where terms
    are below the last bit, by the first ratio alone or, from the mode on, by Bernstein's inequality."""
    d = {c: F.col(c).cast("double") for c in (a, k, m, n)}
    above = d[a] * d[n] > d[k] * d[m]
    t = t.withColumns({"_above": above, "_s": F.when(above, F.col(a)).otherwise(F.col(k) - F.col(a) + 1), "_m": F.when(above, F.col(m)).otherwise(F.col(n) - F.col(m))})
    t = t.withColumns({"_dk": d[k], "_dm": F.col("_m").cast("double"), "_c": (F.col(n) - F.col(k) - F.col("_m") + 1).cast("double")})

    def ratio(x):
        return (F.col("_dk") - x) * (F.col("_dm") - x) / ((x + 1) * (F.col("_c") + x))

    s, high = F.col("_s"), F.least(F.col(k), F.col("_m"))
    variance = F.greatest(F.lit(0.0), F.col("_dk") * (F.col("_dm") / d[n]) * ((d[n] - F.col("_dk")) / d[n]) * ((d[n] - F.col("_dm")) / F.greatest(d[n] - 1, F.lit(1.0))))
    inside = (F.col(a) > F.greatest(F.lit(0), F.col(k) + F.col(m) - F.col(n))) & (F.col(a) <= F.least(F.col(k), F.col(m)))
    t = t.withColumns({"_inside": inside, "_v": variance, "_r": F.when(inside & (s < high), ratio(s.cast("double")))})
    size = 40 + F.log(3 * F.sqrt("_v") + 3)  # of the least exponent that counts
    by_ratio = F.when((F.col("_r") > 0) & (F.col("_r") < 1), F.ceil(F.least(F.lit(1e15), 40 / -F.log("_r"))))
    by_mode = F.ceil(size / 3 + F.sqrt(size * size / 9 + 2 * size * F.col("_v"))) + 2
    t = t.withColumn("_steps", F.least(high - s, by_ratio, by_mode))
    places = F.sequence(s + F.col("_steps") - 1, s, F.lit(-1).cast("long"))
    total = F.when(F.col("_steps") > 0, F.aggregate(places, F.lit(1.0), lambda acc, x: 1 + acc * ratio(x.cast("double")))).otherwise(1.0)
    t = t.withColumn("_sum", F.when(F.col("_inside"), F.exp(log_point(s, F.col(k), F.col("_m"), F.col(n))) * total))
    side = F.when(F.col("_above"), F.col("_sum")).otherwise(1 - F.col("_sum"))
    value = F.when(F.col("_inside"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), side))).when(F.col(a) > F.least(F.col(k), F.col(m)), 0.0).otherwise(1.0)
    return t.withColumn(out, value).drop("_above", "_s", "_m", "_dk", "_dm", "_c", "_inside", "_v", "_r", "_steps", "_sum")


def _with_left_tail(t: DataFrame, a: str, k: str, m: str, n: str, out: str) -> DataFrame:
    """Adds P(X <= a), by the symmetry X -> k - X with n - m."""
    t = t.withColumns({"_ka": F.col(k) - F.col(a), "_nm": F.col(n) - F.col(m)})
    return _with_right_tail(t, "_ka", k, "_nm", n, out).drop("_ka", "_nm")


def _first_not_above(end: Column, sign: int) -> Column:
    """From _mode towards end, where log P(X = x) falls, the first x with a value of at most _most (end + sign if none)."""
    far = F.abs(end - F.col("_mode")) + 1

    def halve(acc, i):
        mid = F.floor((acc["near"] + acc["far"]) / 2).cast("long")
        low = log_point(F.col("_mode") + sign * mid, F.col("k"), F.col("m"), F.col("n")) <= F.col("_most")
        open_ = acc["near"] < acc["far"]
        near, far = F.when(open_ & ~low, mid + 1).otherwise(acc["near"]), F.when(open_ & low, mid).otherwise(acc["far"])
        return F.struct(near.alias("near"), far.alias("far"))

    start = F.struct(F.lit(0).cast("long").alias("near"), far.cast("long").alias("far"))
    # the last point tried lies within the range: mid is below far
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(far.cast("double") + 1)).cast("int") + 1)
    return F.col("_mode") + sign * F.aggregate(rounds, start, halve, lambda acc: acc["near"])


def _with_two_sided(t: DataFrame, out: str) -> DataFrame:
    """Adds the sum of all P(X = x) that are not above P(X = a): two tails, whose ends towards the mode bisection finds."""
    low, high = F.greatest(F.lit(0).cast("long"), F.col("k") + F.col("m") - F.col("n")), F.least("k", "m")
    mode = F.floor((F.col("k") + 1).cast("double") * (F.col("m") + 1) / (F.col("n") + 2)).cast("long")
    t = t.withColumns({"_low": low, "_high": high})
    t = t.withColumns({"_mode": F.least("_high", F.greatest("_low", mode)), "_most": log_point(*(F.col(c) for c in "akmn")) + math.log(TWO_SIDED_SLACK)})
    t = t.withColumns({"_up": _first_not_above(F.col("_high"), 1), "_down": _first_not_above(F.col("_low"), -1)})
    t = t.withColumns({"_ua": F.least("_up", "_high"), "_da": F.greatest("_down", "_low")})
    t = _with_left_tail(_with_right_tail(t, "_ua", "k", "m", "n", "_right"), "_da", "k", "m", "n", "_left")
    both = F.when(F.col("_up") > F.col("_high"), 0.0).otherwise(F.col("_right")) + F.when(F.col("_down") < F.col("_low"), 0.0).otherwise(F.col("_left"))
    value = F.when(F.col("_up") == F.col("_mode"), 1.0).otherwise(F.least(F.lit(1.0), both))
    return t.withColumn(out, value).drop("_low", "_high", "_mode", "_most", "_up", "_down", "_ua", "_da", "_right", "_left")


def p_values(tables: DataFrame, alternative: str = "greater", out: str = "p_value") -> DataFrame:
    """tables(a, k, m, n, ...), of whole numbers: adds the exact test's p-value."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {sorted(ALTERNATIVES)}, not {alternative!r}")
    if alternative == "two-sided":
        return _with_two_sided(tables, out)
    return (_with_right_tail if alternative == "greater" else _with_left_tail)(tables, "a", "k", "m", "n", out)


def test_tables(rows: DataFrame, alternative: str = "greater", out: str = "p_value", names: tuple[str, str, str, str] = ("a", "k", "m", "n")) -> DataFrame:
    """rows with the named columns of a table: adds the p-value. rows is read twice: cut its lineage where it is dear.

    The different tables are broadcast where Spark finds them small; otherwise both sides are dealt by the table, and a
    table that very many rows share is split by AQE."""
    tables = rows.select(*[F.col(c).cast("long").alias(x) for c, x in zip(names, "akmn")]).distinct()
    # few bytes and much work: dealt to as many tasks as a shuffle has, which AQE would merge by their size
    tables = tables.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = p_values(tables, alternative, out).select(*[F.col(x).alias(f"_{x}") for x in "akmn"], out)
    return rows.join(known, [F.col(c) == F.col(f"_{x}") for c, x in zip(names, "akmn")]).drop(*[f"_{x}" for x in "akmn"])


test_tables.__test__ = False  # not a test of pytest's


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(a d) / (b c): infinite if only b c is 0, NaN if both products are."""
    up, down = a.cast("double") * d.cast("double"), b.cast("double") * c.cast("double")
    return F.when(down != 0, F.try_divide(up, down)).when(up == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))


def bounded_score(p: Column, a: Column) -> Column:
    """-10 log10 p between 1 and 100; 0 without any co-occurrence, 100 where p vanishes."""
    return F.when(a == 0, 0.0).when((p <= 0) | F.isnan(p), 100.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(100.0), -10 * F.log10(p))))
