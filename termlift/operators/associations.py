"""Feature-to-term association: co-occurrence, 2x2 cells, exact tests, false-discovery rate, top-k.

Only pairs that co-occur are built. A pair without co-occurrence has p = q = 1, so with the dense number of
tests the adjusted values of the sparse rows are those of the dense matrix.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termlift.functions.lineage import cut
from termlift.functions.tests2x2 import bounded_score, odds_ratio, test_tables

ALPHA = 0.01
#: Rows of a class of adjusted(), and how many classes at least and at most.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 500_000, 16, 4096


def universe(features: DataFrame, terms: DataFrame, how: str = "union") -> DataFrame:
    """(n): entities that have a feature or a term, or with how="intersection" both. One row."""
    if how not in ("union", "intersection"):
        raise ValueError(f"how must be union or intersection, not {how!r}")
    a, b = features.select("entity"), terms.select("entity")
    both = a.union(b) if how == "union" else a.join(b, "entity", "left_semi")
    return both.agg(F.count_distinct("entity").alias("n"))


def marginals(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Entities of each feature or term, from distinct rows; a row with n stands for so many entities."""
    return rows.groupBy(column).agg((F.sum("n") if "n" in rows.columns else F.count("*")).alias(name))


def cooccurrence(features: DataFrame, terms: DataFrame) -> DataFrame:
    """(feature, term, a): entities that have both. Counts are combined before they are dealt by pair."""
    return features.join(terms, "entity").groupBy("feature", "term").agg(F.count("*").alias("a"))


def profiles(features: DataFrame, terms: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(features, terms, nameless, n): the different sets of features and terms that entities have, as sorted arrays, and how many entities
    have them; weights(entity, n) where an entity stands for several. An entity may have only one kind; nameless is that without an id.

    Entities are dealt once, whatever is counted then, since pairs are made within a row. Entities with the same sets, such as
    those of one architecture, are one row."""
    f = features.groupBy("entity").agg(F.collect_set("feature").alias("features"))
    every = f.join(terms.groupBy("entity").agg(F.collect_set("term").alias("terms")), "entity", "full")
    return merged(every if weights is None else every.join(weights, "entity"))


def merged(every: DataFrame) -> DataFrame:
    """profiles() of every(entity, features, terms), a row for each entity, with n where it stands for several."""
    n = F.sum("n") if "n" in every.columns else F.count("*")
    keys = [F.sort_array("features").alias("features"), F.sort_array("terms").alias("terms"), F.col("entity").isNull().alias("nameless")]
    return every.groupBy(*keys).agg(n.alias("n"))


def counts(profiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of profiles, whose lineage should be cut: (feature, term, a), (feature, k), (term, m) and (n), all cut.

    They are those of cooccurrence(), marginals() and universe(), but for rows without a feature or a term."""
    of_features = marginals(profiles.select(F.explode("features").alias("feature"), "n"), "feature", "k")
    of_terms = marginals(profiles.select(F.explode("terms").alias("term"), "n"), "term", "m")
    return cut(met(profiles)), cut(of_features), cut(of_terms), cut(entities(profiles))


def met(profiles: DataFrame) -> DataFrame:
    """cooccurrence() of profiles: (feature, term, a)."""
    left = profiles.where("not nameless").select(F.explode("features").alias("feature"), "terms", "n")
    return left.select("feature", F.explode("terms").alias("term"), "n").groupBy("feature", "term").agg(F.sum("n").alias("a"))


def entities(profiles: DataFrame) -> DataFrame:
    """universe() of profiles: (n). One row."""
    return profiles.where("not nameless").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"))


def contingency(features: DataFrame, terms: DataFrame, n: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(feature, term, a, b, c, d, k, m, n). Features' and terms' counts are joined by key; Spark
    broadcasts them where their size allows."""
    pairs = cooccurrence(features, terms) if pairs is None else pairs
    n = universe(features, terms) if n is None else n
    return cells(pairs, marginals(features, "feature", "k"), marginals(terms, "term", "m"), n)


def cells(pairs: DataFrame, of_features: DataFrame, of_terms: DataFrame, n: DataFrame) -> DataFrame:
    """contingency() from pairs(feature, term, a) and counts(feature, k), (term, m), (n) that are there already."""
    rows = pairs.join(of_features, "feature").join(of_terms, "term").crossJoin(F.broadcast(n))
    return rows.select("feature", "term", "a", (F.col("k") - F.col("a")).alias("b"), (F.col("m") - F.col("a")).alias("c"), (F.col("n") - F.col("k") - F.col("m") + F.col("a")).alias("d"), "k", "m", "n")


def tested(cells: DataFrame, alternative: str = "greater") -> DataFrame:
    """Adds p_value, odds_ratio and hyper_score (always of the right tail's p). Each different table is tested once.

    cells are read twice: cut the lineage of the pairs under them."""
    out = test_tables(cells, alternative)
    if alternative != "greater":
        out = test_tables(out, "greater", "_raw")
    raw = F.col("p_value" if alternative == "greater" else "_raw")
    return out.withColumns({"odds_ratio": odds_ratio(*(F.col(c) for c in "abcd")), "hyper_score": bounded_score(raw, F.col("a"))}).drop("_raw")


def number_of_tests(features: DataFrame, terms: DataFrame) -> DataFrame:
    """(n_tests): distinct features times distinct terms. One row."""
    return features.agg(F.count_distinct("feature").alias("nf")).crossJoin(terms.agg(F.count_distinct("term").alias("nt"))).select((F.col("nf") * F.col("nt")).alias("n_tests"))


def adjusted(rows: DataFrame, n_tests: int, p: str = "p_value", ranges: int | None = None) -> DataFrame:
    """Adds q_value by Benjamini and Hochberg, n_tests counting also the tests that are left out, whose p is 1.

    Ranks need a global order. Approximate quantiles part the values into classes: each quantile itself, and what lies between two.
    A value with more than a share of the rows, such as p = 1, is a quantile, so its rows are a class of equal
    values and stay where they are; what lies between two quantiles is a bounded share and is ranked in one sort by a
    window of its own. A class's ranks begin after the counts, and its values end below the least value, of the classes
    around it, one row each. rows are read five times: cut their lineage where it is dear."""
    n = rows.where(F.col(p).isNotNull()).count()
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, n // RANGE_ROWS))
    cuts = rows.agg(F.percentile_approx(p, [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges).alias("c")).first()["c"] or []
    cuts = sorted({0.0, 1.0, *cuts})
    found = Bucketizer(splits=[*cuts, math.inf], inputCol=p, outputCol="_at", handleInvalid="keep").transform(rows)
    equal = F.get(F.array(*map(F.lit, cuts)), F.col("_at").cast("int")) == F.col(p)
    dealt = found.withColumn("_b", (2 * F.col("_at") + F.when(equal, 0).otherwise(1)).cast("int")).drop("_at")
    whole = Window.orderBy("_b")  # over one row for each class
    sizes = cut(dealt.where(F.col(p).isNotNull()).groupBy("_b").agg(F.count("*").alias("_t")).withColumn("_upto", F.sum("_t").over(whole)).drop("_t"))
    raised = F.col(p) * F.lit(float(n_tests))
    # downwards from the largest value, so that one order gives the rank and the running least
    down = Window.partitionBy("_b").orderBy(F.desc(p))
    odd = dealt.where("_b % 2 = 1")
    levels = odd.groupBy("_b", p).agg(F.count("*").alias("_n")).join(F.broadcast(sizes), "_b")  # counts are combined before they are dealt
    levels = levels.withColumn("_q", raised / (F.col("_upto") - F.sum("_n").over(down) + F.col("_n")))
    between = odd.join(F.broadcast(sizes), "_b").withColumn("_q", raised / (F.col("_upto") - F.row_number().over(down) + 1))
    between = between.withColumn("_q", F.min("_q").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("_upto")
    # of the classes of equal values, the value is the class's own
    values = F.get(F.array(*map(F.lit, cuts)), (F.col("_b") / 2).cast("int")) * F.lit(float(n_tests)) / F.col("_upto")
    least = sizes.where("_b % 2 = 0").select("_b", values.alias("_m")).unionByName(levels.groupBy("_b").agg(F.min("_q").alias("_m")))
    least = cut(least.select("_b", F.least(F.lit(1.0), F.min("_m").over(whole.rowsBetween(1, Window.unboundedFollowing))).alias("_after"), "_m"))
    least = F.broadcast(least)  # at most twice as many rows as ranges
    one = F.lit(1.0)
    parts = between.join(least.drop("_m"), "_b").withColumn("q_value", F.least(one, "_q", F.coalesce("_after", one))).drop("_q", "_after", "_b")
    same = dealt.where("_b % 2 = 0").join(least, "_b").withColumn("q_value", F.least(one, "_m", F.coalesce("_after", one))).drop("_m", "_after", "_b")
    return parts.unionByName(same)


def p_threshold(rows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(p_threshold): the largest p with q at most alpha, or 0."""
    return rows.agg(F.coalesce(F.max(F.when(F.col("q_value") <= alpha, F.col("p_value"))), F.lit(0.0)).alias("p_threshold"))


def adjusted_among_tested(rows: DataFrame, least: int = 1) -> DataFrame:
    """Adds q_value to the rows with at least so many co-occurrences, these alone counting as tests."""
    rows = rows.where(F.col("a") >= least)
    return adjusted(rows, rows.count())


def significant(rows: DataFrame, alpha: float = ALPHA, strict: bool = False) -> DataFrame:
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")
    return rows.where(F.col("q_value") < alpha if strict else F.col("q_value") <= alpha)


def top_k(rows: DataFrame, k: int = 100) -> DataFrame:
    """The k strongest associations, ranked by p, feature, term; of all tests, not only significant ones."""
    best = rows.orderBy("p_value", "feature", "term").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("p_value", "feature", "term")))
