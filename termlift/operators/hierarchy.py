"""False-discovery rate down the tree of runs: composites are tested only where their parts were rejected.

The runs form levels: single features, runs of two, of three. A level's family is opened for a term by the level
above: a run is tested with a term only where both runs that it has without its last and without its first part
were rejected with that term. Within a level the step-up procedure runs over what was opened, pairs without
co-occurrence counting as tests with p = 1; the first level counts all features times all terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlift.functions.lineage import cut
from termlift.operators import associations
from termlift.operators.features import SEPARATOR


def runs_of(features: DataFrame, n: int) -> DataFrame:
    """Rows of features(feature, ...) that are runs of n."""
    return features.where(F.size(F.split("feature", SEPARATOR)) == n)


def opened(runs: DataFrame, rejected: DataFrame) -> DataFrame:
    """(feature, term): runs(feature) whose shorter runs at both ends are in rejected(feature, term) with the term.

    A run without its last part meets the rejected pairs first; what is left meets them on the feature and the term."""
    parts = F.split("feature", SEPARATOR)
    n = F.size("parts")
    shape = runs.select("feature", parts.alias("parts")).select(
        "feature", F.array_join(F.slice("parts", F.lit(1), n - 1), SEPARATOR).alias("front"), F.array_join(F.slice("parts", F.lit(2), n - 1), SEPARATOR).alias("back")
    )
    front = shape.join(rejected.select(F.col("feature").alias("front"), "term"), "front")
    return front.join(rejected.select(F.col("feature").alias("back"), "term"), ["back", "term"], "left_semi").select("feature", "term")


def step_down(features: DataFrame, terms: DataFrame, alpha: float = associations.ALPHA, max_run: int = 3, universe: DataFrame | None = None) -> DataFrame:
    """features(entity, feature) with composites, terms(entity, term), distinct rows: one row for each pair that is tested
    and co-occurs, or is an opened composite, with level, cells, p_value, q_value (within its level) and rejected.

    Features and terms are read once: a level makes its pairs within the entities' rows. A level ends the descent when it rejects nothing. Memory is bounded as in the tests and the adjustment; only a level's
    number of tests reaches the driver."""
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")
    profiles = cut(associations.profiles(features, terms))
    has = profiles.where("not nameless").select(F.explode("features").alias("feature"), "terms", "n")
    universe = cut(associations.entities(profiles) if universe is None else universe)
    of_features = cut(associations.marginals(profiles.select(F.explode("features").alias("feature"), "n"), "feature", "k"))
    of_terms = cut(associations.marginals(profiles.select(F.explode("terms").alias("term"), "n"), "term", "m"))
    out, wanted = None, None
    for level in range(1, max_run + 1):
        own = runs_of(of_features, level).select("feature")
        pairs = runs_of(has, level)
        if wanted is None:
            n_tests = own.count() * of_terms.count()
            pairs = pairs.select("feature", F.explode("terms").alias("term"), "n").groupBy("feature", "term").agg(F.sum("n").alias("a"))
        else:
            wanted = cut(opened(own, wanted))
            n_tests = wanted.count()
            # only entities' runs and terms that an opened pair has
            pairs = pairs.join(wanted.select("feature").distinct(), "feature", "left_semi").select("feature", F.explode("terms").alias("term"), "n")
            pairs = pairs.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("feature", "term").agg(F.sum("n").alias("a"))
            pairs = wanted.join(pairs, ["feature", "term"], "left").select("feature", "term", F.coalesce("a", F.lit(0)).cast("long").alias("a"))
        if not n_tests:
            break
        rows = cut(associations.tested(associations.cells(cut(pairs), of_features, of_terms, universe)))
        rows = associations.adjusted(rows, n_tests).withColumns({"level": F.lit(level), "rejected": F.col("q_value") <= alpha})
        rows = cut(rows)
        out = rows if out is None else out.unionByName(rows)
        wanted = rows.where("rejected").select("feature", "term")
    if out is None:  # no feature or no term at all
        empty = associations.tested(associations.contingency(features, terms, universe))
        out = empty.withColumns({"q_value": F.lit(None).cast("double"), "level": F.lit(1), "rejected": F.lit(False)}).where("false")
    return out
