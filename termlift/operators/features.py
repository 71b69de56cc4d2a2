"""Ordered features of entities, composite features from contiguous runs, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termlift.functions.lineage import cut

SEPARATOR, MAX_RUN, MIN_SUPPORT = ",", 3, 3


def feature_type(feature: Column) -> Column:
    """single, supra_pair or supra_triple (also for longer runs)."""
    n = F.size(F.split(feature, SEPARATOR))
    return F.when(n == 1, "single").when(n == 2, "supra_pair").otherwise("supra_triple")


def constituents(feature: Column) -> Column:
    """Parts of a composite; none for a single feature."""
    parts = F.split(feature, SEPARATOR)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def composites(singles: Column, max_run: int = MAX_RUN) -> Column:
    """Every contiguous run of 2 to max_run features, shorter runs first; repeats are kept."""
    if max_run < 2:
        return F.array().cast("array<string>")
    lengths = F.filter(F.sequence(F.lit(2), F.lit(max_run)), lambda n: n <= F.size(singles))
    runs = F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.size(singles) - n + 1), lambda i: F.array_join(F.slice(singles, i, n), SEPARATOR)))
    return F.flatten(runs)


def architectures(occurrences: DataFrame, order: list[str], max_run: int = MAX_RUN) -> DataFrame:
    """(entity, singles, composites): features by position; `order` names the position and its tie-breaks."""
    hits = occurrences.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct(*order, "feature"))).alias("hits"))
    singles = hits.select("entity", F.transform("hits", lambda h: h["feature"]).alias("singles"))
    return singles.select("entity", "singles", composites(F.col("singles"), max_run).alias("composites"))


def entity_features(arch: DataFrame, with_composites: bool = True, min_support: int = 1, max_run: int = MAX_RUN) -> DataFrame:
    """Distinct (entity, feature). With a least support above 1, composites of up to max_run are those that so many entities have."""
    if with_composites and min_support > 1:
        runs, _ = supported_runs(arch, min_support, max_run)
        return entity_features(arch, False).unionByName(runs.where("n_parts > 1").select("entity", "feature"))
    every = F.concat("singles", "composites") if with_composites else F.col("singles")
    return arch.select("entity", F.explode(F.array_distinct(every)).alias("feature"))


def metadata(features: DataFrame) -> DataFrame:
    """(feature, feature_type, constituents, n_obs) of distinct (entity, feature) rows."""
    return described(features.groupBy("feature").agg(F.count("*").alias("n_obs")))


def described(counted: DataFrame) -> DataFrame:
    """metadata() of features that are counted already: (feature, n_obs)."""
    return counted.select("feature", feature_type(F.col("feature")).alias("feature_type"), constituents(F.col("feature")).alias("constituents"), "n_obs")


def type_counts(meta: DataFrame) -> DataFrame:
    return meta.groupBy("feature_type").agg(F.count("*").alias("n_features"), F.sum("n_obs").alias("n_obs"))


def top_features(occurrences: DataFrame, n: int = 100) -> DataFrame:
    """The n features with the most occurrences, ties by name."""
    return occurrences.groupBy("feature").agg(F.count("*").alias("n_occurrences")).orderBy(F.desc("n_occurrences"), "feature").limit(n)


def coverage(arch: DataFrame) -> DataFrame:
    """Entities, those with two or more features, and totals: one row."""
    multi = F.size("singles") >= 2
    return arch.agg(
        F.count("*").alias("n_entities"),
        F.count_if(multi).alias("n_multi"),
        F.coalesce(100.0 * F.count_if(multi) / F.count("*"), F.lit(0.0)).alias("pct_multi"),
        F.coalesce(F.sum(F.size("singles")), F.lit(0)).alias("n_singles"),
        F.coalesce(F.sum(F.size("composites")), F.lit(0)).alias("n_composites"),
    )


# ------------------------------------------------------------------ runs with a least support


def supported_runs(arch: DataFrame, min_support: int = MIN_SUPPORT, max_run: int = MAX_RUN) -> tuple[DataFrame, DataFrame]:
    """(entity, feature, n_parts) of the runs, single features too, that at least so many entities have, distinct; and
    a row for each length with the numbers of rows and runs that were counted, and of runs that were kept.

    Level by level: a run of n is made only where both runs of n - 1 in it are kept, which no run with enough
    entities can fail, so what is exploded and counted shrinks with every length instead of being all runs of arch.
    Runs are made and counted once an entity; the kept ones meet the rows by a join that Spark broadcasts where they are few."""
    if min_support < 1 or max_run < 1:
        raise ValueError("min_support and max_run must be positive")
    last = Window.partitionBy("entity").orderBy("at")
    rows = arch.select("entity", F.posexplode("singles").alias("at", "part")).withColumn("feature", F.col("part"))
    found, report = None, None
    for n in range(1, max_run + 1):
        rows = cut(rows)
        once = rows.select("entity", "feature").distinct()
        support = cut(once.groupBy("feature").agg(F.count("*").alias("support")))
        kept = support.where(F.col("support") >= min_support)
        counts = support.agg(F.count("*").alias("n_candidates"), F.coalesce(F.sum("support"), F.lit(0)).alias("n_rows"), F.count_if(F.col("support") >= min_support).alias("n_kept"))
        counts = counts.select(F.lit(n).alias("n_parts"), "n_rows", "n_candidates", "n_kept")
        rows = cut(rows.join(kept.select("feature"), "feature", "left_semi"))
        level = rows.select("entity", "feature", F.lit(n).alias("n_parts")).distinct()
        found = level if found is None else found.unionByName(level)
        report = counts if report is None else report.unionByName(counts)
        # the run one part longer, where the one that begins at the next place is kept too
        nxt = rows.select("entity", "at", "feature", "part", F.lead("at").over(last).alias("_at"), F.lead("part").over(last).alias("_part"))
        nxt = nxt.where(F.col("_at") == F.col("at") + 1)
        rows = nxt.select("entity", "at", F.col("_part").alias("part"), F.concat_ws(SEPARATOR, "feature", "_part").alias("feature"))
    return found, report
