"""Hierarchical shrinkage of composite features' p-values towards their parts'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlift.functions.lineage import cut
from termlift.functions.quantiles import quantiles

TINY, STRENGTH, MIN_OBS = 1e-323, 0.5, 3


def check(strength: float, min_obs: float) -> None:
    if not 0 <= strength <= 1:
        raise ValueError(f"strength must lie in [0, 1], not {strength}")
    if min_obs <= 0:
        raise ValueError(f"min_obs must be above 0, not {min_obs}")


def alpha(n_obs: Column, strength: float = STRENGTH, min_obs: float = MIN_OBS) -> Column:
    """The weight of the prior: less the more often the composite is seen."""
    check(strength, min_obs)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(float(strength)) * F.exp(-n_obs / F.lit(float(min_obs)))))


def extended_pairs(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """Pairs (feature, term, a) with those of composites and their parts' terms added, at a = 0.

    Shrinkage can pull such a pair's p below 1; all others that are left out keep p = 1."""
    parts = meta.where(F.size("constituents") > 0).select("feature", F.explode(F.array_distinct("constituents")).alias("part"))
    more = parts.join(pairs.select(F.col("feature").alias("part"), "term"), "part").select("feature", "term")
    return pairs.select("feature", "term", "a").unionByName(more.withColumn("a", F.lit(0).cast("long"))).groupBy("feature", "term").agg(F.max("a").alias("a"))


def shrink(rows: DataFrame, meta: DataFrame, strength: float = STRENGTH, min_obs: float = MIN_OBS) -> DataFrame:
    """rows(feature, term, p_value, ...), distinct by feature and term: adds p_raw, prior, alpha and composite; p_value becomes the shrunk value.

    The prior is the geometric mean over the parts that were tested with the term; a part that occurs twice
    counts twice, a part that was not tested is skipped (absent pairs have p = 1 and count as such where
    the part occurs at all)."""
    check(strength, min_obs)
    shape = meta.select("feature", "constituents", "n_obs")
    kept = [c for c in rows.columns if c not in ("feature", "term")]
    single = rows.join(shape.where(F.size("constituents") == 0).select("feature"), "feature", "left_semi").select(F.col("feature").alias("_part"), "term", F.col("p_value").alias("_part_p"))
    known = shape.where(F.size("constituents") == 0).select(F.col("feature").alias("_part"), F.lit(True).alias("_known"))
    every = rows.join(shape, "feature", "left")
    met = every.withColumns({"_n_parts": F.size("constituents"), "_part": F.explode_outer("constituents")}).drop("constituents")
    met = met.join(single, ["_part", "term"], "left").join(known, "_part", "left")
    part_p = F.coalesce("_part_p", F.when(F.col("_known"), F.lit(1.0)))
    prior = F.exp(F.avg(F.when(part_p.isNotNull(), F.ln(F.greatest(part_p, F.lit(TINY)))))).alias("prior")  # greatest() passes over nulls
    # a row's other columns go through the aggregation with it, so that it is not joined to its own prior
    out = met.groupBy("feature", "term").agg(*[F.first(c).alias(c) for c in [*kept, "n_obs", "_n_parts"]], prior)
    out = out.withColumn("alpha", F.when(F.col("prior").isNotNull(), alpha(F.col("n_obs"), strength, min_obs)))
    mixed = F.exp((1 - F.col("alpha")) * F.ln(F.greatest("p_value", F.lit(TINY))) + F.col("alpha") * F.ln(F.greatest("prior", F.lit(TINY))))
    return out.withColumn("p_raw", F.col("p_value")).withColumn("p_value", F.coalesce(mixed, F.col("p_value"))).withColumn("composite", F.col("_n_parts") > 0).drop("_n_parts", "n_obs")


def statistics(rows: DataFrame, threshold: float = 0.01, n_dense: int | None = None) -> DataFrame:
    """One row on the composites among the rows of shrink(): tests, raised, median ratio, lost and gained below the threshold.

    n_dense adds the pairs left out, whose ratio is 1."""
    own = cut(rows.where("composite").select("p_raw", "p_value", (F.greatest("p_value", F.lit(TINY)) / F.greatest("p_raw", F.lit(TINY))).alias("ratio"), F.lit(1).cast("long").alias("w")))
    n = own.count() if n_dense is not None else 0
    if n_dense is not None and n_dense > n:
        own = own.unionByName(rows.sparkSession.createDataFrame([(1.0, 1.0, 1.0, n_dense - n)], "p_raw double, p_value double, ratio double, w long"))
    total = F.coalesce(F.sum("w"), F.lit(0))
    median = quantiles(own, "ratio", [0.5], "w")[0]
    return own.agg(
        total.alias("n_composite_tests"),
        F.count_if(F.col("p_value") > F.col("p_raw")).alias("n_increased"),
        F.coalesce(100.0 * F.count_if(F.col("p_value") > F.col("p_raw")) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("pct_increased"),
        F.lit(1.0 if median is None else median).alias("median_ratio"),
        F.count_if((F.col("p_raw") < threshold) & (F.col("p_value") >= threshold)).alias("lost"),
        F.count_if((F.col("p_raw") >= threshold) & (F.col("p_value") < threshold)).alias("gained"),
    )
