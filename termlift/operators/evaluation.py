"""Evaluation of associations against a gold standard of (feature, term) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlift.functions.lineage import cut
from termlift.functions.quantiles import quantiles

P_CUTS = (1e-2, 1e-3, 1e-4, 1e-6, 1e-8, 1e-10)
SCORE_CUTS = (10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0)


def ratio(up: Column, down: Column) -> Column:
    return F.when(down == 0, 0.0).otherwise(F.try_divide(up.cast("double"), down.cast("double")))


def _scores(tp: Column, predicted: Column, gold: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, predicted), ratio(tp, gold)
    f1 = F.when(precision + recall == 0, 0.0).otherwise(F.try_divide(2 * precision * recall, precision + recall))
    return {"precision": precision, "recall": recall, "f1": f1}


def marked(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """predictions with is_gold."""
    return predictions.join(gold.select("feature", "term", F.lit(True).alias("_g")).distinct(), ["feature", "term"], "left").withColumn("is_gold", F.col("_g").isNotNull()).drop("_g")


def precision_recall(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: predicted, gold, true and false positives, false negatives, precision, recall, F1; on distinct pairs."""
    hits = marked(predictions.select("feature", "term").distinct(), gold).agg(F.count("*").alias("n_predicted"), F.count_if("is_gold").alias("true_positives"))
    rows = hits.crossJoin(gold.agg(F.count_distinct("feature", "term").alias("n_gold")))
    tp = F.col("true_positives")
    rows = rows.withColumns({"false_positives": F.col("n_predicted") - tp, "false_negatives": F.col("n_gold") - tp})
    return rows.withColumns(_scores(tp, F.col("n_predicted"), F.col("n_gold")))


def threshold_sweep(predictions: DataFrame, gold: DataFrame, p_cuts: Sequence[float] = P_CUTS, q_cuts: Sequence[float] = P_CUTS, score_cuts: Sequence[float] = SCORE_CUTS) -> DataFrame:
    """(criterion, threshold, n_predicted, true_positives, precision, recall, f1), from one pass over distinct pairs."""
    rows = marked(predictions.groupBy("feature", "term").agg(F.min("p_value").alias("p_value"), F.min("q_value").alias("q_value"), F.max("hyper_score").alias("hyper_score")), gold)
    cuts = [("p_value", float(c)) for c in p_cuts] + [("q_value", float(c)) for c in q_cuts] + [("hyper_score", float(c)) for c in score_cuts]
    tests = [F.col(n) >= c if n == "hyper_score" else F.col(n) <= c for n, c in cuts]
    sums = [x for i, t in enumerate(tests) for x in (F.count_if(t).alias(f"n{i}"), F.count_if(t & F.col("is_gold")).alias(f"h{i}"))]
    one = rows.agg(*sums).crossJoin(gold.agg(F.count_distinct("feature", "term").alias("n_gold")))
    line = [F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("criterion"), F.lit(c).alias("threshold"), F.col(f"n{i}").alias("n_predicted"), F.col(f"h{i}").alias("true_positives")) for i, (n, c) in enumerate(cuts)]
    out = one.select("n_gold", F.explode(F.array(*line)).alias("x")).select("n_gold", "x.*")
    return out.withColumns(_scores(F.col("true_positives"), F.col("n_predicted"), F.col("n_gold")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first line with the highest F1."""
    return sweep.orderBy(F.desc("f1"), "ordinal").limit(1)


def novel(predictions: DataFrame, gold: DataFrame, n: int = 100) -> DataFrame:
    """The n best predictions that the gold standard does not have."""
    new = predictions.join(gold.select("feature", "term").distinct(), ["feature", "term"], "left_anti")
    return new.orderBy(F.desc("hyper_score"), "p_value", "feature", "term").limit(n)


def overlap(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(part, n): common, novel and missed distinct pairs."""
    p, g = predictions.select("feature", "term"), gold.select("feature", "term")
    parts = {"common": p.intersect(g), "novel": p.subtract(g), "missed": g.subtract(p)}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def architecture_statistics(arch: DataFrame) -> DataFrame:
    """Per single feature: entities that have it, those in which it is alone (repeats count), the fraction."""
    rows = arch.select((F.size("singles") == 1).alias("alone"), F.explode(F.array_distinct("singles")).alias("feature"))
    out = rows.groupBy("feature").agg(F.count("*").alias("n_total"), F.count_if("alone").alias("n_single"), F.count_if(~F.col("alone")).alias("n_multi"))
    return out.withColumn("fraction_single", ratio(F.col("n_single"), F.col("n_total")))


def architecture_contribution(predictions: DataFrame, gold: DataFrame, arch: DataFrame) -> DataFrame:
    """Statistics of the features of predictions that the gold standard has."""
    matched = predictions.select("feature", "term").distinct().join(gold.select("feature", "term").distinct(), ["feature", "term"], "left_semi")
    return matched.join(architecture_statistics(arch), "feature")


def contribution_summary(contribution: DataFrame) -> DataFrame:
    """(n, mean_fraction, median_entities): one row."""
    contribution = cut(contribution.select("fraction_single", "n_total"))
    median = quantiles(contribution, "n_total", [0.5])[0] or 0.0
    return contribution.agg(F.count("*").alias("n"), F.coalesce(F.avg("fraction_single"), F.lit(0.0)).alias("mean_fraction"), F.lit(median).alias("median_entities"))


def composition(predictions: DataFrame, feature_type: Column) -> DataFrame:
    """(feature_type, n, pct) of predictions."""
    counts = predictions.groupBy(feature_type.alias("feature_type")).agg(F.count("*").alias("n"))
    whole = predictions.agg(F.count("*").alias("_all"))
    return counts.crossJoin(whole).select("feature_type", "n", (100.0 * F.col("n") / F.col("_all")).alias("pct"))


def describe(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("feature", "term")) -> DataFrame:
    """(name, n, n_distinct, least, most, mean): one row for each key, with its distinct values, and each number's range, in one pass."""
    sums = [x for c in keys for x in (F.count(c).alias(f"n_{c}"), F.count_distinct(c).alias(f"d_{c}"))]
    sums += [x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"), F.avg(c).alias(f"avg_{c}"))]
    none, long = F.lit(None).cast("double"), F.lit(None).cast("long")
    line = lambda c, *v: F.struct(F.lit(c).alias("name"), *[x.alias(n) for x, n in zip(v, ("n", "n_distinct", "least", "most", "mean"))])
    lines = [line(c, F.col(f"n_{c}"), F.col(f"d_{c}"), none, none, none) for c in keys]
    lines += [line(c, F.col(f"n_{c}"), long, F.col(f"lo_{c}"), F.col(f"hi_{c}"), F.col(f"avg_{c}")) for c in columns]
    return rows.agg(*sums).select(F.explode(F.array(*lines)).alias("x")).select("x.*")


def quartiles(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, least, q25, median, q75, most) of each number, exact, in bounded memory; null without values."""
    rows = cut(rows.select(*columns))
    found = [(c, *quantiles(rows, c, (0, 0.25, 0.5, 0.75, 1))) for c in columns]
    return rows.sparkSession.createDataFrame(found, "name string, least double, q25 double, median double, q75 double, most double")


def quality(annotations: DataFrame, alpha: float) -> DataFrame:
    """(annotation_type, n, n_over, compliant): annotations of each type, and those whose q is missing or above alpha."""
    over = F.count_if(~F.coalesce(F.col("q_value") <= alpha, F.lit(False)))
    return annotations.groupBy("annotation_type").agg(F.count("*").alias("n"), over.alias("n_over")).withColumn("compliant", F.col("n_over") == 0)
