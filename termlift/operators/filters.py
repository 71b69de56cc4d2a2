"""Row filters of annotation and occurrence tables. None and an empty collection both mean no filter."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The evidence codes of the Gene Ontology.
EXPERIMENTAL = ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP")
COMPUTATIONAL = ("ISS", "ISO", "ISA", "ISM", "IGC", "IBA", "IBD", "IKR", "IRD", "RCA")
AUTHOR = ("TAS", "NAS")
CURATOR = ("IC", "ND")
ELECTRONIC = ("IEA",)
MANUAL = EXPERIMENTAL + COMPUTATIONAL + AUTHOR + CURATOR
PRESETS: dict[str, tuple[str, ...] | None] = {"all": None, "manual": MANUAL, "non-iea": MANUAL, "experimental": EXPERIMENTAL}
ASPECTS = ("P", "F", "C")


def evidence_preset(name: str) -> tuple[str, ...] | None:
    """Codes of a preset; an unknown name is `manual`."""
    return PRESETS.get(name, MANUAL)


def has_negation(qualifier: Column) -> Column:
    return F.coalesce(F.upper(qualifier).contains("NOT"), F.lit(False))


def disposition(evidence: Collection[str] | None, aspects: Collection[str] | None, exclude_negated: bool = True, prefix: str | None = "GO:") -> Column:
    """What becomes of an annotation row: the first test that it fails, or accepted."""
    out = F.when(has_negation(F.col("qualifier")), "excluded_qualifier") if exclude_negated else F.when(F.lit(False), "")
    if evidence:
        out = out.when(~F.coalesce(F.col("evidence").isin(*evidence), F.lit(False)), "filtered_evidence")
    out = out.when(~F.coalesce(F.col("aspect").isin(*(aspects or ASPECTS)), F.lit(False)), "filtered_aspect")
    if prefix:
        out = out.when(~F.coalesce(F.col("term").startswith(prefix), F.lit(False)), "parse_error")
    return out.otherwise("accepted")


def disposition_counts(rows: DataFrame, what: Column) -> DataFrame:
    return rows.groupBy(what.alias("disposition")).agg(F.count("*").alias("n"))


def accepted(rows: DataFrame, *tests, **options) -> DataFrame:
    return rows.where(disposition(*tests, **options) == "accepted")


def entity_terms(rows: DataFrame) -> DataFrame:
    """Distinct (entity, term)."""
    return rows.select("entity", "term").distinct()


def allow_entities(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Rows of the entities in allowed(entity)."""
    return rows if allowed is None else rows.join(allowed.select("entity").distinct(), "entity", "left_semi")


def with_prefix(rows: DataFrame, column: str, prefixes: Sequence[str] | None) -> DataFrame:
    if not prefixes:
        return rows
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col(column).startswith(p)
    return rows.where(test)


def min_length(rows: DataFrame, least: int = 10) -> DataFrame:
    """Occurrences of at least so many positions, ends included."""
    return rows.where(F.col("end") - F.col("start") + 1 >= least)


def max_entities(rows: DataFrame, most: int | None, ordinal: str = "ordinal") -> DataFrame:
    """Rows before the first row of the entity after the first `most` ones, in file order."""
    if most is None:
        return rows
    first = rows.groupBy("entity").agg(F.min(ordinal).alias("_first"))
    # the most + 1 smallest first rows, found with a bounded heap in each task
    cut = first.orderBy("_first").limit(most + 1).agg(F.when(F.count("*") > most, F.max("_first")).alias("_cut"))
    return rows.crossJoin(F.broadcast(cut)).where(F.col("_cut").isNull() | (F.col(ordinal) < F.col("_cut"))).drop("_cut")


def evidence_distribution(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.groupBy("evidence").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "evidence").limit(n)
