"""The whole inference as one composition: features, pairs, tests, shrinkage, adjustment, ontology, evaluation."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlift.functions.lineage import cut
from termlift.operators import associations, features, hierarchy, ontology, shrinkage


class ConfigurationError(ValueError):
    """Parameters that do not fit."""


#: How a variable of the environment is read, by the annotation of its field.
_READ = {"bool": lambda raw: raw.lower() in ("1", "true", "yes"), "int": int, "float": float, "str": str}


@dataclass(frozen=True)
class Parameters:
    evidence: str = "manual"
    alpha: float = 0.01
    with_composites: bool = True
    max_run: int = 3
    with_shrinkage: bool = False
    shrinkage_strength: float = 0.5
    shrinkage_min_obs: float = 3
    with_ontology: bool = False
    level_alpha: float = 0.05
    min_background: int = 3
    orientation: str = "to_root"
    prefer_direct: bool = False
    propagate_entity_terms: bool = False
    min_cooccurrence: int = 1
    min_support: int = 1
    step_down: bool = False

    def __post_init__(self) -> None:
        for name in ("alpha", "level_alpha"):
            if not 0 < getattr(self, name) < 1:
                raise ConfigurationError(f"{name} must lie between 0 and 1")
        if not 0 <= self.shrinkage_strength <= 1:
            raise ConfigurationError("shrinkage_strength must lie in [0, 1]")
        if self.shrinkage_min_obs <= 0 or self.max_run < 1 or self.min_background < 0 or self.min_cooccurrence < 1 or self.min_support < 1:
            raise ConfigurationError("shrinkage_min_obs, max_run, min_cooccurrence and min_support must be positive, min_background not negative")
        if self.step_down and self.with_shrinkage:
            raise ConfigurationError("composites are weighted by shrinkage or by stepping down, not by both")
        if self.orientation not in ("to_root", "to_leaf"):
            raise ConfigurationError("orientation must be to_root or to_leaf")

    @classmethod
    def from_environment(cls, prefix: str = "TERMLIFT_", **given) -> Parameters:
        """Given values, then variables such as TERMLIFT_ALPHA over them; validated as a whole."""
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                given[f.name] = _READ[f.type](raw)
        return cls(**given)


#: The eight configurations of a comparative run.
CONFIGURATIONS = {
    "baseline": Parameters(with_composites=False),
    "composites": Parameters(),
    "shrinkage": Parameters(with_shrinkage=True),
    "ontology": Parameters(with_ontology=True),
    "shrinkage_ontology": Parameters(with_shrinkage=True, with_ontology=True),
    "baseline_ontology": Parameters(with_composites=False, with_ontology=True),
    "experimental": Parameters(evidence="experimental"),
    "all_evidence": Parameters(evidence="all"),
}


@dataclass
class Result:
    tested: DataFrame
    significant: DataFrame
    annotations: DataFrame | None


def associate(occurrence_arch: DataFrame, terms: DataFrame | None, params: Parameters, edges: DataFrame | None = None) -> Result:
    """occurrence_arch: as of features.architectures(); terms(entity, term) distinct; edges of the ontology. Where terms is None,
    occurrence_arch is (entity, singles, terms), with an entity's distinct terms in order; its composites are made where they are read.

    Features are those of entities that have terms too; all annotated entities count as the universe."""
    plain = (params.min_support == 1 or not params.with_composites) and not (params.propagate_entity_terms and edges is not None)
    if terms is None:
        parts, every = ["singles"], occurrence_arch.select("entity", "singles", "terms")
    else:
        grouped = terms.groupBy("entity").agg(F.sort_array(F.collect_set("term")).alias("terms"))
        parts = ["singles", "composites"]
        every = occurrence_arch.select("entity", *parts).join(grouped, "entity", "right")
    every = every.withColumn("nameless", F.col("entity").isNull())
    if plain and not params.step_down:  # entities of the same features and terms are one, which counts n times
        every = every.groupBy(*parts, "terms", "nameless").agg(F.count("*").alias("n")).withColumn("entity", F.when(~F.col("nameless"), F.monotonically_increasing_id()))
    else:
        every = every.withColumn("n", F.lit(1).cast("long"))
    every = cut(every)
    weights = every.select("entity", "n", *parts)
    composites = F.col("composites") if "composites" in parts else features.composites(F.col("singles"), params.max_run)
    made = F.array_distinct(F.concat(F.col("singles"), composites)) if params.with_composites else F.array_distinct("singles")
    every = every.withColumn("composites", composites)
    terms, both = every.select("entity", F.explode("terms").alias("term"), "n"), every.where("singles is not null")
    feats = features.entity_features(both, params.with_composites, params.min_support, params.max_run)
    known = cut(both.select(F.explode("terms").alias("term")).distinct())
    own = terms.select("entity", "term").join(known, "term", "left_semi")
    paths = ontology.closure(edges, params.orientation) if edges is not None and (params.with_ontology or params.propagate_entity_terms) else None
    if params.propagate_entity_terms and paths is not None:
        own = ontology.with_ancestors(own, paths)
    universe = cut(associations.entities(every))  # features are of annotated entities
    shrunk = params.with_shrinkage and params.with_composites
    if params.step_down:
        rows = hierarchy.step_down(feats, own, params.alpha, params.max_run if params.with_composites else 1, universe)
        rows = rows.where(F.col("a") >= params.min_cooccurrence)
    else:
        if plain:  # an entity's features are in its row already
            profiles = both.select(made.alias("features"), "terms", "nameless", "n")
            of_features = associations.marginals(profiles.select(F.explode("features").alias("feature"), "n"), "feature", "k")
            of_terms = associations.marginals(terms.join(known, "term", "left_semi"), "term", "m")
        else:
            profiles = cut(associations.profiles(feats, own))
            of_features, of_terms = associations.marginals(feats, "feature", "k"), associations.marginals(own, "term", "m")
        pairs = cut(associations.met(profiles).where(F.col("a") >= params.min_cooccurrence))
        of_features, of_terms = cut(of_features), cut(of_terms)
        if shrunk:
            meta = features.described(of_features.withColumnRenamed("k", "n_obs"))
            pairs = cut(shrinkage.extended_pairs(pairs, meta))
        rows = associations.tested(associations.cells(pairs, of_features, of_terms, universe))
        if shrunk:
            rows = shrinkage.shrink(cut(rows), meta, params.shrinkage_strength, params.shrinkage_min_obs)
        n_tests = of_features.where("feature is not null").count() * of_terms.where("term is not null").count()
        rows = associations.adjusted(cut(rows), n_tests)  # the ranks read it more than once
        rows = cut(rows) if params.with_ontology else rows
    hits = associations.significant(rows, params.alpha)
    annotations = None
    if params.with_ontology and edges is not None:
        reached = ontology.with_ancestors(terms, paths, distinct=False)  # repeated rows count as one
        # with a least support not all runs are features, so they are taken as rows
        given = {"features": None, "weights": weights, "made": made} if plain else {"features": feats, "weights": weights.select("entity", "n")}
        level = ontology.optimal_level(hits, entity_terms=reached, edges=edges, min_background=params.min_background, alpha=params.level_alpha, orientation=params.orientation, **given)
        annotations = ontology.propagate(level.withColumnRenamed("hyper_score", "association_score"), paths, params.prefer_direct)
    return Result(rows, hits, annotations)
