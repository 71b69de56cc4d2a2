"""Operators on an ontology: terms(term, name, namespace, definition, is_obsolete), edges(child, parent, relation).

Closures run towards the root by default ("to_root"); "to_leaf" turns all edges round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlift.functions.bitmaps import dense_numbers
from termlift.functions.lineage import cut
from termlift.functions.tests2x2 import test_tables
from termlift.operators.associations import profiles

MIN_BACKGROUND, ALPHA = 10, 0.05


def live_terms(terms: DataFrame) -> DataFrame:
    return terms.where(~F.coalesce("is_obsolete", F.lit(False)))


def live_edges(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between terms that are there and not obsolete."""
    ids = live_terms(terms).select("term")
    return edges.join(ids.withColumnRenamed("term", "child"), "child", "left_semi").join(ids.withColumnRenamed("term", "parent"), "parent", "left_semi")


def neighbours(edges: DataFrame, orientation: str = "to_root", relations: Sequence[str] | None = None) -> DataFrame:
    """Distinct (term, next)."""
    if orientation not in ("to_root", "to_leaf"):
        raise ValueError(f"orientation must be to_root or to_leaf, not {orientation!r}")
    if relations:
        edges = edges.where(F.col("relation").isin(*relations))
    a, b = ("child", "parent") if orientation == "to_root" else ("parent", "child")
    return edges.select(F.col(a).alias("term"), F.col(b).alias("next")).distinct()


def closure(edges: DataFrame, orientation: str = "to_root", relations: Sequence[str] | None = None) -> DataFrame:
    """(term, ancestor, depth): all terms reachable by one or more steps, with the fewest steps.

    Paths double: after round r all pairs of at most 2^r steps are known with their fewest steps, so joining the pairs
    with themselves gives those of twice as many, and a chain of any length takes as many rounds as its length has
    bits. A round that finds no new pair is the last, so a cycle ends too (and then holds (t, t))."""
    known = cut(neighbours(edges, orientation, relations).select("term", F.col("next").alias("ancestor"), F.lit(1).alias("depth")))
    n = known.count()
    while n:
        on = known.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("depth").alias("_more"))
        further = known.join(on, "ancestor").select("term", F.col("_next").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))
        doubled = cut(known.unionByName(further).groupBy("term", "ancestor").agg(F.min("depth").alias("depth")))
        before, n = n, doubled.count()
        if n == before:
            break
        known = doubled
    return known


def cyclic_terms(paths: DataFrame) -> DataFrame:
    return paths.where("term = ancestor").select("term")


def peeled(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges (child, parent) that peeling leaves, and the number of rounds.

    A round removes the edges into terms that have no parent left and those out of terms that have no child left. A
    graph without cycles loses all of them in at most half as many rounds as its longest chain has edges, rounded up; of any other
    the cycles and what lies between two of them stay. Each round reads what the last one left."""
    left = cut(edges.select("child", "parent").where("child is not null and parent is not null").distinct())
    n, rounds = left.count(), 0
    while n:
        inner = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        inner = cut(inner.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent"))
        before, n, rounds = n, inner.count(), rounds + 1
        if n == before:
            break
        left = inner
    return left, rounds


def cycles(edges: DataFrame) -> DataFrame:
    """(term, cycle, n_terms): terms that can reach themselves, the smallest term of their cycle or joined cycles, and how
    many terms that has. Empty for a graph without cycles, of which only the peeling is computed: paths are followed among what it leaves."""
    left, _ = peeled(edges)
    paths = closure(left)
    back = paths.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("term"))
    both = paths.select("term", "ancestor").join(back, ["term", "ancestor"], "left_semi")
    return both.groupBy("term").agg(F.min("ancestor").alias("cycle"), F.count("*").alias("n_terms"))


def check_acyclic(edges: DataFrame) -> DataFrame:
    """One row: is_acyclic, n_terms and n_edges, and how many terms lie on cycles, and how many separate ones there are."""
    ends = edges.select(F.explode(F.array("child", "parent")).alias("term")).where("term is not null")
    counts = ends.agg(F.count_distinct("term").alias("n_terms")).crossJoin(edges.agg(F.count("*").alias("n_edges")))
    found = cycles(edges).agg(F.count("*").alias("n_cyclic"), F.count_distinct("cycle").alias("n_cycles"))
    return counts.crossJoin(found).select((F.col("n_cyclic") == 0).alias("is_acyclic"), "n_terms", "n_edges", "n_cyclic", "n_cycles")


def relatives_count(terms: DataFrame, paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Per term: its facts, degrees, and numbers of ancestors and descendants."""
    up = paths.groupBy("term").agg(F.count("*").alias("n_ancestors"))
    down = paths.groupBy(F.col("ancestor").alias("term")).agg(F.count("*").alias("n_descendants"))
    out = edges.groupBy(F.col("child").alias("term")).agg(F.count("*").alias("n_parents"))
    into = edges.groupBy(F.col("parent").alias("term")).agg(F.count("*").alias("n_children"))
    for extra in (out, into, up, down):
        terms = terms.join(extra, "term", "left")
    counts = ["n_parents", "n_children", "n_ancestors", "n_descendants"]
    return terms.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})


def statistics(terms: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: terms, edges, roots, leaves, and depths over (leaf, reachable) pairs with the leaf itself."""
    flagged = terms.select("term").join(edges.select(F.col("child").alias("term"), F.lit(True).alias("up")).distinct(), "term", "left")
    flagged = flagged.join(edges.select(F.col("parent").alias("term"), F.lit(True).alias("down")).distinct(), "term", "left")
    counts = flagged.agg(F.count("*").alias("n_terms"), F.count_if(F.col("up").isNull()).alias("n_roots"), F.count_if(F.col("down").isNull()).alias("n_leaves"))
    leaves = flagged.where("down is null").select("term")
    depths = paths.join(leaves, "term", "left_semi").select("depth").unionByName(leaves.select(F.lit(0).alias("depth")))
    deep = depths.agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"), F.coalesce(F.avg("depth"), F.lit(0.0)).alias("avg_depth"))
    return counts.crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(deep)


def namespace_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("namespace").agg(F.count("*").alias("n_terms"))


def with_ancestors(entity_terms: DataFrame, paths: DataFrame, distinct: bool = True) -> DataFrame:
    """(entity, term) with every term's ancestors added; each once, unless what reads them does not mind."""
    more = entity_terms.join(paths.select("term", "ancestor"), "term").select("entity", F.col("ancestor").alias("term"))
    every = entity_terms.select("entity", "term").unionByName(more)
    return every.distinct() if distinct else every


def conditional_counts(wanted: DataFrame, features: DataFrame | None, entity_terms: DataFrame, weights: DataFrame | None = None, made: Column | None = None) -> DataFrame:
    """wanted(feature, term, next), distinct: adds background, ac, af and afc, the entities with next, and those of them
    with the term, with the feature, and with both. Repeated rows of features and entity_terms count once; with weights(entity, n)
    an entity counts n times. With made, weights(entity, n, ...) is a row for each entity, and made the array of its distinct features from
    the other columns, so that features are neither dealt nor written: features is not read then.

    Features and terms that are asked for get numbers, and an entity's numbers lie in one row (associations.profiles()), in which its
    pairs are made and counted before they are dealt. No count is restricted to what is asked before that: Spark would restrict
    each entity's pairs, and deal them all for it. Where the entities of a term all have next, as with ancestors added, afc is the
    count of the feature with the term, and where those with next all have the term, that of the feature with next;
    both show in the counts, so triples are made only for the steps between terms that overlap otherwise."""
    of_term = cut(dense_numbers(wanted.select("term").union(wanted.select("next")), "term"))
    of_feature = cut(dense_numbers(wanted, "feature"))
    named = wanted.join(of_feature.withColumnRenamed("number", "f"), "feature", "left").join(of_term.withColumnRenamed("number", "t"), "term", "left")
    named = cut(named.join(of_term.select(F.col("term").alias("next"), F.col("number").alias("x")), "next", "left"))
    own = entity_terms.where("entity is not null").join(of_term, "term").select("entity", F.col("number").alias("term"))
    if made is None:
        has = features.where("entity is not null").join(of_feature, "feature").select("entity", F.col("number").alias("feature"))
        both = cut(profiles(has, own, weights).where("terms is not null").select("features", "terms", "n"))
    else:
        both = cut(weights.join(own.groupBy("entity").agg(F.collect_set("term").alias("terms")), "entity").drop("entity"))

    def counted(rows: DataFrame, *keys: str) -> DataFrame:
        """(f, *keys, _n): the entities of each feature of rows, with those keys."""
        found = rows.groupBy("f", *keys).agg(F.sum("n").alias("_n"))
        return found if made is None else found.withColumnRenamed("f", "feature").join(of_feature.withColumnRenamed("number", "f"), "feature").drop("feature")

    each = F.explode(F.col("features") if made is None else made).alias("f")
    size = cut(both.select(F.explode("terms").alias("t"), "n").groupBy("t").agg(F.sum("n").alias("size")))
    steps = cut(named.select("t", "x").distinct())
    within = both.select("*", F.explode("terms").alias("t"))
    ac = within.select("terms", "t", "n").join(steps, "t").where("array_contains(terms, x)").groupBy("t", "x").agg(F.sum("n").alias("ac"))
    size_x = size.select(F.col("t").alias("x"), F.col("size").alias("background"))
    steps = cut(steps.join(ac, ["t", "x"], "left").join(size, "t", "left").join(size_x, "x", "left"))
    pairs = cut(counted(both.select(each, "terms", "n").select("f", F.explode("terms").alias("t"), "n"), "t").withColumnRenamed("_n", "aft"))
    rows = named.join(steps, ["t", "x"], "left").join(pairs, ["f", "t"], "left").join(pairs.select("f", F.col("t").alias("x"), F.col("aft").alias("af")), ["f", "x"], "left")
    afc = F.when(F.col("ac") == F.col("size"), F.col("aft")).when(F.col("ac") == F.col("background"), F.col("af"))
    other = steps.where("ac < size and ac < background").select("t", "x")
    if not other.isEmpty():
        triples = counted(within.join(other, "t").where("array_contains(terms, x)").select(each, "t", "x", "n"), "t", "x")
        rows, afc = rows.join(triples.withColumnRenamed("_n", "_afc"), ["f", "t", "x"], "left"), afc.otherwise(F.col("_afc"))
    found = {"background": F.col("background"), "ac": F.col("ac"), "af": F.col("af"), "afc": afc}
    return rows.select("feature", "term", "next", *[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in found.items()])


def optimal_level_tests(assocs: DataFrame, features: DataFrame | None, entity_terms: DataFrame, edges: DataFrame, orientation: str = "to_root", relations: Sequence[str] | None = None, weights: DataFrame | None = None, made: Column | None = None) -> DataFrame:
    """(feature, term, next, background, af, ac, afc, p): each association tested within every neighbouring term's entities."""
    wanted = cut(assocs.select("feature", "term").distinct().join(neighbours(edges, orientation, relations), "term"))
    rows = test_tables(cut(conditional_counts(wanted, features, entity_terms, weights, made)), out="p", names=("afc", "af", "ac", "background"))
    return rows.select("feature", "term", "next", "background", "af", "ac", "afc", F.when(F.col("afc") == 0, 1.0).otherwise(F.col("p")).alias("p"))


def optimal_level(assocs: DataFrame, features: DataFrame | None, entity_terms: DataFrame, edges: DataFrame, min_background: int = MIN_BACKGROUND, alpha: float = ALPHA, orientation: str = "to_root", relations: Sequence[str] | None = None, small_rejects: bool = True, weights: DataFrame | None = None, made: Column | None = None) -> DataFrame:
    """Associations that are stronger than every neighbouring term's background explains; those of terms
    without neighbours, or unknown, stay; a neighbour with too small a background rejects, or is passed over."""
    tests = optimal_level_tests(assocs, features, entity_terms, edges, orientation, relations, weights, made)
    small, weak = F.col("background") < min_background, ~(F.col("p") < alpha)
    fails = tests.where(small | weak if small_rejects else ~small & weak).select("feature", "term").distinct()
    return assocs.join(fails, ["feature", "term"], "left_anti")


def valid(score: Column, q: Column) -> Column:
    return F.coalesce(score.between(1, 100) & q.between(0, 1), F.lit(False))


def propagate_all(assocs: DataFrame, paths: DataFrame) -> DataFrame:
    """As propagate(), but with a row for every source of a (feature, term)."""
    good = assocs.where(valid(F.col("association_score"), F.col("q_value"))).select("feature", F.col("term").alias("direct_source_term"), "q_value", "association_score")
    own = good.select("feature", F.col("direct_source_term").alias("term"), "q_value", "association_score", F.lit("direct").alias("annotation_type"), "direct_source_term")
    up = good.join(paths.select(F.col("term").alias("direct_source_term"), F.col("ancestor").alias("term")), "direct_source_term")
    return own.unionByName(up.withColumn("annotation_type", F.lit("propagated")))


def propagate(assocs: DataFrame, paths: DataFrame, prefer_direct: bool = False) -> DataFrame:
    """assocs(feature, term, q_value, association_score): valid ones and their ancestors, each (feature, term) once.

    Of several sources the smallest source term wins, also over a direct association, whose row then is
    the propagated one; prefer_direct keeps it direct."""
    good = assocs.where(valid(F.col("association_score"), F.col("q_value"))).select("feature", F.col("term").alias("source_term"), "q_value", "association_score")
    own = good.withColumn("term", F.col("source_term"))
    up = good.join(paths.select(F.col("term").alias("source_term"), F.col("ancestor").alias("term")), "source_term")
    every = own.unionByName(up.select(*own.columns))
    first = F.struct((F.lit(prefer_direct) & (F.col("term") != F.col("source_term"))).alias("late"), F.col("source_term"))
    won = every.groupBy("feature", "term").agg(F.min_by(F.struct("q_value", "association_score", "source_term"), first).alias("w"))
    kind = F.when(F.col("term") == F.col("w.source_term"), "direct").otherwise("propagated")
    return won.select("feature", "term", "w.q_value", "w.association_score", kind.alias("annotation_type"), F.col("w.source_term").alias("direct_source_term"))


def validate(annotations: DataFrame, terms: DataFrame) -> DataFrame:
    """One row of counts: total, valid, faults (the first that applies), and sources that are never direct."""
    known = terms.select("term", F.lit(True).alias("_known"))
    rows = annotations.join(known, "term", "left")
    fault = (
        F.when(~F.coalesce(F.col("annotation_type").isin("direct", "propagated"), F.lit(False)), "invalid_type")
        .when(~F.coalesce(F.col("association_score").between(1, 100), F.lit(False)), "invalid_score")
        .when(~F.coalesce(F.col("q_value").between(0, 1), F.lit(False)), "invalid_q_value")
        .when(F.col("_known").isNull(), "invalid_term")
        .otherwise("ok")
    )
    faults = rows.withColumn("_fault", fault)
    pairs = faults.where("_fault = 'ok'").groupBy("feature", "term").agg(F.count("*").alias("_n"))
    double = pairs.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_pairs"))
    direct = annotations.where("annotation_type = 'direct'").select(F.col("term").alias("direct_source_term")).distinct()
    stray = annotations.where("annotation_type = 'propagated' and direct_source_term is not null").select("direct_source_term").distinct().join(direct, "direct_source_term", "left_anti")
    is_ = lambda x: F.count_if(F.col("_fault") == x)
    counts = faults.agg(F.count("*").alias("total"), is_("ok").alias("_ok"), is_("invalid_term").alias("invalid_terms"), is_("invalid_score").alias("invalid_scores"), is_("invalid_q_value").alias("invalid_q_values"))
    out = counts.crossJoin(double).crossJoin(stray.agg(F.count("*").alias("consistency_errors")))
    return out.select("total", (F.col("_ok") - F.col("duplicate_pairs")).alias("valid"), "invalid_terms", "invalid_scores", "invalid_q_values", "duplicate_pairs", "consistency_errors")
