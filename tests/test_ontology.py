import pytest

from termlift.operators import ontology as O

# A diamond under R, and one term that is alone
EDGES = [("a", "b", "is_a"), ("a", "c", "part_of"), ("b", "R", "is_a"), ("c", "R", "is_a")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "child string, parent string, relation string")


def paths(df):
    return sorted((r.term, r.ancestor, r.depth) for r in df.collect())


def test_closure_and_direction(edges):
    assert paths(O.closure(edges)) == [("a", "R", 2), ("a", "b", 1), ("a", "c", 1), ("b", "R", 1), ("c", "R", 1)]
    assert ("R", "a", 2) in paths(O.closure(edges, "to_leaf"))
    assert paths(O.closure(edges, relations=["is_a"])) == [("a", "R", 2), ("a", "b", 1), ("b", "R", 1), ("c", "R", 1)]
    with pytest.raises(ValueError):
        O.closure(edges, "sideways")


def test_cycle_ends(spark):
    e = spark.createDataFrame([("x", "y", "is_a"), ("y", "x", "is_a")], "child string, parent string, relation string")
    assert {r.term for r in O.cyclic_terms(O.closure(e)).collect()} == {"x", "y"}


def test_known_branch(spark):
    e = spark.createDataFrame([(f"GO:{c}", f"GO:{p}", "is_a") for c, p in [("9987", "8150"), ("6810", "9987"), ("6811", "6810"), ("6812", "6811"), ("5215", "3674"), ("8324", "5215"), ("5488", "3674")]], "child string, parent string, relation string")
    assert {r.ancestor for r in O.closure(e).where("term = 'GO:6812'").collect()} == {"GO:6811", "GO:6810", "GO:9987", "GO:8150"}


def test_obsolete_terms_take_their_edges_along(spark, edges):
    terms = spark.createDataFrame([("a", False), ("b", True), ("c", False), ("R", None)], "term string, is_obsolete boolean")
    assert sorted((r.child, r.parent) for r in O.live_edges(terms, edges).collect()) == [("a", "c"), ("c", "R")]


def test_statistics(spark, edges):
    terms = spark.createDataFrame([(t, "n") for t in ["a", "b", "c", "R", "alone"]], "term string, namespace string")
    s = O.statistics(terms, edges, O.closure(edges)).first()
    assert (s.n_terms, s.n_edges, s.n_roots, s.n_leaves, s.max_depth) == (5, 4, 2, 2, 2)
    assert s.avg_depth == pytest.approx((0 + 0 + 1 + 1 + 2) / 5)
    counts = {r.term: (r.n_parents, r.n_children, r.n_ancestors, r.n_descendants) for r in O.relatives_count(terms, O.closure(edges), edges).collect()}
    assert counts == {"a": (2, 0, 3, 0), "b": (1, 1, 1, 1), "c": (1, 1, 1, 1), "R": (0, 2, 0, 3), "alone": (0, 0, 0, 0)}


SCHEMA = "feature string, term string, q_value double, association_score double"


def test_propagation_first_source_wins(spark, edges):
    assocs = spark.createDataFrame([("F", "c", 0.01, 50.0), ("F", "a", 0.001, 90.0), ("G", "b", 0.02, 20.0), ("H", "unknown", 0.03, 30.0), ("I", "a", 0.5, 150.0)], SCHEMA)
    rows = O.propagate(assocs, O.closure(edges)).collect()
    got = {(r.feature, r.term): (r.annotation_type, r.direct_source_term, r.association_score) for r in rows}
    assert len(rows) == len(got)
    assert got["F", "a"] == ("direct", "a", 90.0)
    assert got["F", "c"] == ("propagated", "a", 90.0)  # claimed by the smaller source
    assert got["F", "R"] == ("propagated", "a", 90.0)
    assert got["G", "R"] == ("propagated", "b", 20.0)
    assert got["H", "unknown"] == ("direct", "unknown", 30.0)
    assert not any(f == "I" for f, _ in got)
    direct = {(r.feature, r.term): r.annotation_type for r in O.propagate(assocs, O.closure(edges), prefer_direct=True).collect()}
    assert direct["F", "c"] == "direct"
    assert O.propagate(assocs.limit(0), O.closure(edges)).count() == 0


def test_optimal_level(spark, edges):
    # within b's entities, feature F is tied to a; feature G is not
    et, ef = [], []
    for i in range(20):
        et.append((f"e{i}", "b"))
        if i < 10:
            et += [(f"e{i}", "a"), (f"e{i}", "c")]
            ef.append((f"e{i}", "F"))
        else:
            et.append((f"e{i}", "c"))
        ef.append((f"e{i}", "G"))
    own = spark.createDataFrame(et, "entity string, term string")
    feats = spark.createDataFrame(ef, "entity string, feature string")
    assocs = spark.createDataFrame([("F", "a"), ("G", "a"), ("F", "R"), ("F", "unknown")], "feature string, term string")
    keep = lambda **k: {(r.feature, r.term) for r in O.optimal_level(assocs, feats, own, edges, **k).collect()}
    assert keep() == {("F", "a"), ("F", "R"), ("F", "unknown")}
    assert keep(min_background=21) == {("F", "R"), ("F", "unknown")}
    assert keep(alpha=1e-9) == {("F", "R"), ("F", "unknown")}
    assert O.optimal_level(assocs.limit(0), feats, own, edges).count() == 0


def test_validation_counts(spark):
    rows = spark.createDataFrame(
        [("F", "a", 0.1, 50.0, "direct", "a"), ("F", "a", 0.1, 50.0, "direct", "a"), ("F", "zz", 0.1, 50.0, "direct", "zz"), ("F", "b", 0.1, 150.0, "direct", "b"), ("F", "c", 1.5, 50.0, "direct", "c"), ("F", "R", 0.1, 50.0, "propagated", "never"), ("F", "R", 0.1, 50.0, "odd", "a")],
        "feature string, term string, q_value double, association_score double, annotation_type string, direct_source_term string",
    )
    terms = spark.createDataFrame([(t,) for t in ["a", "b", "c", "R"]], "term string")
    r = O.validate(rows, terms).first()
    assert (r.total, r.valid, r.invalid_terms, r.invalid_scores, r.invalid_q_values, r.duplicate_pairs, r.consistency_errors) == (7, 2, 1, 1, 1, 1, 1)
