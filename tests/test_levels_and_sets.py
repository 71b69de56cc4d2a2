"""Runs with a least support, stepping down, exact quantiles, bitmaps and numbers, long chains and cycles."""

import collections
import random
import statistics

import pytest
from pyspark.sql import functions as F

from termlift.functions import bitmaps, quantiles
from termlift.operators import associations, features, hierarchy
from termlift.operators import ontology as O
from termlift.plans.pipeline import ConfigurationError, Parameters, associate
from tests.test_associations import bh
from tests.test_tests2x2 import exact

# ------------------------------------------------------------------ runs with a least support


def plain_runs(singles, n):
    return {tuple(singles[i : i + n]) for i in range(len(singles) - n + 1)}


@pytest.mark.parametrize("least,longest", [(1, 3), (3, 5), (100, 3)])
def test_supported_runs_are_the_filtered_runs(spark, least, longest):
    rng = random.Random(least)
    data = [(f"e{i}", [rng.choice("ABC") for _ in range(rng.randrange(7))]) for i in range(60)] + [("none", None)]
    arch = spark.createDataFrame(data, "entity string, singles array<string>")
    support = collections.Counter(r for _, s in data for n in range(1, longest + 1) for r in plain_runs(s or [], n))
    found, report = features.supported_runs(arch, least, longest)
    got = sorted((r.entity, r.feature, r.n_parts) for r in found.collect())
    assert got == sorted((e, ",".join(r), n) for e, s in data for n in range(1, longest + 1) for r in plain_runs(s or [], n) if support[r] >= least)
    levels = {r.n_parts: r for r in report.collect()}
    kept = collections.Counter(len(r) for r, n in support.items() if n >= least)
    assert sorted(levels) == list(range(1, longest + 1)) and all(levels[n].n_kept == kept[n] for n in levels)
    if least == 100:  # nothing is made of what has no support
        assert levels[2].n_rows == levels[3].n_rows == 0
    full = features.entity_features(arch.withColumn("composites", features.composites(F.col("singles"), longest)), True, least, longest)
    assert full.count() == sum(len(set(s or [])) for _, s in data) + sum(n > 1 for _, _, n in got)


def test_bad_supports_are_refused(spark):
    with pytest.raises(ValueError):
        features.supported_runs(spark.createDataFrame([], "entity string, singles array<string>"), 0)
    with pytest.raises(ConfigurationError):
        Parameters(min_support=0)
    with pytest.raises(ConfigurationError):
        Parameters(step_down=True, with_shrinkage=True)


# ------------------------------------------------------------------ stepping down


def plain_step_down(fs, ts, alpha, longest):
    """Every level over all pairs that it opens, absent ones too."""
    ents, terms, out, rejected = set(fs) | set(ts), {x for v in ts.values() for x in v}, {}, None
    for n in range(1, longest + 1):
        runs = {f for v in fs.values() for f in v if len(f.split(",")) == n}
        opened = {(f, t) for f in runs for t in terms}
        if rejected is not None:
            cutoff = lambda f, a, b: ",".join(f.split(",")[a:b])
            opened = {(f, t) for f, t in opened if (cutoff(f, 0, n - 1), t) in rejected and (cutoff(f, 1, n), t) in rejected}
        ps = {}
        for f, t in opened:
            k, m = {e for e in ents if f in fs.get(e, ())}, {e for e in ents if t in ts.get(e, ())}
            a = len(k & m)
            ps[f, t] = (a, exact(a, len(k), len(m), len(ents), lambda x, v, p: x >= a))
        q = bh({x: p for x, (_, p) in ps.items()})
        rejected = {x for x in q if q[x] <= alpha}
        out |= {x: (n, ps[x][0], q[x]) for x in q if n > 1 or ps[x][0]}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stepping_down_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    singles = {f"E{i}": [rng.choice("ABCD") for _ in range(rng.randrange(1, 5))] for i in range(50)}
    fs = {e: {",".join(r) for n in (1, 2, 3) for r in plain_runs(s, n)} for e, s in singles.items()}
    ts = {e: {("T" if "A" in s and "B" in s else "U") if rng.random() < 0.9 else "V"} for e, s in singles.items() if rng.random() < 0.9}
    f = spark.createDataFrame([(e, x) for e, v in fs.items() for x in v], "entity string, feature string")
    t = spark.createDataFrame([(e, x) for e, v in ts.items() for x in v], "entity string, term string")
    want = plain_step_down(fs, ts, 0.4, 3)
    got = {(r.feature, r.term): (r.level, r.a, r.q_value, r.rejected) for r in hierarchy.step_down(f, t, 0.4).collect()}
    assert got.keys() == want.keys() and any(v[0] > 1 for v in got.values())
    for x, (level, a, q, rejected) in got.items():
        assert (level, a) == want[x][:2] and q == pytest.approx(want[x][2], rel=1e-9) and rejected == (q <= 0.4)


def test_stepping_down_without_rows_and_in_the_pipeline(spark):
    none = hierarchy.step_down(spark.createDataFrame([], "entity string, feature string"), spark.createDataFrame([], "entity string, term string"))
    assert none.count() == 0 and {"level", "q_value", "rejected"} <= set(none.columns)
    with pytest.raises(ValueError):
        hierarchy.step_down(none, none, 1.0)
    arch = [(f"e{i}", ["A", "B"] if i % 2 else ["C"], ["A,B"] if i % 2 else []) for i in range(40)]
    a = spark.createDataFrame(arch, "entity string, singles array<string>, composites array<string>")
    t = spark.createDataFrame([(f"e{i}", "t1" if i % 2 else "t2") for i in range(40)], "entity string, term string")
    got = associate(a, t, Parameters(step_down=True, min_support=3))
    assert ("A,B", "t1") in {(r.feature, r.term) for r in got.significant.collect()}


# ------------------------------------------------------------------ quantiles


@pytest.mark.parametrize("few,classes", [(50_000, 1000), (20, 7), (1, 3)])
def test_quantiles_are_exact(spark, few, classes):
    rng = random.Random(few)
    values = [rng.choice([0.5, 1e-300, -2.0, rng.random(), round(rng.random(), 1)]) for _ in range(700)] + [0.5] * 300
    rows = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(4)
    asked = [0, 0.001, 0.25, 0.5, 0.9, 1]
    want = sorted(values)

    def plain(p):
        at = (len(want) - 1) * p
        low = int(at)
        return want[low] + (want[min(low + 1, len(want) - 1)] - want[low]) * (at - low)

    assert quantiles.quantiles(rows, "x", asked, few=few, classes=classes) == pytest.approx([plain(p) for p in asked])


def test_quantiles_with_weights_and_without_values(spark):
    rows = spark.createDataFrame([(1.0, 1), (5.0, 10**12), (2.0, 3), (9.0, 0), (7.0, None)], "x double, w long")
    assert quantiles.quantiles(rows, "x", [0, 0.5, 1], "w") == [1.0, 5.0, 5.0]
    assert quantiles.quantiles(rows, "x", [0, 0.5, 1], "w", few=1, classes=2) == [1.0, 5.0, 5.0]
    assert quantiles.quantiles(rows.limit(0), "x", [0.5]) == [None]
    assert quantiles.quantiles(rows, "x", [0.5])[0] == statistics.median([1, 5, 2, 9, 7])
    with pytest.raises(ValueError):
        quantiles.quantiles(rows, "x", [1.5])


# ------------------------------------------------------------------ bitmaps


def test_numbers_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") % 313).cast("string").alias("e")).union(spark.createDataFrame([(None,)], "e string")).repartition(7)
    got = sorted(r.number for r in bitmaps.dense_numbers(rows, "e").collect())
    assert got == list(range(313))


def test_common_members(spark):
    rng = random.Random(5)
    sets = {s: {rng.randrange(5000) for _ in range(n)} for s, n in (("x", 3000), ("y", 40), ("z", 1))} | {"edge": {0, 63, 64, 1023, 1024, 4999}}
    rows = spark.createDataFrame([(s, n) for s, v in sets.items() for n in [*v, min(v)]], "s string, number long")
    left, right = bitmaps.bitmaps(rows, "s", "l"), bitmaps.bitmaps(rows, "s", "r").withColumnRenamed("s", "t")
    got = {(r.s, r.t): r.n for r in left.join(right, "chunk").groupBy("s", "t").agg(F.sum(bitmaps.members("l", "r")).alias("n")).collect()}
    assert all(got.get((s, t), 0) == len(sets[s] & sets[t]) for s in sets for t in sets)


def test_conditional_counts_against_plain_sets(spark):
    rng = random.Random(8)
    has = {(f"e{i}", f"F{rng.randrange(4)}") for i in range(300) for _ in range(2)}
    own = {(f"e{i}", t) for i in range(300) for t in ["R"] * (i % 10 > 0) + [f"t{rng.randrange(5)}"]}
    wanted = [("F0", "t0", "R"), ("F1", "t1", "R"), ("F1", "t1", "t2"), ("F9", "t1", "R"), ("F2", "absent", "R"), ("F2", "t3", "gone")]
    of = lambda rows, x: {e for e, y in rows if y == x}
    got = O.conditional_counts(spark.createDataFrame(wanted, "feature string, term string, next string"), spark.createDataFrame(sorted(has), "entity string, feature string"), spark.createDataFrame(sorted(own), "entity string, term string"))
    rows = {(r.feature, r.term, r.next): (r.background, r.ac, r.af, r.afc) for r in got.collect()}
    for f, t, n in wanted:
        base = of(own, n)
        assert rows[f, t, n] == (len(base), len(base & of(own, t)), len(base & of(has, f)), len(base & of(own, t) & of(has, f)))


# ------------------------------------------------------------------ chains and cycles

E = "child string, parent string, relation string"


def test_a_chain_of_three_hundred_terms(spark):
    chain = spark.createDataFrame([(f"t{i:03}", f"t{i + 1:03}", "is_a") for i in range(300)], E)
    got = O.closure(chain.repartition(2))
    assert got.count() == 300 * 301 // 2 and got.where("term = 't000' and ancestor = 't300'").first().depth == 300


def test_peeling_and_cycles(spark):
    tree = [("a", "b"), ("b", "c"), ("c", "R"), ("x", "R"), ("d", "b")]
    edges = lambda pairs: spark.createDataFrame([(*p, "is_a") for p in pairs], E)
    left, rounds = O.peeled(edges(tree))
    assert left.isEmpty() and rounds <= 2 and O.cycles(edges(tree)).isEmpty()
    # two cycles with a way between them, one term below, one above; a term that is its own parent
    rings = [("p", "q"), ("q", "p"), ("q", "m"), ("m", "s"), ("s", "t"), ("t", "u"), ("u", "s"), ("low", "p"), ("u", "R"), ("z", "z"), (None, "R")]
    left, _ = O.peeled(edges(tree + rings))
    assert {(r.child, r.parent) for r in left.collect()} == {("p", "q"), ("q", "p"), ("q", "m"), ("m", "s"), ("s", "t"), ("t", "u"), ("u", "s"), ("z", "z")}
    got = {r.term: (r.cycle, r.n_terms) for r in O.cycles(edges(tree + rings)).collect()}
    assert got == {"p": ("p", 2), "q": ("p", 2), "s": ("s", 3), "t": ("s", 3), "u": ("s", 3), "z": ("z", 1)}
    row = O.check_acyclic(edges(tree + rings)).first()
    assert (row.is_acyclic, row.n_cyclic, row.n_cycles) == (False, 6, 3)
    assert O.check_acyclic(edges(tree)).first().is_acyclic and O.check_acyclic(edges([]).limit(0)).first().is_acyclic


def test_the_level_filter_equals_one_by_joins(spark):
    """Entities in many sets, none in some."""
    rows = spark.createDataFrame([("F0", "t0", 0.0, 10.0)], "feature string, term string, q_value double, hyper_score double")
    own = spark.createDataFrame([(f"e{i}", t) for i in range(100) for t in (["R", "t0"] if i < 30 else ["R"])], "entity string, term string")
    feats = spark.createDataFrame([(f"e{i}", "F0") for i in range(0, 60, 2)], "entity string, feature string")
    e = spark.createDataFrame([("t0", "R", "is_a")], E)
    test = O.optimal_level_tests(rows, feats, own, e).first()
    assert (test.background, test.af, test.ac, test.afc) == (100, 30, 30, 15) and test.p == pytest.approx(exact(15, 30, 30, 100, lambda x, v, p: x >= 15))
    assert O.optimal_level_tests(rows.limit(0), feats, own, e).count() == 0
    assert associations.cooccurrence(feats, own).where("term = 't0'").first().a == 15
