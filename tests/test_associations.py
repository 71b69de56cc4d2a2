import math
import random

import pytest

from termlift.operators import associations as A
from termlift.operators import features, shrinkage
from tests.test_tests2x2 import exact


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"entity string, {name} string")


def test_small_table(spark):
    f = frame(spark, [("P1", "D1"), ("P2", "D1"), ("P2", "D2"), ("P3", "D2")], "feature")
    t = frame(spark, [("P1", "G1"), ("P2", "G1"), ("P2", "G2"), ("P3", "G2")], "term")
    n = spark.createDataFrame([(4,)], "n long")
    got = {(r.feature, r.term): (r.a, r.b, r.c, r.d) for r in A.contingency(f, t, n).collect()}
    assert got["D1", "G1"] == (2, 0, 0, 2) and all(sum(v) == 4 for v in got.values())


def dense(features_, terms_):
    """Brute force: every feature with every term."""
    ents = set(features_) | set(terms_)
    fs, ts = sorted({x for v in features_.values() for x in v}), sorted({x for v in terms_.values() for x in v})
    out = {}
    for f in fs:
        for t in ts:
            k, m = {e for e in ents if f in features_.get(e, ())}, {e for e in ents if t in terms_.get(e, ())}
            a = len(k & m)
            out[f, t] = (a, exact(a, len(k), len(m), len(ents), lambda x, v, p: x >= a))
    return out


def bh(ps):
    order = sorted(ps, key=ps.get)
    q, low = {}, 1.0
    for i in range(len(order) - 1, -1, -1):
        low = min(low, ps[order[i]] * len(order) / (i + 1))
        q[order[i]] = low
    return q


@pytest.mark.parametrize("seed", [1, 2])
def test_sparse_equals_dense(spark, seed):
    rng = random.Random(seed)
    fs = {f"E{i}": {f"F{rng.randrange(6)}" for _ in range(rng.randrange(4))} for i in range(40)}
    ts = {f"E{i}": {f"T{rng.randrange(5)}" for _ in range(rng.randrange(3))} for i in range(40)}
    fs, ts = ({k: v for k, v in x.items() if v} for x in (fs, ts))
    f = frame(spark, [(e, x) for e, v in fs.items() for x in v], "feature")
    t = frame(spark, [(e, x) for e, v in ts.items() for x in v], "term")
    want = dense(fs, ts)
    q = bh({k: p for k, (_, p) in want.items()})
    n = A.number_of_tests(f, t).first()["n_tests"]
    assert n == len(want)
    rows = A.adjusted(A.tested(A.contingency(f, t)), n).collect()
    assert {(r.feature, r.term) for r in rows} == {k for k, (a, _) in want.items() if a}
    for r in rows:
        assert r.p_value == pytest.approx(want[r.feature, r.term][1], rel=1e-9)
        assert r.q_value == pytest.approx(q[r.feature, r.term], rel=1e-9)


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_bh_ranges_and_ties(spark, ranges):
    ps = [0.01, 0.01, 0.05, 0.05, 0.1, 0.9, 0.9, 1e-8, 0.3]
    rows = spark.createDataFrame([(p,) for p in ps], "p_value double")
    got = {(r.p_value, r.q_value) for r in A.adjusted(rows, len(ps), ranges=ranges).collect()}
    want = bh(dict(enumerate(ps)))
    assert len(got) == len(set(ps)) and all(q == pytest.approx(max(want[i] for i in range(len(ps)) if ps[i] == p)) for p, q in got)


@pytest.mark.parametrize("ranges", [1, 5, 40, None])
def test_adjusted_values_of_many_rows(spark, ranges):
    """A third of all rows share one value, others tie at many; 0, 1 and values that vanish are among them."""
    rng = random.Random(ranges)
    ps = [rng.choice([0.2, 1.0, 0.0, 1e-320, round(rng.random() ** 4, 3), rng.random() ** 9]) if i % 3 else 0.031 for i in range(900)]
    rows = spark.createDataFrame(list(enumerate(ps)), "i int, p_value double").repartition(5)
    got = A.adjusted(rows, 2000, ranges=ranges).collect()
    dense = bh(dict(enumerate(ps + [1.0] * 1100)))
    assert sorted(r.i for r in got) == list(range(900))
    assert all(r.q_value == pytest.approx(min(1.0, dense[r.i]), rel=1e-12) for r in got)


def test_rows_of_one_value_are_not_dealt(spark):
    """The rows of a hot value meet one row a class by broadcast; only the others are shuffled."""
    rows = spark.createDataFrame([(1.0,)] * 50 + [(0.3,), (0.2,)], "p_value double")
    plan = A.adjusted(rows, 100)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(_b") == 1 and "hashpartitioning(p_value" not in plan


def test_threshold_and_significance_are_inclusive(spark):
    rows = spark.createDataFrame([(0.001, 0.01), (0.002, 0.011)], "p_value double, q_value double")
    assert A.significant(rows, 0.01).count() == 1
    assert A.p_threshold(rows, 0.01).first()[0] == 0.001
    assert A.p_threshold(rows, 0.001).first()[0] == 0.0
    with pytest.raises(ValueError):
        A.significant(rows, 1.0)


def test_top_k_breaks_ties(spark):
    rows = spark.createDataFrame([("b", "x", 0.1), ("a", "y", 0.1), ("a", "x", 0.1), ("c", "z", 0.01)], "feature string, term string, p_value double")
    assert [(r.feature, r.term) for r in A.top_k(rows, 3).orderBy("rank").collect()] == [("c", "z"), ("a", "x"), ("a", "y")]


def test_empty(spark):
    f, t = frame(spark, [], "feature"), frame(spark, [], "term")
    rows = A.tested(A.contingency(f, t))
    assert rows.count() == 0 and A.adjusted(rows, 0).count() == 0 and A.universe(f, t).first()[0] == 0


# ------------------------------------------------------------------ shrinkage


def test_shrinkage_values(spark):
    f = frame(spark, [("P1", "IPR1"), ("P1", "IPR2"), ("P1", "IPR1,IPR2"), ("P2", "IPR1"), ("P3", "IPR2")], "feature")
    meta = features.metadata(f)
    ps = [("IPR1", "GO1", 0.2), ("IPR1", "GO2", 0.8), ("IPR2", "GO1", 0.05), ("IPR2", "GO2", 0.5), ("IPR1,IPR2", "GO1", 0.01), ("IPR1,IPR2", "GO2", 0.4)]
    rows = shrinkage.shrink(spark.createDataFrame(ps, "feature string, term string, p_value double"), meta)
    got = {(r.feature, r.term): r for r in rows.collect()}
    alpha = 0.5 * math.exp(-1 / 3)
    r = got["IPR1,IPR2", "GO1"]
    assert r.prior == pytest.approx(math.sqrt(0.2 * 0.05)) and r.alpha == pytest.approx(alpha)
    assert r.p_value == pytest.approx(math.exp((1 - alpha) * math.log(0.01) + alpha * math.log(0.1)))
    assert got["IPR1", "GO1"].p_value == 0.2 and got["IPR1", "GO1"].prior is None
    unknown = shrinkage.shrink(spark.createDataFrame(ps[:1] + [("IPR1,IPR9", "GO1", 0.3), ("IPR8,IPR9", "GO1", 0.3)], "feature string, term string, p_value double"), features.metadata(f.unionByName(frame(spark, [("P1", "IPR1,IPR9"), ("P1", "IPR8,IPR9")], "feature"))))
    priors = {r.feature: r.prior for r in unknown.collect()}
    assert priors["IPR1,IPR9"] == pytest.approx(0.2) and priors["IPR8,IPR9"] is None  # a part that does not occur is skipped
    s = shrinkage.statistics(rows).first()
    assert s.n_composite_tests == 2 and s.n_increased == 2
    none = shrinkage.statistics(rows.where("feature = 'IPR1'")).first()
    assert (none.n_composite_tests, none.pct_increased, none.median_ratio) == (0, 0.0, 1.0)
    with pytest.raises(ValueError):
        shrinkage.check(1.5, 3)
    with pytest.raises(ValueError):
        shrinkage.check(0.5, 0)


def test_extended_support_reaches_every_shrunk_pair(spark):
    """A composite never seen with a term that its parts have still moves below 1, as in the dense matrix."""
    f = frame(spark, [("E1", "A"), ("E1", "B"), ("E1", "A,B"), ("E2", "A"), ("E3", "B"), ("E4", "C")], "feature")
    t = frame(spark, [("E2", "T"), ("E3", "T"), ("E1", "U"), ("E4", "U")], "term")
    meta = features.metadata(f)
    pairs = shrinkage.extended_pairs(A.cooccurrence(f, t), meta)
    rows = shrinkage.shrink(A.tested(A.contingency(f, t, pairs=pairs)), meta)
    got = {(r.feature, r.term): r for r in rows.collect()}
    assert got["A,B", "T"].a == 0 and got["A,B", "T"].p_raw == 1.0 and got["A,B", "T"].p_value < 1
    assert ("C", "T") not in got
    assert got["A,B", "T"].hyper_score == 0
