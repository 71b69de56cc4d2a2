from fractions import Fraction
from math import comb, inf, isnan, lgamma, log10
import random

import pytest
from pyspark.sql import functions as F

from termlift.functions import tests2x2 as t


def exact(a, k, m, n, keep):
    lo, hi = max(0, k + m - n), min(k, m)
    p = {x: Fraction(comb(k, x) * comb(n - k, m - x), comb(n, m)) for x in range(lo, hi + 1)}
    return float(sum(v for x, v in p.items() if keep(x, v, p[a])))


def frame(spark, rows):
    """(a, k, m, n) rows."""
    return spark.createDataFrame(rows, "a long, k long, m long, n long")


def test_tails_agree_with_exact_fractions(spark):
    rng = random.Random(3)
    cells = [[rng.randrange(rng.choice((2, 6, 41))) for _ in range(4)] for _ in range(500)]
    tables = sorted({(a, a + b, a + c, a + b + c + d) for a, b, c, d in cells if a + b + c + d})
    tables += [(30, 200, 150, 400), (75, 200, 150, 400), (120, 200, 150, 400), (9, 900, 10, 1000), (1, 1, 1, 5000)]
    got = frame(spark, tables)
    for alternative in t.ALTERNATIVES:
        got = t.p_values(got, alternative, alternative[:3])
    got = {(r.a, r.k, r.m, r.n): r for r in got.collect()}
    for one in tables:
        assert got[one].gre == pytest.approx(exact(*one, lambda x, v, p: x >= one[0]), rel=1e-9)
        assert got[one].les == pytest.approx(exact(*one, lambda x, v, p: x <= one[0]), rel=1e-9)
        assert got[one].two == pytest.approx(exact(*one, lambda x, v, p: v <= p), rel=1e-9)


def test_very_small_and_large(spark):
    rows = [(2000, 2000, 2000, 100_000), (0, 10, 20, 1000), (40, 200_000_000, 20, 1_000_000_000), (5, 20_000, 20_000, 100_000_000)]
    got = {r.a: r for r in t.p_values(frame(spark, rows)).withColumn("point", t.log_point(*(F.col(c) for c in "akmn"))).collect()}
    assert got[2000].p_value >= 0 and -got[2000].point > 5000
    assert got[0].p_value == 1.0 and got[40].p_value == 0.0
    n, k = 100_000_000, 20_000  # Poisson with mean 4
    assert got[5].p_value == pytest.approx(1 - sum(4.0**x / 2.718281828459045**4 / [1, 1, 2, 6, 24][x] for x in range(5)), rel=1e-3)


def test_long_tails_are_summed_to_the_end(spark):
    """Means from 0.1 to 50,000, a little beyond the mean, against sums over the whole tail."""
    rows = [(int(k * m / n) + 1, k, m, n) for k, m, n in ((10, 10, 1000), (500, 400, 1000), (3000, 3000, 90_000), (100_000, 100_000, 200_000), (4000, 4000, 16_000_000))]
    for r in t.p_values(frame(spark, rows)).collect():
        lf = lambda x: lgamma(x + 1)
        c = lambda n, k: lf(n) - lf(k) - lf(n - k)
        point, total, x, term = c(r.k, r.a) + c(r.n - r.k, r.m - r.a) - c(r.n, r.m), 1.0, r.a, 1.0
        while x < min(r.k, r.m):
            term *= (r.k - x) * (r.m - x) / ((x + 1) * (r.n - r.k - r.m + x + 1))
            total, x = total + term, x + 1
        assert r.p_value == pytest.approx(2.718281828459045**point * total, rel=1e-8)


def test_two_sided_tails_of_large_margins_and_ties(spark):
    wide = t.p_values(frame(spark, [(300_000, 1_000_000, 1_000_000, 3_000_000)]), "two-sided").first().p_value
    assert 0 <= wide < 1e-100
    # symmetric: both modes are equally likely, and each point has a mirror image
    rows = t.p_values(frame(spark, [(a, 5, 5, 10) for a in (2, 3, 4, 1, 0, 5)]), "two-sided").collect()
    assert {r.a: round(r.p_value, 12) for r in rows} == {a: round(v, 12) for a, v in ((2, 1.0), (3, 1.0), (4, 52 / 252), (1, 52 / 252), (0, 2 / 252), (5, 2 / 252))}


def test_log_factorial(spark):
    xs = [0, 1, 2, 9, 31, 32, 33, 170, 10**6]
    for r in spark.createDataFrame([(x,) for x in xs], "x long").withColumn("y", t.ln_factorial(F.col("x"))).collect():
        assert r.y == pytest.approx(lgamma(r.x + 1), rel=1e-14, abs=1e-13)


def test_every_table_is_tested_once(spark):
    rows = spark.createDataFrame([(i, 3, 10, 10 + i % 2, 40) for i in range(400)] + [(400, None, 1, 1, 1)], "i long, x int, y long, z long, w long")
    got = t.test_tables(rows, out="p", names=("x", "y", "z", "w"))
    assert got.columns == rows.columns + ["p"]
    found = {(r.z, r.p) for r in got.where("x is not null").collect()}
    assert len(found) == 2 and got.where("x is not null").count() == 400
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.rindex("lambda") or "Aggregate" in plan  # the distinct below the sums


def test_columns(spark):
    rows = [(10, 2, 2, 10), (5, 5, 5, 5), (2, 10, 10, 2), (10, 0, 0, 10), (0, 10, 10, 0), (0, 0, 0, 5)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long").selectExpr("*", "a + b AS k", "a + c AS m", "a + b + c + d AS n")
    for alt in t.ALTERNATIVES:
        df = t.p_values(df, alt, alt.replace("-", "_"))
    got = df.withColumn("odds", t.odds_ratio(*(F.col(c) for c in "abcd"))).withColumn("score", t.bounded_score(F.col("greater"), F.col("a"))).collect()
    assert got[0].odds > 1 and got[0].greater < got[0].two_sided < 1 and got[0].less > got[0].greater
    assert got[1].odds == 1 and got[1].greater > 0.5
    assert got[2].odds < 1
    assert got[3].odds == inf
    assert got[4].odds == 0 and got[4].greater == 1 and got[4].score == 0
    assert isnan(got[5].odds)
    with pytest.raises(ValueError):
        t.p_values(df, "sideways")


def test_score_is_bounded(spark):
    df = spark.createDataFrame([(0.5, 3), (1e-300, 3), (0.0, 3), (1.0, 0), (1e-5, 1)], "p double, a long")
    assert [round(r.s, 6) for r in df.select(t.bounded_score(F.col("p"), F.col("a")).alias("s")).collect()] == [round(-10 * log10(0.5), 6), 100, 100, 0, 50]
