"""The queries with runs of up to three features, against the catalog's statements and plain code."""

import collections
import math

import duckdb
import pytest

import __spark_entry__ as entry
from termlift.plans import catalog_sql

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["shrink_pvalues", "shrink_stats"])
def test_shrinkage_of_runs_of_three(spark, con, name):
    want = con.sql(catalog_sql.SQL[name])
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, DIR).select(*columns).collect()
    assert plain(got) == plain(want.select(*columns).fetchall())
    if name == "shrink_pvalues":
        assert any(r.feature.count(",") == 2 for r in got)


def tail(a, k, m, n):
    return sum(math.comb(k, x) * math.comb(n - k, m - x) for x in range(a, min(k, m) + 1)) / math.comb(n, m)


def test_full_pipeline(spark, con):
    rows = entry.queries()["full_pipeline"](spark, DIR).collect()
    assert len(rows) == len({(r.feature, r.term) for r in rows})
    want = con.sql(catalog_sql.SQL["full_pipeline"])
    columns = want.columns
    hits = [r for r in rows if r.a is not None]
    assert plain([tuple(r[c] for c in columns) for r in rows]) == plain(want.fetchall()) and any(r.feature.count(",") == 2 for r in hits)

    brands, terms, feats = {}, collections.defaultdict(set), collections.defaultdict(set)
    for e, _, _, b, t in con.sql("SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_name FROM lineitem JOIN part ON l_partkey = p_partkey ORDER BY 1, 2, 3").fetchall():
        brands.setdefault(e, []).append(b)
        terms[t].add(e), [terms[w].add(e) for w in t.split(" ")], terms["ROOT"].add(e)
    for e, s in brands.items():
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                feats[",".join(s[i : i + n])].add(e)

    def stays(f, t):
        for up in set(t.split(" ")):
            inside = terms[up]
            af, ac, both = feats[f] & inside, terms[t] & inside, feats[f] & terms[t] & inside
            if len(inside) < 3 or not both or not tail(len(both), len(af), len(ac), len(inside)) < 0.05:
                return False
        return True

    notes = {}
    for r in hits:
        if r.a > 0 and stays(r.feature, r.term):
            for t in {r.term, *r.term.split(" "), "ROOT"}:
                notes[r.feature, t] = min(notes.get((r.feature, t), r.term), r.term)
    got = {(r.feature, r.term): (r.direct_source_term, r.annotation_type) for r in rows if r.annotation_type}
    assert got and got == {k: (s, "direct" if s == k[1] else "propagated") for k, s in notes.items()}


def test_entities_with_the_same_sets_are_one_row_that_counts_for_all(spark):
    """Counts of 40 entities of four kinds come from four rows; an entity without an id counts in marginals only."""
    from termlift.operators import associations, ontology

    kinds = [("A", "t", "R"), ("A", "R", "R"), ("B", "t", "s"), ("B", "s", "s")]
    own = [(f"e{i}", t) for i in range(40) for t in set(kinds[i % 4][1:])] + [(None, "t")]
    has = [(f"e{i}", kinds[i % 4][0]) for i in range(40)] + [(None, "A")]
    f, t = spark.createDataFrame(has, "entity string, feature string"), spark.createDataFrame(own, "entity string, term string")
    profiles = associations.profiles(f, t)
    assert sorted((r.n, r.nameless) for r in profiles.collect()) == [(1, True), (1, True), (10, False), (10, False), (10, False), (10, False)]
    assert sorted(map(tuple, associations.cells(*associations.counts(profiles)).collect())) == sorted(map(tuple, associations.contingency(f, t).collect()))
    wanted = spark.createDataFrame([("A", "t", "R"), ("B", "t", "s"), ("A", "R", "t"), ("B", "t", "none")], "feature string, term string, next string")
    weights = spark.createDataFrame([(f"e{i}", 10) for i in range(4)], "entity string, n long")
    few = lambda df: df.where("entity in ('e0', 'e1', 'e2', 'e3')")
    got = ontology.conditional_counts(wanted, few(f), few(t), weights)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ontology.conditional_counts(wanted, f, t).collect()))


def test_runs_are_counted_without_dealing_their_entities(spark):
    from termlift.plans import catalog

    rows = catalog.supra_generation(spark, "/root/testdata/sf0.001")
    assert "distinct" not in rows._jdf.queryExecution().analyzed().toString()


def test_counts_are_made_before_they_are_dealt(spark, monkeypatch):
    """Entities that all differ: their pairs and triples are counted where they are made, not dealt for a join with what is asked."""
    from termlift.functions import lineage
    from termlift.operators import ontology

    feats = {f"e{i}": {f"F{j}" for j in range(6) if i >> j & 1} for i in range(1, 64)}
    own = {e: {"R", *(f"t{j}" for j in range(4) if (i * 7 + 3) >> j & 1)} for i, e in enumerate(feats)}
    wanted = [("F0", "t0", "t1"), ("F1", "t1", "R"), ("F2", "t2", "t0"), ("F9", "t0", "R")]
    f, t = (spark.createDataFrame([(e, v) for e in d for v in d[e]], f"entity string, {name} string") for d, name in ((feats, "feature"), (own, "term")))
    rows = spark.createDataFrame([(e, 1, sorted(v)) for e, v in feats.items()], "entity string, n long, has array<string>")
    asked = spark.createDataFrame(wanted, "feature string, term string, next string")
    plans = []
    monkeypatch.setattr(ontology, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or lineage.cut(df))
    from pyspark.sql import functions as F

    both = [ontology.conditional_counts(asked, f, t), ontology.conditional_counts(asked, None, t, rows, F.col("has"))]
    plans += [df._jdf.queryExecution().optimizedPlan().toString() for df in both]
    assert not any("LeftSemi" in p for p in plans)

    def count(*kinds):
        return sum(all(x in feats[e] or x in own[e] for x in kinds) for e in feats)

    want = sorted((a, b, c, count(c), count(b, c), count(a, c), count(a, b, c)) for a, b, c in wanted)
    for got in both:
        assert sorted((r.feature, r.term, r.next, r.background, r.ac, r.af, r.afc) for r in got.collect()) == want


def test_lines_are_dealt_once_and_composites_not_at_all(spark, monkeypatch):
    from termlift.plans import catalog, pipeline

    class Enough(Exception):
        pass

    def first(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert sum("l_orderkey" in line and "Relation" in line for line in plan.splitlines()) == 1 and "composites" not in df.columns
        raise Enough

    monkeypatch.setattr(pipeline, "cut", first)
    with pytest.raises(Enough):
        catalog.full_pipeline(spark, DIR)


def test_a_cut_leaves_no_shuffle_files(spark):
    import time

    from termlift.functions.lineage import cut

    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {line for line in found.splitlines() if "shuffle_" in line}

    before, setting = files(), spark.conf.get(freed, None)
    df = spark.range(5000).selectExpr("id % 100 AS k").groupBy("k").count()
    first, again = cut(df), cut(df)
    end = time.time() + 20
    while files() - before and time.time() < end:  # they are removed in the background
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(freed, None) == setting
    assert first.agg({"count": "sum"}).first()[0] == again.agg({"count": "sum"}).first()[0] == 5000


@pytest.mark.parametrize("options", [{"with_shrinkage": True, "with_ontology": True}, {"with_composites": False, "with_ontology": True}, {"with_ontology": True, "min_support": 2}, {"step_down": True, "with_ontology": True}, {"with_shrinkage": True, "propagate_entity_terms": True, "max_run": 2}], ids=str)
def test_architectures_with_terms_are_those_of_two_tables(spark, tmp_path, options):
    """Lines without an order, a part or a place, parts without a brand or a name, two lines at one place, entities with one part only."""
    import random

    from termlift.operators import features
    from termlift.plans import catalog, pipeline

    rng = random.Random(7)
    parts = [(i, rng.choice(["A", "B", "C", "D", None]), rng.choice(["red nut", "red cap", "hot nut", "hot cap", "wet cap", None])) for i in range(40)]
    lines = [(rng.choice([*range(150), None]), rng.choice([1, 2, 3, None]), rng.choice([*range(42), None])) for _ in range(600)] + [(None, 1, 3), (None, 1, 4)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    params = pipeline.Parameters(**{"alpha": 0.6, "level_alpha": 0.9, "min_background": 1, **options})
    d = str(tmp_path)
    arch = features.architectures(catalog.occurrences(spark, d), ["position", "part"], params.max_run)
    edges = catalog.edges(spark, d).where("child is not null")
    want = pipeline.associate(arch, catalog.entity_terms(spark, d), params, edges)
    got = pipeline.associate(catalog._architectures(spark, d), None, params, edges)
    rows = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    assert rows(got.tested) == rows(want.tested) and rows(got.significant)
    if params.with_ontology:
        assert rows(got.annotations) == rows(want.annotations)
