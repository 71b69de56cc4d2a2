import re

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
CHECKED = ["cooccurrence", "bh_adjust", "contingency_composites", "shrink_pvalues", "propagate", "threshold_sweep", "disposition_counts", "max_entities", "scan_annotations", "scan_counters", "scan_occurrences", "scan_ontology", "scan_gold", "extract_lines", "stored_annotations", "statistics_orphans", "bh_tested_pairs", "optimal_level_small_kept", "describe_associations", "annotation_quality", "step_down", "support_levels", "ontology_cycles", "store_snapshots", "stream_contingency"]


def test_every_query_of_the_catalog_has_sql():
    from termlift.plans import catalog, catalog_files

    for part in (catalog, catalog_files):
        assert set(part.queries()) == set(part.oracle_sql())
        assert set(part.queries()) <= set(entry.queries())


def test_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["feature", "term"] and df.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    sql = sorted((tuple(clean(v) for v in r) for r in want.select(*columns).fetchall()), key=str)
    ours = sorted((tuple(clean(v) for v in r) for r in entry.queries()[name](spark, DIR).select(*columns).collect()), key=str)
    assert ours == sql


@pytest.mark.parametrize("name", ["scan_annotations", "scan_preset", "scan_counters", "disposition_counts"])
def test_no_task_holds_all_orders_or_parts(spark, monkeypatch, name):
    """With more lines than a partition of the join takes, neither table is broadcast, and the results stay."""
    from termlift.plans import catalog

    monkeypatch.setattr(catalog, "JOIN_ROWS", 1000)
    plan = catalog.annotations(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
    test_against_sql(spark, name)


@pytest.mark.parametrize("name", ["scan_annotations", "scan_preset"])
def test_scanned_lines_are_counted_in_bounded_partitions(spark, monkeypatch, name):
    """Of the lines of a file that many tasks read, none counts more than its share: neither four tasks that they are dealt to nor
    spark.sql.shuffle.partitions (4 here) decide how many pairs of a term and an entity are held at once. The results stay."""
    from termlift.plans import catalog

    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    monkeypatch.setattr(catalog, "JOIN_ROWS", 500)
    plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    dealt = [keys for keys in re.findall(r"Exchange \w+\((.*?)\)", plan) if "entity" in keys or keys.isdigit()]
    assert len(dealt) == 1 and re.fullmatch(rf"entity#\d+, {-(-lines // 500)}", dealt[0])
    test_against_sql(spark, name)


def test_lines_are_dealt_only_where_few_tasks_read_them(spark):
    from termlift.sources import text_formats

    tasks = lambda held, asked: text_formats._at_least(spark.range(0, 100, 1, held), asked).rdd.getNumPartitions()
    assert [tasks(1, 4), tasks(8, 4), tasks(1, None), tasks(8, None)] == [4, 8, 1, 8]


def test_entities_are_dealt_in_bounded_partitions(spark, monkeypatch, tmp_path):
    """Where there are more lines than a partition takes, partitions are more; nulls and repeated lines count as in the plain form."""
    from termlift.operators import associations
    from termlift.plans import catalog

    monkeypatch.setattr(catalog, "JOIN_ROWS", 5)
    assert catalog._dealt(spark.range(100), "id", 100).rdd.getNumPartitions() == 20
    lines = [(1, 1), (1, 2), (1, 2), (2, 3), (2, 4), (3, 4), (None, 1), (None, 3), (4, 5), (None, 1), (5, 9), (6, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, "b", None), (5, None, None)], "p_partkey long, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog._profiles(spark, str(tmp_path)).select("features", "terms", "nameless", "n").collect()
    rows = spark.read.parquet(f"{tmp_path}/lineitem.parquet").join(spark.read.parquet(f"{tmp_path}/part.parquet").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    want = associations.profiles(rows.selectExpr("l_orderkey as entity", "p_brand as feature"), rows.selectExpr("l_orderkey as entity", "p_name as term"))
    seen = lambda found: sorted((r.features or [], r.terms or [], r.nameless, r.n) for r in found if not r.nameless)
    assert seen(got) == seen(want.collect()) and len(seen(got)) == 5
    assert [(r.features, r.terms, r.n) for r in got if r.nameless] == [(["a"], ["x"], 1)]
