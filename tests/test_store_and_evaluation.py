import pytest
from pyspark.sql import functions as F

from termlift.operators import evaluation as E
from termlift.plans.pipeline import CONFIGURATIONS, ConfigurationError, Parameters, associate
from termlift.sources import store as S

ROWS = [("F1", "GO:1", 0.01, 90.0, "direct", "GO:1"), ("F1", "GO:2", 0.01, 90.0, "propagated", "GO:1"), ("F2", "GO:1", 0.2, 5.0, "direct", "GO:1")]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(ROWS, S.TABLES["annotations"])


def test_round_trip(spark, tmp_path, rows):
    st = S.ResultStore(spark, f"file://{tmp_path}/store")
    assert st.table("annotations").count() == 0 and S.summary(st.table("annotations")).first().total == 0
    st.store(rows, {"n": 3, "ok": True, "who": "x", "list": [1, 2]})
    assert st.metadata() == {"n": 3, "ok": True, "who": "x", "list": [1, 2]}
    st.store(rows.where("feature = 'F2'"))
    assert st.table("annotations").count() == 1 and st.metadata()["n"] == 3
    st.store(rows.limit(0))
    assert {r.table_name: r.n_rows for r in st.info().collect()} == {"annotations": 1, "statistics": 0, "metadata": 4}
    st.backup(f"file://{tmp_path}/copy")
    assert S.ResultStore(spark, f"file://{tmp_path}/copy").table("annotations").count() == 1
    st.export_tsv(str(tmp_path / "none"), min_score=99.0)
    assert not (tmp_path / "none").exists()
    st.export_tsv(str(tmp_path / "some"), kind="direct")
    assert (tmp_path / "some").exists()


def test_a_bad_row_leaves_the_store_as_it_was(spark, tmp_path, rows):
    st = S.ResultStore(spark, f"file://{tmp_path}/store")
    st.store(rows)
    for bad in [("F", "XX", 0.1, 5.0, "direct", "x"), ("F", "GO:1", 1.1, 5.0, "direct", "x"), ("F", "GO:1", 0.1, 101.0, "direct", "x"), ("F", "GO:1", 0.1, 5.0, "other", "x"), ROWS[0]]:
        with pytest.raises(S.ConstraintError):
            st.store(rows.union(spark.createDataFrame([bad], S.TABLES["annotations"])))
    stats = spark.createDataFrame([("F", "GO:1", -1, 0, 0, 0, None, 0.1, 1.0)], S.TABLES["statistics"])
    with pytest.raises(S.ConstraintError):
        st.store(rows, statistics=stats)
    assert st.table("annotations").count() == 3


def data_of(folder, table="annotations"):
    return sorted(p.name for p in (folder / "data").iterdir() if p.name.startswith(f"{table}-"))


def test_versions_are_whole_and_the_last_two_stay(spark, tmp_path, rows):
    folder = tmp_path / "store"
    st = S.ResultStore(spark, f"file://{folder}")
    assert st.store(rows, {"n": 1}) == 1
    before = st.table("annotations")
    assert st.store(rows.where("feature = 'F2'")) == 2
    assert before.count() == 3 and st.table("annotations").count() == 1 and st.versions() == [1, 2]
    old = st.at(1)
    assert old.table("annotations").count() == 3 and st.at(2).metadata() == old.metadata() == {"n": 1}
    with pytest.raises(ValueError, match="snapshot"):
        old.store(rows)
    assert st.store(rows.where("feature = 'F1'"), {"n": 3}) == 3
    assert st.versions() == [2, 3] and len(data_of(folder)) == 2 and len(data_of(folder, "metadata")) == 2
    with pytest.raises(FileNotFoundError):
        st.at(1).table("annotations")
    assert st.manifest()["parent"] == 2 and {r.table_name: r.key for r in st.files().collect()} == {"annotations": "feature", "annotations_by_term": "term", "metadata": None}


def test_a_writer_that_dies_between_tables_changes_nothing(spark, tmp_path, rows, monkeypatch):
    folder = tmp_path / "store"
    st = S.ResultStore(spark, f"file://{folder}")
    st.store(rows, {"n": 1})
    stats = spark.createDataFrame([(f, "GO:1", 1, 0, 0, 2, None, 0.1, 10.0) for f in ("F1", "F2")], S.TABLES["statistics"])
    for step in ("statistics", "metadata"):
        with monkeypatch.context() as m:
            whole = S.ResultStore._write

            def dies(self, table, df, step=step, whole=whole):
                if table == step:
                    raise RuntimeError("killed")
                return whole(self, table, df)

            m.setattr(S.ResultStore, "_write", dies)
            with pytest.raises(RuntimeError):
                st.store(rows.where("feature = 'F2'"), {"n": 2}, stats)
        assert st.versions() == [1] and st.table("annotations").count() == 3 and st.metadata() == {"n": 1}
    assert len(data_of(folder)) == 3  # one that counts, two of the dead
    assert st.vacuum(3600) == [] and len(st.vacuum(-1)) >= 4 and len(data_of(folder)) == 1
    assert st.store(rows.where("feature = 'F2'"), {"n": 2}, stats.where("feature = 'F2'")) == 2 and st.table("statistics").count() == 1


def test_of_two_writers_one_wins(spark, tmp_path, rows, monkeypatch):
    folder = tmp_path / "store"
    first, second = (S.ResultStore(spark, f"file://{folder}") for _ in range(2))
    first.store(rows)
    publish = S.ResultStore._publish

    def late(self, base, tables):
        monkeypatch.setattr(S.ResultStore, "_publish", publish)
        second.store(rows.where("feature = 'F2'"), {"by": "second"})
        return publish(self, base, tables)

    monkeypatch.setattr(S.ResultStore, "_publish", late)
    with pytest.raises(S.ConflictError):
        first.store(rows.where("feature = 'F1'"), {"by": "first"})
    assert first.versions() == [1, 2] and first.metadata() == {"by": "second"} and first.table("annotations").count() == 1
    assert len(data_of(folder)) == 2 and not [p for p in (folder / "versions").iterdir() if not p.name.lstrip(".").startswith("v")]


def test_a_store_of_another_schema_is_not_opened(spark, tmp_path, rows):
    folder = tmp_path / "store"
    st = S.ResultStore(spark, f"file://{folder}")
    st.store(rows)
    path = folder / "versions" / "v000000000001.json"
    path.write_text(path.read_text().replace("q_value double", "q_value float"))
    (folder / "versions" / ".v000000000001.json.crc").unlink(missing_ok=True)
    with pytest.raises(S.SchemaError, match="annotations"):
        S.ResultStore(spark, f"file://{folder}")


def scanned(df):
    """Rows that a query's scans of files hand on, after it ran."""
    df.collect()
    scans, todo = {}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            scans[node.id()] = node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(scans.values())


def test_a_lookup_by_either_key_reads_a_small_part(spark, tmp_path, monkeypatch):
    """At most a tenth of the rows for one term or one feature; for both too; all of them without a key."""
    monkeypatch.setattr(S, "ROW_GROUP", 1 << 14)
    made = spark.range(60_000).selectExpr("concat('F', id % 3000) AS feature", "concat('GO:', id % 2000 + 2000 * (id div 6000)) AS term", "0.01D AS q_value", "50D AS association_score", "'direct' AS annotation_type", "'x' AS direct_source_term")
    st = S.ResultStore(spark, f"file://{tmp_path}/store")
    st.store(made)
    for options in ({"term": "GO:77"}, {"feature": "F1234"}, {"feature": "F77", "term": "GO:77"}):
        want = made
        for c, v in options.items():
            want = want.where(F.col(c) == v)
        got = st.query(**options)
        assert 0 < scanned(got) <= 6000 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), options
    assert scanned(st.table("annotations")) == 60_000


def test_direct_annotations_need_their_statistics(spark, tmp_path, rows):
    st = S.ResultStore(spark, f"file://{tmp_path}/store")
    stats = spark.createDataFrame([("F1", "GO:1", 1, 0, 0, 2, None, 0.1, 10.0)], S.TABLES["statistics"])
    assert [(r.feature, r.term) for r in S.orphans(rows, stats).collect()] == [("F2", "GO:1")]
    with pytest.raises(S.ConstraintError):
        st.store(rows, statistics=stats)
    st.store(rows.where("feature = 'F1'"), statistics=stats)
    assert st.table("statistics").count() == 1


def test_parameters_of_the_environment(monkeypatch):
    for name, value in {"ALPHA": "0.05", "SHRINKAGE_MIN_OBS": "2.5", "MAX_RUN": "2", "WITH_ONTOLOGY": "yes", "ORIENTATION": "to_leaf"}.items():
        monkeypatch.setenv(f"TERMLIFT_{name}", value)
    p = Parameters.from_environment()
    assert (p.alpha, p.shrinkage_min_obs, p.max_run, p.with_ontology, p.orientation) == (0.05, 2.5, 2, True, "to_leaf")


def test_queries(rows):
    assert [(r.feature, r.term) for r in S.query(rows).collect()] == [("F1", "GO:1"), ("F1", "GO:2"), ("F2", "GO:1")]
    assert S.query(rows, term="GO:1", limit=1).count() == 1 and S.query(rows, limit=0).count() == 3
    assert S.export(rows, features=["F2"]).count() == 1 and S.export(rows, max_q=0.1, kind="direct").count() == 1
    assert [r.n for r in S.top_by(rows, "term").collect()] == [2, 1]


def test_precision_recall(spark):
    p = spark.createDataFrame([("A", "1"), ("A", "1"), ("B", "2")], "feature string, term string")
    g = spark.createDataFrame([("A", "1"), ("C", "3"), ("D", "4")], "feature string, term string")
    r = E.precision_recall(p, g).first()
    assert (r.n_predicted, r.true_positives, r.n_gold) == (2, 1, 3) and r.precision == 0.5 and r.recall == pytest.approx(1 / 3) and r.f1 == pytest.approx(0.4)
    none = E.precision_recall(p.limit(0), g.limit(0)).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
    assert {x.part: x.n for x in E.overlap(p, g).collect()} == {"common": 1, "novel": 1, "missed": 2}


def test_sweep(spark):
    p = spark.createDataFrame([("A", "1", 1e-9, 1e-7, 85.0), ("B", "2", 1e-3, 0.1, 25.0)], "feature string, term string, p_value double, q_value double, hyper_score double")
    g = spark.createDataFrame([("A", "1")], "feature string, term string")
    rows = E.threshold_sweep(p, g).orderBy("ordinal").collect()
    assert len(rows) == 20 and [r.n_predicted for r in rows[:6]] == [2, 2, 1, 1, 1, 0]
    best = E.best_threshold(E.threshold_sweep(p, g)).first()
    assert best.ordinal == 2 and best.f1 == 1.0
    assert [r.feature for r in E.novel(p, g).collect()] == ["B"]


def test_architecture(spark):
    a = spark.createDataFrame([("e", ["A"], []), ("f", ["A", "A"], []), ("g", ["A", "B"], [])], "entity string, singles array<string>, composites array<string>")
    got = {r.feature: (r.n_total, r.n_single, r.n_multi) for r in E.architecture_statistics(a).collect()}
    assert got == {"A": (3, 1, 2), "B": (1, 0, 1)}


def test_parameters(monkeypatch):
    assert len(CONFIGURATIONS) == 8
    for bad in ({"alpha": 0}, {"alpha": 1.0}, {"shrinkage_strength": 2}, {"shrinkage_min_obs": 0}, {"orientation": "up"}, {"min_cooccurrence": 0}):
        with pytest.raises(ConfigurationError):
            Parameters(**bad)
    monkeypatch.setenv("TERMLIFT_ALPHA", "0.05")
    assert Parameters.from_environment().alpha == 0.05
    monkeypatch.setenv("TERMLIFT_ALPHA", "5")
    with pytest.raises(ConfigurationError):
        Parameters.from_environment()


@pytest.mark.parametrize("options", [{}, {"with_shrinkage": True, "with_ontology": True}, {"with_composites": False, "with_ontology": True, "orientation": "to_leaf"}, {"propagate_entity_terms": True}])
def test_whole(spark, options):
    arch = [(f"e{i}", ["A", "B"] if i % 2 else ["C"], ["A,B"] if i % 2 else []) for i in range(40)]
    terms = [(f"e{i}", "t1" if i % 2 else "t2") for i in range(40)] + [("only", "t2")]
    a = spark.createDataFrame(arch, "entity string, singles array<string>, composites array<string>")
    t = spark.createDataFrame(terms, "entity string, term string")
    e = spark.createDataFrame([("t1", "R", "is_a"), ("t2", "R", "is_a")], "child string, parent string, relation string")
    got = associate(a, t, Parameters(min_background=1, **options), e)
    pairs = {(r.feature, r.term) for r in got.significant.collect()}
    assert ("A", "t1") in pairs and ("C", "t2") in pairs and ("A", "t2") not in pairs
    if options.get("with_ontology"):
        assert got.annotations.count() >= len(pairs)


def test_describe_and_quality(spark):
    rows = spark.createDataFrame([("f", "t", 0.1, "direct"), ("f", "u", None, "direct"), (None, "u", 0.3, "propagated")], "feature string, term string, q_value double, annotation_type string")
    got = {r["name"]: tuple(r)[1:] for r in E.describe(rows, ["q_value"]).collect()}
    assert got == {"feature": (2, 1, None, None, None), "term": (3, 2, None, None, None), "q_value": (2, None, 0.1, 0.3, 0.2)}
    assert sorted(map(tuple, E.quality(rows, 0.5).collect())) == [("direct", 2, 1, False), ("propagated", 1, 0, True)]
    none = rows.where("false")
    assert [r["n"] for r in E.describe(none, ["q_value"]).collect()] == [0, 0, 0] and E.quality(none, 0.5).isEmpty()
