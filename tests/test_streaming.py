import hashlib
import random
import shutil

from pyspark.sql import functions as F

from termlift.operators import associations
from termlift.sources import store, text_formats
from termlift.streaming import counts
from termlift.streaming.pairs import PairCounts


def test_counts_follow_the_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "entity string, term string"
    for rows in ([("a", "t1"), ("b", "t1")], [("c", "t2"), ("d", "t1")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        counts.keep_counts(stream, "term", out, str(tmp_path / "check")).awaitTermination()
    assert {r.term: r.n for r in counts.current(spark, out, "term").collect()} == {"t1": 3, "t2": 1}


ROWS = "entity string, kind string, value string"


def batch_tables(spark, rows):
    """The tables of all rows, by the batch operators."""
    df = spark.createDataFrame(sorted({r for r in rows if None not in r and r[1] in ("feature", "term")}), ROWS)
    f = df.where("kind = 'feature'").select("entity", df["value"].alias("feature"))
    t = df.where("kind = 'term'").select("entity", df["value"].alias("term"))
    return sorted(map(tuple, associations.contingency(f, t).collect()))


def test_pair_counts_equal_the_batch_at_every_moment(spark, tmp_path):
    """Old entities get new rows, rows come again, in a batch and later; nulls and other kinds do not count; some batches are empty."""
    rng = random.Random(1)
    held, seen = PairCounts(spark, str(tmp_path / "pairs"), buckets=3), []
    batches = [[(f"e{rng.randrange(12)}", rng.choice(["feature", "term"]), f"v{rng.randrange(5)}") for _ in range(25)] for _ in range(3)]
    batches[1] += [(None, "term", "v1"), ("e1", "feature", None), ("e1", "other", "v1")]
    for i, rows in enumerate([*batches[:2], [], batches[2]]):
        held.apply(spark.createDataFrame(rows, ROWS), i)
        seen += rows
        assert sorted(map(tuple, held.contingency().collect())) == batch_tables(spark, seen)


def test_a_batch_that_failed_half_way_is_counted_once(spark, tmp_path):
    held = PairCounts(spark, str(tmp_path / "pairs"))
    first, second = [("a", "feature", "F"), ("a", "term", "T"), ("b", "term", "T")], [("b", "feature", "F"), ("c", "term", "U")]
    held.apply(spark.createDataFrame(first, ROWS), 0)
    before = sorted(map(tuple, held.contingency().collect()))
    held.apply(spark.createDataFrame(second, ROWS), 1)
    after = sorted(map(tuple, held.contingency().collect()))
    shutil.rmtree(tmp_path / "pairs" / "entities" / "batch=1")  # as if the writer had died before its last table
    assert sorted(map(tuple, held.contingency().collect())) == before
    held.apply(spark.createDataFrame(second, ROWS), 1)
    assert sorted(map(tuple, held.contingency().collect())) == after == batch_tables(spark, first + second)


def test_pair_counts_follow_a_stream(spark, tmp_path):
    rows = [("a", "feature", "F"), ("b", "feature", "F"), ("a", "term", "T"), ("b", "term", "T"), ("c", "term", "T")]
    for i in (0, 2, 4):
        spark.createDataFrame(rows[i : i + 2], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held = PairCounts(spark, str(tmp_path / "pairs"))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    held.follow(stream, str(tmp_path / "check")).awaitTermination()
    assert [tuple(r) for r in held.contingency().collect()] == [("F", "T", 2, 0, 1, 0, 2, 3, 3)]
    assert held._table("entities").select("batch").distinct().count() == 3


def test_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "x")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in counts.windowed_counts(rows, "t", "k").collect()) == [1, 2]


def test_scan_hits_and_md5(spark, tmp_path):
    path = tmp_path / "scan.tsv"
    path.write_text("P1\tmd5\t300\tPfam\tPF1\tname\t10\t90\t1e-5\nP1\tmd5\t300\tSMART\tSM1\tname\t10\t90\t1e-5\nP2\tm\t1\tPfam\tPF2\tn\tx\t9\n")
    assert [(r.entity, r.feature, r.start, r.end) for r in text_formats.read_scan_hits(spark, str(path)).collect()] == [("P1", "PF1", 10, 90)]
    assert text_formats.md5(spark, str(path)) == hashlib.md5(path.read_bytes()).hexdigest()


def test_tsv_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("A,B", "t", 1.5e-7, 0.01, 2.0, 50.123, "supra_pair", ["A", "B"], 3)], "feature string, term string, p_value double, q_value double, odds_ratio double, hyper_score double, feature_type string, constituents array<string>, n_observations long")
    store.write_tsv(store.significant_lines(rows), str(tmp_path / "out"))
    back = text_formats.read_predictions(spark, str(tmp_path / "out")).first()
    assert (back.p_value, back.hyper_score, back.constituents) == (1.5e-7, 50.12, "A,B")
    store.write_tsv(rows.limit(0), str(tmp_path / "none"), only_if_any=True)
    assert not (tmp_path / "none").exists()
