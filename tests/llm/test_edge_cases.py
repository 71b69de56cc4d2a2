"""Every operator on nulls, empty and very long texts, ties, repeated rows, an empty table and further columns."""

import os
import time

import pytest
from pyspark.sql import functions as F

from termlift.llm import _shared, embedding_dedup, html_extract, language_id, line_dedup, ngram_join, quality_rules, sequence_packing, source_mixing, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, rep string"
LONG = " ".join(f"word{i}" + "." * (i % 10 == 9) for i in range(60_000))
SAME = "the same words in this text appear again and again without any change at all in the table"
ROWS = [
    (1, None, None, None, None, "x", None, None),
    (2, "", "en", "a", 0, None, "y", None),
    (3, " \t\n ", "en", "a", 3, None, None, None),
    (4, LONG, "en", "b", None, None, None, "z"),
    (5, SAME, "en", "b", 1, None, None, None),
    (6, SAME, "de", None, 1, None, None, None),
    (6, SAME, "de", None, 1, None, None, None),
    (None, SAME, "de", "c", 1, None, None, None),
    (7, "é 日本 \U0001f600 ß", "ja", "c", 1, None, None, None),
    (8, "12345 !!! ---", None, "c", 1, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_near_copies(docs):
    got = by_id(ngram_join.similar(docs))
    assert len(got[6]) == 2
    assert (got[1][0].n_links, got[1][0].component_id, got[1][0].kept) == (0, 1, True)
    assert got[2][0].n_links == got[3][0].n_links == 0
    assert (got[5][0].n_links, got[5][0].kept) == (2, True)
    assert [(r.n_links, r.component_id, r.kept) for r in got[6]] == [(2, 5, False)] * 2
    assert (got[None][0].n_links, got[None][0].component_id) == (0, None)
    assert ngram_join.similar(docs.limit(0)).count() == 0


def test_lines(docs):
    got = by_id(line_dedup.clean(docs, min_docs=2))
    assert got[1][0].kept_text == "" and got[1][0].n_lines == 1
    assert got[3][0].kept_text == " \t\n " and got[3][0].n_lines == 2
    assert got[4][0].kept_text == LONG
    assert got[5][0].kept_text == "" and got[5][0].n_dropped == 1
    assert [r.kept_text for r in got[6]] == [SAME] * 2
    assert got[None][0].kept_text == ""
    assert line_dedup.clean(docs).columns == docs.columns + ["kept_text", "n_lines", "n_dropped"]
    assert line_dedup.clean(docs.limit(0)).count() == 0


def test_lines_of_clashing_columns(spark):
    df = spark.createDataFrame([(i, f"a line of text that all of them hold\nown {i}", 9, "x", None, 1.5, 0) for i in range(3)], "doc_id long, text string, n_lines int, kept_text string, n_dropped int, _gone double, n_chars int")
    out = line_dedup.clean(df)
    assert out.columns == ["doc_id", "text", "_gone", "n_chars", "kept_text", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in out.collect()) == [(0, "own 0", 2, 1), (1, "own 1", 2, 1), (2, "a line of text that all of them hold\nown 2", 2, 0)]
    kept = line_dedup.cleaned(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert sorted((r.doc_id, r.text, r.n_lines, r.kept_text, r.n_chars) for r in kept.collect())[0] == (0, "own 0", 9, "x", 5)


def test_work_on_a_text_is_in_proportion_to_its_lines(spark):
    """A text of 200,000 lines (10 MB) that loses half of them; made again for every line it would take hours."""
    lines = [f"this is line number {i} of a long text of many lines" for i in range(200_000)]
    rows = [(i, "\n".join(lines[: 100_000 if i else 200_000])) for i in range(3)]
    began = time.monotonic()
    got = by_id(line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")))
    assert time.monotonic() - began < 90
    assert [(got[i][0].n_lines, got[i][0].n_dropped) for i in range(3)] == [(200_000, 100_000), (100_000, 100_000), (100_000, 0)]
    assert got[0][0].kept_text == "\n".join(lines[100_000:]) and got[1][0].kept_text == "" and got[2][0].kept_text == rows[2][1]


def test_runs_are_merged_without_dealing_or_sorting(spark, monkeypatch):
    plans = []

    class Seen(line_dedup.LineRuns):
        def _sorted(self, rows):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            name = super()._sorted(rows)
            path = self.paths[name].removeprefix("file:")
            files = [f for f in os.listdir(path) if f.endswith(".parquet")]
            assert len({f.split("_")[1] for f in files}) == len(files)  # one file a bucket, or its order does not count
            return name

    monkeypatch.setattr(line_dedup, "LineRuns", Seen)
    rows = [(i, f"a line of text that all of them hold\none of a group of four {i % 10} lines\nown line of this very text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(line_dedup.clean(df))
    assert sum(r[0].n_dropped for r in got.values()) == 39 + 30
    joins = [p for p in plans if "SortMergeJoin" in p]
    assert len(joins) >= 8 and any("LeftAnti" in p for p in joins) and any("FullOuter" in p for p in joins)
    assert all("Exchange" not in p and "Sort [" not in p for p in joins)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering", "false") == "false"


def test_mixing(docs):
    rows = source_mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.source: r.source_size for r in rows}["b"] == 60_000 + len(SAME.split())
    assert source_mixing.mix(docs.limit(0)).count() == 0
    assert source_mixing.mixed_rows(docs).columns == docs.columns


def test_packing(docs):
    rows = by_id(sequence_packing.pack_documents(docs))
    assert rows[1][0].length == 1 and len(rows[6]) == 2
    assert sorted(r.length for r in rows[4])[-2:] == [2048, 2048]
    assert sequence_packing.pack_documents(docs.limit(0)).count() == 0


def test_counts_and_rules(docs):
    got = by_id(token_counts.count_tokens(docs))
    assert got[1][0].n_tokens == got[2][0].n_tokens == got[3][0].n_tokens == 0 and got[4][0].n_words == 60_000
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    got = by_id(quality_rules.assess(docs))
    assert got[1][0].base_failed and not got[1][0].kept and got[4][0].kept
    assert got[7][0].word_chars == 6
    no_marks = quality_rules.assess(docs.where("doc_id = 4").withColumn("text", F.translate("text", ".", ""))).first()
    assert not no_marks.kept and no_marks.n_failed_lines == 1
    assert quality_rules.clean(docs).columns == docs.columns and quality_rules.assess(docs.limit(0)).count() == 0


def test_language(docs):
    model = language_id.fit(docs)
    got = by_id(language_id.predict(docs, model))
    assert all(got[i][0].lang_pred == "und" and got[i][0].rejected for i in (1, 2, 3, 8))
    assert got[4][0].lang_pred in {"en", "de", "ja"}
    none = language_id.fit(docs.limit(0))
    assert none.langs == [] and {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0
    kept = language_id.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 3, 8)").count() == 0


def test_pages(spark):
    rows = [(1, None, None, "a"), (2, "http://x/\r\n", "", None), (3, "u", "<p>Only text & <b>bold", None), (None, "u", "<p>x</p>", None), (3, "u", "<p>Only text & <b>bold", None), (4, "u", "<p>" + "long text " * 50_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id string")
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    assert got[1].text == got[2].text == "" and got[3].text == "Only text & bold" and got[4].n_chars == 499_999
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
    back = {}
    for r in warc.round_trip(pages).collect():
        back.setdefault(r.page_id, []).append(r)
    assert (back[1][0].record_type, back[2][0].record_type, back[2][0].refers_to) == ("response", "revisit", 1)
    assert back[1][0].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and back[1][0].payload_bytes == 0
    assert [r.record_type for r in back[3]] == ["response"] * 2
    assert back[None][0].record_type == "response" and back[None][0].payload_bytes == 8
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (None, [1.0, 0.0], 1), (7, [1.0, 0.0, 0.0], 1), (8, [], 1), (9, [0.9, 0.435889894354067], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rid long")
    got = {}
    for r in embedding_dedup.near_duplicates(vectors, recall=0.999999).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert got[1][0].n_links == 3 and [r.n_links for r in got[2]] == [3, 3] and got[2][0].component_id == 1
    assert got[9][0].component_id == 1
    assert all(got[i][0].n_links == 0 and got[i][0].kept for i in (3, 4, 5, 6, 7, 8))
    assert got[None][0].n_links == 0
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_tables_of_the_driver_start_no_python_workers(spark):
    """Nulls stay, no rows are an empty table, and the plan has no RDD, whose rows Python workers would pickle."""
    schema = "source string, n long, rate double, groups int"
    rows = [(None, 3, 1.5, 1), ("a", 4, 0.5, 2)]
    table = _shared.few_rows(spark, rows, schema)
    assert [tuple(r) for r in table.collect()] == rows and table.schema == spark.createDataFrame([], schema).schema
    assert "RDD" not in table._jdf.queryExecution().executedPlan().toString()
    assert _shared.few_rows(spark, [], schema).count() == 0
