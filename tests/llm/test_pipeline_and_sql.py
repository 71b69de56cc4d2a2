import collections
import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from termlift.llm import language_id, ngram_join, queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    df = queries.queries()[name](spark, DIR)
    assert sorted(df.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)


def test_all_eleven_are_registered():
    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near copies", "mix", "pack"]


def lines_brute(rows):
    held = collections.defaultdict(set)
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 3}
    return {i: "\n".join(x for x in (text or "").split("\n") if gone.get(key(x), i) == i) for i, text in rows}


def test_stages(spark):
    """Every stage against plain code on what the one before it kept."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    first = corpus_pipeline.identify_language(spark, docs, DIR)
    model = language_id.fit(docs)
    rejected = {r.doc_id for r in language_id.predict(docs, model).where("rejected").collect()}
    rows = first.select("doc_id", "text").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()} - rejected and first.columns == columns
    second = corpus_pipeline.drop_repeated_lines(spark, first, DIR)
    got = {r.doc_id: r.text for r in second.collect()}
    assert got == lines_brute([(r.doc_id, r.text) for r in rows]) and second.columns == columns
    third = corpus_pipeline.drop_near_copies(spark, second, DIR)
    kept = {r.doc_id for r in third.collect()}
    want = {r.doc_id for r in ngram_join.similar(second).where("kept").collect()}
    assert kept == want and third.columns == columns
    fourth = corpus_pipeline.mix_sources(spark, third, DIR)
    times = collections.Counter(r.doc_id for r in fourth.collect())
    assert set(times) <= kept and max(times.values()) <= 3 and fourth.columns == columns
    last = corpus_pipeline.pack_sequences(spark, fourth, DIR)
    pieces = collections.Counter(r.doc_id for r in last.where("piece = 0").collect())
    assert pieces == times


CLASHING = "doc_id long, text string, lang string, source string, n_chars int, n_lines int, n_dropped string, kept_text string, _gone long, _row int, _k int, _id long, _text string, rid long, id string, size int, kept boolean, component_id long, piece int, facts map<string,int>"


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing names."""
    extra = (7, "d", "k", 8, 9, 1, 2, "t", 3, "i", 4, False, 5, 6, {"a": 1})
    none = (None,) * 15
    prose = "the words of this text are english words and they stand in a line of it.\n"
    texts = [f"{prose}this is text number {i} of the many texts in the table, and it has words of its own {i}." for i in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", 1, *extra) for i, t in enumerate(texts)]
    rows += [(40, None, "en", None, None, *none), (41, "", None, "s1", 0, *none), (42, " \n ", "en", "s2", 3, *none), (43, "123 !!!", "en", "s1", 7, *none)]
    rows += [(None, texts[0], "en", "s0", None, *none), (5, texts[5], "en", "s2", 1, *extra), (5, texts[5], "en", "s2", 1, *extra), (6, texts[7], None, None, 1, *none)]
    rows += [(50, (prose * 3000) + "the end of a very long text. " * 20_000, "en", "s0", 1, *extra), (51, "the text" + " " * 1_000_100 + "goes on", "en", "s1", 1, *extra)]
    return spark.createDataFrame(rows, CLASHING)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_documents(spark, odd_documents, name, stage):
    out = stage(spark, odd_documents, DIR)
    rows = out.collect()
    if name != "pack":
        assert out.schema.simpleString() == odd_documents.schema.simpleString()
        assert all(r.facts == {"a": 1} and r.n_lines == 7 and r["_gone"] == 8 for r in rows if r.doc_id in (1, 50))
    ids = collections.Counter(r.doc_id for r in rows if name != "pack" or r.piece == 0)
    if name == "language":
        assert not {40, 41, 42, 43} & set(ids) and ids[5] == 3 and ids[50] == ids[51] == ids[None] == 1
    elif name == "lines":
        assert sum(ids.values()) == 50
        long = next(r for r in rows if r.doc_id == 50)
        assert long.text == "the words of this text are english words and they stand in a line of it.\n" * 3000 + "the end of a very long text. " * 20_000
        assert all(r.n_chars == len(r.text) for r in rows) and next(r.text for r in rows if r.doc_id == 40) == ""
        assert next(r.text for r in rows if r.doc_id == 1) == "this is text number 1 of the many texts in the table, and it has words of its own 1."
    elif name == "near copies":
        assert ids[5] == 1 and ids[None] == 0 and ids[6] == 2 and ids[7] == 0 and all(ids[i] == 1 for i in (40, 41, 42, 43, 50, 51))
    elif name == "mix":
        assert max(r for r in ids.values()) <= 9
    else:
        assert sum(ids.values()) == 50 and ids[5] == 3 and sum(r.length for r in rows if r.doc_id == 40) == 1
    assert stage(spark, odd_documents.limit(0), DIR).count() == 0


def test_run_leaves_only_what_its_result_reads(spark):
    import os

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    corpus_pipeline.run(spark, DIR).count()
    assert {p.rsplit("-", 1)[0] for p in set(os.listdir(shared)) - before} == {"mix", "pieces", "packed"}


def test_one_row_of_each_group_where_ids_repeat(spark):
    words = [f"w{i}" for i in range(100)]
    a, near, b = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"other{i}" for i in range(40))
    rows = [(2, a), (2, a), (2, b), (3, near), (1, near), (4, b), (None, a), (5, "alone here"), (5, "alone here"), (6, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, DIR)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, near), (2, b), (5, "alone here"), (6, None), (6, None)], key=str)


def test_links_where_rows_repeat(spark):
    words = [f"w{i}" for i in range(100)]
    a, near = " ".join(words), " ".join([*words[:-1], "x"])
    docs = spark.createDataFrame([(1, a), (1, a), (1, a.replace(" ", "  ")), (2, near), (2, near)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_copies, r.n_links) for r in ngram_join.similar(docs).collect()) == [(1, 3, 4)] * 3 + [(2, 2, 4)] * 2


def test_run_agrees_with_itself(spark):
    a, b = ({(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, DIR).collect()} for _ in range(2))
    assert a == b and len(a) > 0


def test_kept_hash_is_of_utf8(spark):
    rows = [(i, f"Ünïcode line number one of the text\nown {i}") for i in range(3)]
    from termlift.llm import line_dedup

    out = {r.doc_id: hashlib.sha256(r.kept_text.encode()).hexdigest() for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == hashlib.sha256(b"own 0").hexdigest() and out[2] == hashlib.sha256(rows[2][1].encode()).hexdigest()
