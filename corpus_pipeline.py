"""A corpus from raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, in their order, whatever other columns there
are and however these are called; a column that a stage does not name passes through it, nulls included.

All stages: an empty table gives an empty result, rows that repeat are rows of their own where nothing else is said,
and a text of any length is treated whole. What each does with nulls, ties and repeated rows its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlift.llm import language_id, line_dedup, ngram_join, sequence_packing, source_mixing
from termlift.llm._shared import forget, scratch, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject.

    A text that is null, empty or without a letter goes. Rows whose doc_id, text or lang is null teach nothing; without
    any row that teaches, all go. Equal texts stay or go together."""
    return language_id.accepted(docs, language_id.fit(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others hold; n_chars, where there is one, is the length of what is left.

    A null text becomes an empty one. A line stays in the document with the largest doc_id; rows without doc_id lose
    it to any other; rows that repeat a doc_id and text are one document for the count."""
    return line_dedup.cleaned(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id.

    Texts that are null or have no word are copies of nothing and stay. Where ids repeat or are null, rows are
    numbered in the order of their ids (null last) and texts, so that each is a document of its own and one row of each group stays."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = docs.toDF(*names)
    if not rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty():
        rows = written(rows.orderBy(F.asc_nulls_last(key), F.xxhash64(text)).withColumn("_row", F.monotonically_increasing_id()), "numbered")
        key = "_row"
    gone = ngram_join.similar(rows, id_col=key, text_col=text).where("not kept").select(F.col(key).alias("_gone")).distinct()
    return rows.join(gone, F.col(key) == F.col("_gone"), "left_anti").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it, at most 3 times.

    A null source is a source of its own; a null text has no words; rows that repeat a doc_id are taken each on its own."""
    return source_mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in the sequences.

    A null or empty text is the end id alone; a null doc_id stays null; every row is packed, repeated ones too."""
    return sequence_packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL has no form of the trained, sampled and greedy stages; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what the stage wrote for itself goes once its result is written
            kept = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        forget(spark, docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
