"""Line deduplication over levelled sorted runs of line hashes. DataFrame operations only.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends with A-Z lower-cased, held as two
64-bit hashes. Batches of documents come in descending order of id. For each batch the distinct keys of
its lines, with the number of documents and the largest id, are merge-anti-joined with the runs so far, one
level after the other: keys that no run holds are new, and the batch, which has the largest ids left, owns them.
The batch's keys become a run of level 0; when a level has two runs, these are merged into one run of the
next level. A key found in at least `min_docs` documents loses all its lines but those of its owner.

The runs are tables in the shared folder, bucketed and sorted by hash, with as many buckets as the session has
shuffle partitions (set that for the size of the data). A join of two runs reads each bucket in order, without
dealing or sorting it again. Counts are combined before they are dealt out, so a line that every document holds
is one row per task. The text itself is read twice and moved once, to meet the list of lines that it loses; the
work on a text is in proportion to its length. A run that dies leaves its tables (`lines_*`) to be deleted.

Defined cases: a null or empty text is one empty line; rows with the same id and text are one document,
rows that repeat an id with other texts are documents of their own, of which all with the owner's id keep
their lines; a row whose id is null owns nothing and loses its frequent lines to any row with an id (a key
found only in rows without id loses nothing); a text of any length is treated whole; an empty table gives an
empty result; further columns are ignored here and kept by `clean` and `cleaned`, but for those that `clean`
itself adds, whose names stand for its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import delete, forget, new_path, written

MIN_CHARS, MIN_DOCS, BATCHES = 20, 3, 4
_KEYS = ["h1", "h2"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The key of a line; lower() is the same where a line is ASCII, and much faster."""
    ends = F.trim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(ends) == F.char_length(ends), F.lower(ends)).otherwise(F.translate(ends, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, print, pos, h1, h2): the lines that count; print is a hash of the whole text."""
    # the hash of the text is made before its lines are, or it would be made again for every line
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("print"), F.col(text_col).alias("text"))
    lines = texts.select("id", "print", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.where(F.char_length("line") >= min_chars).select("id", "print", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select("id", "print", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


@contextmanager
def _in_order(spark: SparkSession) -> Iterator[None]:
    """Within this, Spark relies on the order in which the files of a bucketed table were written."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Sorted runs of (h1, h2, n, owner), at most one at rest on a level; add() takes batches in descending order of id."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[str | None] = []  # the table of each level's run
        self.paths: dict[str, str] = {}

    def read(self, table: str) -> DataFrame:
        return self.spark.table(table).hint("merge")

    def _sorted(self, rows: DataFrame) -> str:
        """rows, dealt by hash already, as a bucketed and sorted table."""
        name = f"lines_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, name)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.write.format("parquet").bucketBy(buckets, *_KEYS).sortBy(*_KEYS).option("path", self.paths[name]).saveAsTable(name)
        return name

    def drop(self, *tables: str) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            delete(self.spark, self.paths.pop(t))

    def runs(self) -> list[str]:
        return [t for t in self.levels if t]

    def fresh(self, seen: str) -> DataFrame:
        """Of a batch's keys those that no run holds: an anti join with each level's run."""
        rows = self.read(seen)
        for run in self.runs():
            rows = rows.join(self.read(run).select(*_KEYS), _KEYS, "left_anti")
        return rows

    def owned(self, seen: str, fresh: str) -> DataFrame:
        """The batch's keys, the fresh ones with the batch's largest id as their owner."""
        new = self.read(fresh).select(*_KEYS, F.col("last").alias("owner"))
        return self.read(seen).join(new, _KEYS, "left").select(*_KEYS, "n", "owner")

    def merged(self, left: str, right: str) -> DataFrame:
        """Both runs in one, in the order of the hashes; a key is owned in one of them at most."""
        a, b = self.read(left), self.read(right).toDF("g1", "g2", "m", "other")
        both = a.join(b, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "full")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        return both.select(F.coalesce("h1", "g1").alias("h1"), F.coalesce("h2", "g2").alias("h2"), n.alias("n"), F.coalesce("owner", "other").alias("owner"))

    def add(self, batch: DataFrame) -> None:
        """batch: as of hashed_lines(). Keys that a run holds keep their owner; the others are this batch's."""
        once = batch.select(*_KEYS, "id", "print").distinct()
        keys = once.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.max("id").alias("last"))
        with _in_order(self.spark):
            if not self.runs():
                run = self._sorted(keys.withColumnRenamed("last", "owner"))
            else:
                seen = self._sorted(keys)
                fresh = self._sorted(self.fresh(seen))
                run = self._sorted(self.owned(seen, fresh))
                self.drop(seen, fresh)
            self._push(0, run)

    def _push(self, at: int, run: str) -> None:
        if at == len(self.levels):
            self.levels.append(None)
        held, self.levels[at] = self.levels[at], None
        if not held:
            self.levels[at] = run
            return
        both = self._sorted(self.merged(held, run))
        self.drop(held, run)
        self._push(at + 1, both)

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, owner) of the keys found in at least min_docs documents. The runs end here."""
        with _in_order(self.spark):
            while len(left := self.runs()) > 1:
                both = self._sorted(self.merged(*left[:2]))
                self.drop(*left[:2])
                self.levels = [both, *left[2:]]
            rows = self.spark.table(left[0]) if left else self.spark.createDataFrame([], "h1 long, h2 long, n long, owner long")
            out = written(rows.where(F.col("n") >= min_docs).where("owner is not null").select(*_KEYS, "owner"), "frequent")
        self.drop(*left)
        self.levels = []
        return out


def _without_lost(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """docs with columns _c0, _c1 and so on, `_kept` (the text that is left), `_lines` and `_dropped`."""
    spark = docs.sparkSession
    hashed = written(hashed_lines(docs, id_col, text_col, min_chars), "lines")
    cuts = hashed.select(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts), reverse=True)
    runs = LineRuns(spark)
    for hi, lo in zip([None, *cuts], [*cuts, None]):
        part = hashed
        if hi is not None:
            part = part.where(F.col("id") < hi) if lo is not None else part.where((F.col("id") < hi) | F.col("id").isNull())
        if lo is not None:
            part = part.where(F.col("id") >= lo)
        runs.add(part)
    # a table of its own, so that the join's two sides are plain exchanges and a very common line is split
    frequent = runs.frequent(min_docs)
    lost = hashed.join(frequent, _KEYS).where("id is null or id <> owner")
    gone = written(lost.groupBy(F.col("id").alias("_id"), F.col("print").alias("_print")).agg(F.collect_set("pos").alias("_gone")), "gone")
    forget(spark, hashed, frequent)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])  # columns of any name pass through the join
    id_at, text_at = (F.col(f"_c{docs.columns.index(c)}") for c in (id_col, text_col))
    met = plain.join(gone, id_at.cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(text_at, F.lit(""))) == F.col("_print")), "left")
    lines = lines_of(text_at)
    # the lambda holds the split text, which as an expression would be split again for every line
    left = F.transform(F.array(lines), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)), "\n"))
    kept = F.when(F.col("_gone").isNull(), F.coalesce(text_at, F.lit(""))).otherwise(F.get(left, F.lit(0)))
    return met.withColumns({"_kept": kept, "_lines": F.size(lines).cast("long"), "_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")})


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """All rows and columns of docs, with `kept_text`, `n_lines` and `n_dropped`."""
    own = {"kept_text": "_kept", "n_lines": "_lines", "n_dropped": "_dropped"}
    out = _without_lost(docs, id_col, text_col, min_chars, min_docs, batches)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in own], *[F.col(v).alias(c) for c, v in own.items()])


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """All rows and columns of docs, the text being what is left of it and `chars_col`, where there is one, its length."""
    out = _without_lost(docs, id_col, text_col, min_chars, min_docs, batches)
    new = {text_col: F.col("_kept"), chars_col: F.char_length("_kept").cast(dict(docs.dtypes).get(chars_col, "long"))}
    return out.select(*[new.get(c, F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns)])
