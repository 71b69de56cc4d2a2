"""What the operators of this subpackage share: written tables, Arrow batches of bounded size,
hashing of words in byte buffers, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Bytes of text that one vectorised step works on; a longer text is a step of its own. A step takes some 40 bytes a byte of
#: text, which the worker keeps for its next tasks.
STEP_BYTES = 1 << 18

_U = np.uint64
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# ------------------------------------------------------------------ written tables


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests on one machine), a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="termlift-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the tables that written() has made meanwhile, but for those to be kept."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _scopes and not keep:
        _scopes[-1].append(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver has. Made by way of Arrow, since from a list Spark makes an RDD that executors
    start Python workers of another kind for, with a daemon of their own beside that of the Arrow functions."""
    kind = _parse_datatype_string(schema)
    columns = list(zip(*rows)) or [[] for _ in kind]
    types = to_arrow_schema(kind)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types), kind)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_written_path", None)
        if path:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# ------------------------------------------------------------------ text buffers


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def text_steps(col: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets from 0) of at most `most` bytes or one row each."""
    if not len(col):
        return
    data, offs = _buffers(col)
    i, n = 0, len(col)
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def text_parts(col: pa.Array, breaks: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """As text_steps, with whether the rows end there: a row of more than `most` bytes comes in parts, each cut after
    the last byte of `most` for which the table `breaks` holds, or after the next one where a stretch has none."""
    for i, j, data, offs in text_steps(col, most):
        at = 0
        while len(data) - at > most:
            near = np.flatnonzero(breaks[data[at : at + most]])
            end = at + int(near[-1]) + 1 if len(near) else 0
            far = at + most
            while not end and far < len(data):
                found = np.flatnonzero(breaks[data[far : far + most]])
                end = far + int(found[0]) + 1 if len(found) else 0
                far += most
            if not end or end == len(data):
                break
            yield i, j, data[at:end], np.array([0, end - at]), False
            at = end
        yield i, j, data[at:], offs if at == 0 else np.array([0, len(data) - at]), True


def word_spans(buf: np.ndarray, offs: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words `[^\\x20\\x09-\\x0D]+` (or runs of bytes that are not `apart`), and for each row the
    index of its first word."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    space = apart[buf]
    before = np.empty(len(buf), bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(len(buf), bool)
    after[-1] = True
    after[:-1] = space[1:]
    inner = offs[(offs > 0) & (offs < len(buf))]
    before[inner] = True
    after[inner - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base % (1 << 64), pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b, _U)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_BYTES, _SEQ_A, _SEQ_B = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F), Powers(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every span, by one running sum."""
    up, down = powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum((values.astype(_U) + _U(1)) * up[: len(values)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(buf, starts, ends, _BYTES)


def sequence_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each row's sequence of word hashes."""
    return span_hashes(words, first[:-1], first[1:], _SEQ_A), span_hashes(words, first[:-1], first[1:], _SEQ_B)


def runs_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for the n words from each position (positions within n of the end are to be ignored)."""
    out = np.zeros(len(words), _U)
    for k in range(n):
        out[: len(words) - k] += words[k:] * _U((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1)
    return mix64(out)


# ------------------------------------------------------------------ sorted groups


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches of rows sorted by keys, tables that hold only whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        changed = np.zeros(n, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            changed[1:] |= v[1:] != v[:-1]
        cut = int(np.flatnonzero(changed)[-1]) if changed.any() else 0
        if held and not all(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() == c[0].as_py() for k, c in zip(keys, cols)):
            if cut == 0:
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def group_starts(cols: list[np.ndarray]) -> np.ndarray:
    """Indices at which a new group starts, with the number of rows at the end."""
    n = len(cols[0])
    changed = np.zeros(n, bool)
    if n:
        changed[0] = True
    for c in cols:
        changed[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(changed), n)


# ------------------------------------------------------------------ pairs within blocks


def blocked(df: DataFrame, key: str, item: Column, count: str, most: int) -> DataFrame:
    """Deal the rows of each key into blocks of about `most` rows, and a row to each pair of blocks
    (lo, hi) that its own block (blk) takes part in. A key with n rows gets n/most blocks, so no task
    ever holds a whole large key."""
    blocks = F.ceil(F.col(count) / F.lit(most)).cast("int")
    df = df.withColumn("_nb", blocks).withColumn("blk", F.pmod(F.xxhash64(item, F.lit(7)), F.col("_nb")).cast("int"))
    df = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return df.withColumns({"lo": F.least("blk", "_j"), "hi": F.greatest("blk", "_j")}).drop("_nb", "_j", count)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is linked with, by min-label propagation."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) with a > b, both long -> (node, component): component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Every round is a table in the
    shared folder; a star's centre is found by a grouped minimum with map-side combination, so a node
    with very many neighbours needs no task of its own; the joins are of kinds that AQE can split."""
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark_of(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark_of(now)
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = written(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        mark = mark_of(new)
        forget(spark, now)
        now = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
