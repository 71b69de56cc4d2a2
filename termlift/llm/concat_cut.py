"""Concatenate and cut: all documents end to end, cut into windows of a fixed number of tokens.

A document is its token ids and an end id. Two passes of prefix sums place it. The first encodes every text and writes the
ids with the document's place within its partition, a running sum of the task. The totals of the partitions, one row
each, are summed up to the place at which each partition begins. The second pass adds the two and cuts: sequence w
holds the tokens from w * length on, and a document that lies across a boundary leaves a record on both sides. Nothing
is sorted or shuffled but the totals, so one source, one group of copies or one very long document makes no task larger
than its own partition, and only the last sequence is not full.

The vocabulary drops white space, so no token and no step of its normaliser spans one. A text is parted at
`[\\x20\\x09-\\x0D]+`, and further where it surely is by the vocabulary; every different part of a step is encoded once
by the tokenizers library, and parts met before come from a table of bounded size. Strings of the vocabulary's special tokens in a text get their own ids, as in
the library's plain call with add_special_tokens=False. A vocabulary that keeps white space or case is refused.

Defined cases: a null or empty text, and one of white space alone, is the end id alone; a text of any length is encoded
whole, in steps, so that besides the text only its ids (4 bytes each) are held; rows that repeat are documents of their own,
a null id stays null; no ties can arise; bytes that are not UTF-8 are read as U+FFFD; an empty table gives an empty result;
further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import SPACES, text_parts, word_spans, written

LENGTH, END_ID = 2048, 1
#: Parts of texts whose ids a worker remembers, the bytes of those, bytes of text in a step, partition totals that are broadcast.
REMEMBERED, REMEMBERED_BYTES, STEP, BROADCAST_ROWS = 1 << 19, 1 << 25, 1 << 22, 1_000_000
#: How many parts are encoded as one text.
TOGETHER = 512
#: Kinds of bytes: digits, letters (those of U+00C0 to U+017F have lead bytes C3 to C5), other signs.
_KIND = np.full(256, 3, np.uint8)
_KIND[0x30:0x3A] = 2
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: Bytes that leave a run in one: apostrophes, which may begin a part of their own, "<" of special tokens, other characters.
_ODD = np.zeros(256, bool)
_ODD[[0x27, 0x3C, 0xC2, *range(0xC6, 0x100)]] = True
#: The signs and the letter that lowers to two in U+00C0 to U+017F.
_ODD_PAIRS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
_ODD_PART = re.compile(b"|".join([b"[" + bytes(np.flatnonzero(_ODD).tolist()) + b"]", *map(bytes, _ODD_PAIRS)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class PartEncoder:
    """Ids of rows of text, by encoding every different part once; up to `most` different parts are remembered.

    A part is a run without white space, or, where such a run has only the letters, digits and signs whose kinds are
    known by their bytes, each of its stretches of letters or of signs and each digit, A to Z lower-cased: what the
    vocabulary splits and lowers anyway. Such parts have one token with the mark of a word's end, so many of them are
    encoded as one text and told apart by that mark."""

    def __init__(self, json_path: str, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(json_path)
        plain = lambda x: self.plain.encode(x, add_special_tokens=False).ids
        if plain("A \n b1c") != [i for x in ("a", "b", "1", "c") for i in plain(x)]:
            raise ValueError(f"{json_path} keeps white space, case or words with digits, so that texts cannot be encoded in parts")
        self.ends = np.array([str(self.plain.id_to_token(i)).endswith("</w>") for i in range(self.plain.get_vocab_size())])
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.plain.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _alone(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(parts)
        sizes = np.array([len(x) for x in ids], np.int64)
        return np.fromiter((i for x in ids for i in x), "<u4", int(sizes.sum())), sizes

    def _together(self, parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        groups = [parts[i : i + TOGETHER] for i in range(0, len(parts), TOGETHER)]
        out = []
        for group, ids in zip(groups, self._ids([b" ".join(g) for g in groups])):
            ids = np.array(ids, "<u4")
            ends = np.flatnonzero(self.ends[ids])
            out.append((ids, np.diff(ends, prepend=-1)) if len(ends) == len(group) else self._alone(group))
        return out

    def _learn(self, parts: list[bytes]) -> None:
        simple, whole = [p for p in parts if not _ODD_PART.search(p)], [p for p in parts if _ODD_PART.search(p)]
        made = self._together(simple) + ([self._alone(whole)] if whole else [])
        sizes = np.concatenate([x[1] for x in made])
        self.held += sum(map(len, parts))
        self.place.update(zip([*simple, *whole], range(len(self.starts), len(self.starts) + len(parts))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, *[x[0] for x in made]])

    @staticmethod
    def _parts(data: np.ndarray, offs: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The parts of rows of text, and the index of each row's first one."""
        starts, ends, first = word_spans(data, offs)
        at = np.concatenate([[0], np.cumsum(ends - starts)])
        inner = data[~SPACES[data]]
        odd = _ODD[inner]
        for x, y in _ODD_PAIRS:
            odd[:-1] |= (inner[:-1] == x) & (inner[1:] == y)
        whole = np.repeat(np.add.reduceat(odd, at[:-1], dtype=np.int32) > 0, ends - starts)
        kind = _KIND[inner]
        begins = kind == 2
        begins[1:] |= kind[1:] != kind[:-1]
        begins &= ~whole
        begins[at[:-1]] = True
        cuts = np.flatnonzero(begins)
        inner = np.where(whole, inner, _LOWER[inner])
        bounds = np.append(cuts, len(inner)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(inner.tobytes())])
        return parts.dictionary_encode(), np.searchsorted(cuts, at[first])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of text, end to end, and how many each row has."""
        if not len(data) or SPACES[data].all():
            return np.zeros(0, "<u4"), np.zeros(len(offs) - 1, np.int64)
        parts, first = self._parts(data, offs)
        distinct = parts.dictionary.to_pylist()
        if len(self.place) + len(distinct) > self.most or self.held > REMEMBERED_BYTES:
            self._clear()
        if new := [p for p in distinct if p not in self.place]:
            self._learn(new)
        place = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[parts.indices.to_numpy()]
        sizes = self.sizes[place]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.starts[place] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, np.diff(upto[first])


_encoders: dict[str, PartEncoder] = {}


def encoder(json_path: str) -> PartEncoder:
    """The worker's own, with what it remembers."""
    if json_path not in _encoders:
        _encoders[json_path] = PartEncoder(json_path)
    return _encoders[json_path]


def vocabulary() -> str:
    """Path of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after those of each row, and where each row begins (and the last one ends)."""
    upto = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(upto[-1], end_id, "<u4")
    inner = np.ones(upto[-1], bool)
    inner[upto[1:] - 1] = False
    out[inner] = ids
    return out, upto


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """(part, local_start, id, doc_tokens, ids): every document's ids, and its place in its partition."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            held: list[np.ndarray] = []  # of a row that is not at its end
            for i, j, data, offs, whole in text_parts(batch.column(1), SPACES, STEP):
                ids, counts = known.encode(data, offs)
                if not whole:
                    held.append(ids)
                    continue
                if held:
                    ids = np.concatenate([*held, ids])
                    counts, held = np.array([len(ids)]), []
                ids, upto = _with_end(ids, counts, end_id)
                ends = pa.py_buffer((4 * upto).astype(np.int64).tobytes())
                raw = pa.Array.from_buffers(pa.large_binary(), j - i, [None, ends, pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                cols = [pa.array(np.full(j - i, part, np.int32)), pa.array(at + upto[:-1]), batch.column(0).slice(i, j - i), pa.array(np.diff(upto)), raw]
                at += int(upto[-1])
                yield pa.RecordBatch.from_arrays(cols, names=["part", "local_start", "id", "doc_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"part int, local_start long, id {dict(rows.dtypes)['id']}, doc_tokens long, ids binary")


def offsets(rows: DataFrame, wide: int = 1024) -> DataFrame:
    """(part, before): tokens before each partition. Sums run within `wide` partitions and over their totals."""
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("n")).withColumn("block", F.floor(F.col("part") / wide))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("base"))
    inner = F.sum("n").over(Window.partitionBy("block").orderBy("part")) - F.col("n")
    return totals.join(blocks, "block").select("part", (F.col("base") + inner).alias("before"))


def concatenate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: the document's id, start, length, ids_crc32, doc_tokens, sequence_id and offset, whether the document
    began before it (cut_before) or goes on after it (cut_after), and the ids where asked for."""
    rows = written(encoded(docs, id_col, text_col, end_id, path), "encoded")
    before = written(offsets(rows), "offsets")
    placed = rows.join(F.broadcast(before) if before.count() <= BROADCAST_ROWS else before, "part")
    begin = F.col("before") + F.col("local_start")
    end = begin + F.col("doc_tokens")

    def piece(w):
        left, right = F.greatest(w * length, begin), F.least((w + 1) * length, end)
        ids = F.substring("ids", (4 * (left - begin) + 1).cast("int"), (4 * (right - left)).cast("int"))
        made = [(left - begin).alias("start"), (right - left).alias("length"), F.crc32(ids).alias("ids_crc32"), w.alias("sequence_id"), (left - w * length).alias("offset")]
        return F.struct(*made, *([ids.alias("ids")] if with_ids else []))

    windows = F.sequence(F.floor(begin / length), F.floor((end - 1) / length))
    out = placed.select("id", "doc_tokens", F.explode(F.transform(windows, piece)).alias("p"))
    more = ["p.ids"] if with_ids else []
    cuts = [(F.col("p.start") > 0).alias("cut_before"), (F.col("p.start") + F.col("p.length") < F.col("doc_tokens")).alias("cut_after")]
    return out.select(F.col("id").alias(id_col), "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", *cuts, *more)


def boundaries(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, id, start): the document and the token of it with which each sequence begins."""
    return pieces.where(F.col("offset") == 0).select("sequence_id", id_col, "start")
