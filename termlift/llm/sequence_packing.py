"""Sum-of-squares packing (Csirik et al., 2006) of tokenised documents into fixed-length sequences.

A document is its token ids and an end id. One longer than a sequence is cut into whole sequences, of which
the first piece is the rest that is left over; all other documents stay whole. A piece of length s goes to
the open sequence, or a new one, for which the sum over gaps g of N(g) squared becomes smallest, N(g) being
the number of open sequences with g tokens free.

Pieces are dealt into groups of about `group` pieces by a hash and packed group by group, longest first
within a group. Sequences that a group leaves open are taken apart again, and their pieces packed
once more in larger groups, so that what is lost is a few sequences for every `group` * 16 pieces.

The ids of byte_bpe_50k.json are made by tiktoken from the same vocabulary as ranks, which is four times as
fast as the tokenizers library here and gives the same ids (tests/llm compares them; `engine="tokenizers"`
uses that library). Strings of the vocabulary's added tokens in a text get their own ids, as in that library's plain call with
add_special_tokens=False; what lies between two of them is encoded by itself. tiktoken cannot split a text with about
a million white-space characters in a row; such a run is cut out where the split pattern ends a token anyway and
merged as one token of its own.

Defined cases: a null or empty text is the end id alone; a text of any length and make is encoded whole; rows
that repeat an id are documents of their own; ties between sequences go to the fullest; an empty table gives an
empty result; further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

LENGTH, END_ID, GROUP, SEED = 2048, 0, 16384, 5
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of Unicode white space that are long enough to be cut out where the split pattern fails.
_LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")
_made: dict[tuple[str, str], object] = {}


def _in_parts(text: str) -> Iterator[tuple[bool, str]]:
    """The text in order, as (is one token of the split pattern, part). A run of white space is one token but
    for its last character, which begins the next one; at the end of the text it is one token."""
    at = 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        if m.start() > at:
            yield False, text[at : m.start()]
        yield True, text[m.start() : end]
        at = end
    if at < len(text):
        yield False, text[at:]


def encoder(json_path: str, ranks_path: str | None, engine: str = "tiktoken"):
    """A function from a text to its ids as little-endian uint32."""
    if (json_path, engine) not in _made:
        if engine == "tiktoken" and ranks_path:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            added = {t["content"]: t["id"] for t in json.load(open(json_path, encoding="utf-8"))["added_tokens"]}
            # the longest first, where one begins with another
            cut_at = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
            split, whole = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("split", _SPLIT), ("whole", r"(?s).+")))

            def encode(text: str) -> np.ndarray:
                if cut_at and cut_at.search(text):
                    parts = [x for x in cut_at.split(text) if x]
                    return np.concatenate([np.array([added[x]], "<u4") if x in added else plain_text(x) for x in parts])
                return plain_text(text)

            def plain_text(text: str) -> np.ndarray:
                try:
                    return split.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
                except ValueError:  # the pattern's stack is too small for a run of white space
                    return np.concatenate([(whole if one else split).encode_to_numpy(x, disallowed_special=()) for one, x in _in_parts(text)]).astype("<u4", copy=False)

            _made[json_path, engine] = encode
        else:
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(json_path)
            _made[json_path, engine] = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, "<u4")
    return _made[json_path, engine]


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """Paths of a public tokenizer and of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, paths: tuple[str, str | None] | None = None, engine: str = "tiktoken", with_ids: bool = False) -> DataFrame:
    """Per piece: rid (of the input row), id, piece, start, length, ids_crc32, and the ids where asked for."""
    json_path, ranks_path = paths or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path, engine)
        for batch in batches:
            row, number, start, size, crc, raw = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4") if text else np.array([end_id], "<u4")
                data, n = ids.tobytes(), len(ids)
                first = n % length or length
                at, k = 0, 0
                while at < n:
                    upto = first if k == 0 else at + length
                    row.append(i), number.append(k), start.append(at), size.append(upto - at), crc.append(zlib.crc32(data[4 * at : 4 * upto]))
                    if with_ids:
                        raw.append(data[4 * at : 4 * upto])
                    at, k = upto, k + 1
            take = pa.array(np.array(row, np.int64))
            cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["rid", "id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(raw, pa.binary())), names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"rid long, id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces in order: the sequence and the offset of each; and the tokens free in every sequence."""
    counts = np.zeros(capacity + 1, np.int64)  # N(g); a full sequence is not open
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    which, where = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    live = 0
    for i, s in enumerate(sizes.tolist()):
        best, gap = 2 * counts[capacity - s] + 1 if s < capacity else 0, 0
        if live and s < capacity:
            # from gap g to g - s: -2 N(g) + 1, and 2 N(g - s) + 1 unless the sequence is then full
            change = 2 * (counts[: capacity - s] - counts[s:capacity]) + 2
            change[0] = 1 - 2 * counts[s]
            change[counts[s:capacity] == 0] = 1 << 60
            j = int(change.argmin())
            if change[j] <= best:
                gap = j + s
        if gap:
            b = open_[gap].pop()
            counts[gap] -= 1
            live -= 1
        else:
            b, gap = len(free), capacity
            free.append(capacity)
        which[i], where[i] = b, capacity - gap
        free[b] = gap - s
        if gap - s:
            counts[gap - s] += 1
            open_[gap - s].append(b)
            live += 1
    return which, where, np.array(free, np.int64)


def _packer(capacity: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "mark", "rid", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        which, where, free = sum_of_squares(pdf["length"].to_numpy(np.int64), capacity)
        g = int(pdf["g"].iloc[0])
        again = np.zeros(len(pdf), bool) if last else free[which] > 0
        return pdf.assign(sequence_id=(np.int64(g) << 32) + 2 * which + int(last), offset=where, again=again)

    return run


def pack(parts: DataFrame, length: int = LENGTH, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """parts: a table as of pieces(); adds sequence_id and offset."""
    light = parts.select("rid", "piece", "length", F.xxhash64(F.lit(seed), "id", "piece", "length", "ids_crc32").alias("mark"))
    n = light.where(F.col("length") < length).count()
    full = light.where(F.col("length") == length)
    kinds = "rid long, piece int, length long, mark long, g int, sequence_id long, offset long, again boolean"
    deal = lambda df, groups: df.withColumn("g", F.pmod("mark", F.lit(max(1, groups))).cast("int"))
    first = written(deal(light.where(F.col("length") < length), -(-n // group)).groupBy("g").applyInPandas(_packer(length, False), kinds), "packed")
    rest = first.where("again").select("rid", "piece", "length", "mark")
    m = rest.count()
    second = deal(rest, -(-m // (4 * group))).groupBy("g").applyInPandas(_packer(length, True), kinds)
    placed = first.where("not again").unionByName(second).select("rid", "piece", "sequence_id", "offset")
    alone = full.select("rid", "piece", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return parts.join(placed.unionByName(alone), ["rid", "piece"])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP, **options) -> DataFrame:
    """Per piece: the document's id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    parts = written(pieces(docs, id_col, text_col, length, **options), "pieces")
    out = pack(parts, length, group)
    more = ["ids"] if "ids" in parts.columns else []
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *more)
