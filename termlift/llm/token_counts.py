"""Token counts of a unigram vocabulary by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words `[^\\x20\\x09-\\x0D]+` behind the word mark. Its count is the number of pieces of
the segmentation with the highest total score, pre-token by pre-token. The distinct pre-tokens of a batch
are walked in sorted order, which is a depth-first walk of their trie: for each node the best score of its
prefix and the number of pieces that reaches it are kept on a stack, so a prefix that many pre-tokens share
is scored once, and a pre-token's count is that of its terminal node. Counts already known to a worker are
taken from a bounded table.

The pieces are those of a public vocabulary file (a parameter; piece_bpe_32k.model by default). That file
has ranks, not probabilities, so a piece's log probability is Zipf's, -log(rank + 1), normalised over the
vocabulary. A character in no piece costs `unknown` for each of its UTF-8 bytes, a byte piece each.

Defined cases: a null or empty text, or one without a word, has 0 tokens; of segmentations with equal
scores the one with fewer pieces counts; a text of any length is counted whole, words of any length too; rows that repeat an id are documents of their own; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, KNOWN, STEP_BYTES = "▁", 600_000, 1 << 22


def read_vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model in order of rank, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Unigram:
    """Scores of pieces, and token counts of words."""

    def __init__(self, pieces: Iterable[str]):
        pieces = list(dict.fromkeys(pieces))
        whole = math.log(sum(1 / (r + 1) for r in range(len(pieces)))) if pieces else 0.0
        self.scores = {p: -math.log(r + 1) - whole for r, p in enumerate(pieces)}
        self.unknown = min(self.scores.values(), default=0.0) - 10.0
        #: lengths of the pieces that end with three given characters
        self.lengths: dict[str, list[int]] = {}
        for p in self.scores:
            if len(p) > 2 and len(p) not in self.lengths.setdefault(p[-3:], []):
                self.lengths[p[-3:]].append(len(p))
        self.known: dict[str, int] = {}

    def walk(self, words: list[str]) -> list[int]:
        """Counts of sorted distinct words: one step for each node of their trie."""
        scores, unknown, lengths = self.scores, self.unknown, self.lengths.get
        best, count, text = [0.0], [0], ""
        get = scores.get
        # the word mark is the root's only child
        out = []
        for word in words:
            word = MARK + word
            n = min(len(text), len(word))
            same = 0
            if word[:n] == text[:n]:
                same = n
            else:
                while word[same] == text[same]:
                    same += 1
            del best[same + 1 :], count[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                top, pieces = -math.inf, 0
                for size in (1, 2, *lengths(word[end - 3 : end], ())) if end > 2 else (1, 2)[:end]:
                    start = end - size
                    s = get(word[start:end]) if start >= 0 else None
                    if s is not None:
                        s += best[start]
                        if s > top or (s == top and count[start] + 1 < pieces):
                            top, pieces = s, count[start] + 1
                if word[end - 1] not in scores:
                    raw = len(word[end - 1].encode("utf-8", "surrogatepass"))
                    s = best[end - 1] + unknown * raw
                    if s > top:
                        top, pieces = s, count[end - 1] + raw
                best.append(top), count.append(pieces)
            out.append(count[len(word)])
            text = word
        return out

    def counts(self, words: set[str]) -> dict[str, int]:
        """A table that has the counts of all these words."""
        new = sorted(words.difference(self.known))
        if len(self.known) + len(new) > KNOWN:
            self.known, new = {}, sorted(words)
        self.known.update(zip(new, self.walk(new)))
        return self.known


_loaded: dict[str, Unigram] = {}


def _words(text: str) -> list[str]:
    """str.split() also splits at other white space, so only where the text is free of it is it used."""
    return text.split() if text.isascii() and not _ODD.intersection(text) else [w.decode() for w in text.encode("utf-8", "surrogatepass").split()]


_ODD = frozenset("\x1c\x1d\x1e\x1f")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per document: the id, n_words and n_tokens."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = Unigram(read_vocabulary(path))
        model = _loaded[path]
        for batch in batches:
            col = batch.column(1)
            edge = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64))])
            i, n = 0, len(col)
            while i < n:
                j = min(n, max(i + 1, int(np.searchsorted(edge, edge[i] + STEP_BYTES, "right")) - 1))
                words = [_words(x) if x else [] for x in col.slice(i, j - i).to_pylist()]
                table = model.counts(set().union(*words)) if words else {}
                get = table.__getitem__
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(get, w)) for w in words], pa.int64())], names=["id", "n_words", "n_tokens"])
                i = j

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
