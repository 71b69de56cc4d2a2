"""Line-first quality rules: failing lines go first, then documents that lose too much text.

A line that has a word fails if one of these holds (counts are of its code points and words):
  symbols      more than a tenth of its characters are of `[#*$%&|<>]`
  exclamation  "!!" occurs for more than a third of its words
  capitals     at least 5 words, and A-Z are more than 7 in 10 of its ASCII letters
  navigation   a quarter or more of its words are separators (a word that is one of | > / » › · •)
  stutter      more than a third of its words equal the word before in the line
  endless      at least 30 words, and no sentence mark (one of SENTENCE) among its characters
  menu         it is one of three or more successive lines (those without a word apart) that each have fewer than 6
               words and do not end with a sentence mark, a colon, a semicolon, a quote or a bracket
  boilerplate  it holds one of BOILERPLATE (in English, German, French or Spanish), A-Z being equal to a-z
  repeat       it equals an earlier line of the text
A document is rejected if it fails the base rules (fewer than 20 words, or more than 30 % of its words in
8-word windows that occur twice or more), or if its failing lines hold more than `most_lost` percent of its
characters. Words are `[^\\x20\\x09-\\x0D]+`, lines are split at \\n, whole texts are read.

Defined cases: a null or empty text has no word and is rejected; rows that repeat an id are documents of
their own; texts and lines of any length are read whole; an empty table gives an empty result; further columns of
the input, whatever their names, are ignored by `assess` and kept by `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Powers, mix64, runs_hashes, span_hashes, text_steps, word_hashes, word_spans

_U = np.uint64
MIN_WORDS, MOST_REPEATED, WINDOW, MOST_LOST = 20, 30, 8, 50
SYMBOLS, SEPARATORS = "#*$%&|<>", ("|", ">", "/", "»", "›", "·", "•")
BOILERPLATE = (
    "all rights reserved", "cookie policy", "uses cookies", "accept cookies", "privacy policy", "terms of use",
    "terms of service", "subscribe to our", "sign up for our", "enable javascript", "click here", "lorem ipsum",
    "skip to content", "share on facebook", "licensed under", "released under the",
    "alle rechte vorbehalten", "verwendet cookies", "newsletter abonnieren", "hier klicken", "zum inhalt springen", "javascript aktivieren",
    "politique de cookies", "utilise des cookies", "cliquez ici", "conditions d'utilisation", "aller au contenu", "partager sur facebook",
    "todos los derechos reservados", "utiliza cookies", "haga clic", "saltar al contenido", "compartir en facebook", "aviso legal",
)
#: Marks that a sentence has, and what else a line of running text may end with.
SENTENCE, CLOSING = ".!?…。！？।؟۔", ":;\"')]”»“"
ENDLESS, BRIEF, MENU = 30, 6, 3

_LINES = Powers(0x9E3779B97F4A7C15)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_PHRASES = re.compile(b"|".join(re.escape(x.encode()) for x in BOILERPLATE), re.I)  # of bytes: A-Z only
_MARKS = {int(word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))[0]) for x in SEPARATORS}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars"]


def _sums(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Number of set flags between successive cuts."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def _last_bytes(buf: np.ndarray, marks: str) -> np.ndarray:
    """Flags of the bytes with which one of the marks ends."""
    out = np.zeros(len(buf), bool)
    for mark in marks:
        code = mark.encode()
        at = buf == code[-1]
        for k in range(1, len(code)):
            at[k:] &= buf[:-k] == code[-1 - k]
            at[:k] = False
        out |= at
    return out


def measure(buf: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts for each row; and the lines' bounds, with a flag for those that fail."""
    rows = len(offs) - 1
    starts, ends, first = word_spans(buf, offs)
    words = word_hashes(buf, starts, ends)
    n_words = np.diff(first)

    breaks = np.flatnonzero(buf == 10)
    line_start = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    line_end = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
    line_row = np.repeat(np.arange(rows), 1 + np.diff(np.searchsorted(breaks, offs)))
    cuts = np.append(line_start, len(buf))
    first_word = np.searchsorted(starts, cuts)
    line_words = np.diff(first_word)
    has = line_words > 0

    point = ((buf & 0xC0) != 0x80) & (buf != 32) & ((buf < 9) | (buf > 13))
    chars = _sums(point, cuts)
    symbols = _sums(_IS_SYMBOL[buf], cuts)
    upper, lower = _sums((buf >= 65) & (buf <= 90), cuts), _sums((buf >= 97) & (buf <= 122), cuts)
    bang = buf == 33
    # "!!" counted without overlap, as in a run of k marks k // 2 times
    edge = np.flatnonzero(np.diff(np.concatenate([[False], bang, [False]]).astype(np.int8)))
    at, to = edge[::2], edge[1::2]
    pairs = np.zeros(len(line_start), np.int64)
    cross = np.searchsorted(offs, at, "right") != np.searchsorted(offs, to - 1, "right")
    for i in np.flatnonzero(cross):  # a run that goes on in the next row: by its parts
        inner = offs[(offs > at[i]) & (offs < to[i])]
        bounds = np.concatenate([[at[i]], inner, [to[i]]])
        for s, e in zip(bounds[:-1], bounds[1:]):
            pairs[np.searchsorted(cuts, s, "right") - 1] += (e - s) // 2
    np.add.at(pairs, np.searchsorted(cuts, at[~cross], "right") - 1, (to - at)[~cross] // 2)
    marks = _sums(np.isin(words, np.array(sorted(_MARKS), _U)), first_word)

    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first_word[:-1][has]] = False
    stutter = 3 * _sums(same, first_word) > line_words

    fails = stutter | (10 * symbols > chars) | (3 * pairs > line_words) | ((line_words >= 5) & (10 * upper > 7 * (upper + lower))) | (4 * marks >= line_words)
    sentence = _last_bytes(buf, SENTENCE)
    fails |= (line_words >= ENDLESS) & (_sums(sentence, cuts) == 0)
    ended = sentence | _last_bytes(buf, CLOSING)
    some = np.flatnonzero(has)
    brief = (line_words[some] < BRIEF) & ~ended[ends[first_word[1:][some] - 1] - 1]
    # runs of brief lines within a row
    begin = np.flatnonzero(np.concatenate([[True], (brief[1:] != brief[:-1]) | (line_row[some][1:] != line_row[some][:-1])])[: len(some)])
    run = np.diff(np.append(begin, len(some)))
    fails[some] |= brief & (np.repeat(run, run) >= MENU)
    data = buf.tobytes()
    for m in _PHRASES.finditer(data):
        k = np.searchsorted(cuts, m.start(), "right") - 1
        fails[k] |= m.end() <= line_end[k]
    # equal to an earlier line of the row
    key = span_hashes(buf, line_start, line_end, _LINES) ^ mix64(line_row.astype(_U) + _U(1))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    # lines without a word are never repeats; they hash alike only with each other or with themselves
    again &= has
    fails = (fails | again) & has

    repeat = np.zeros(len(words), np.int64)
    row = np.repeat(np.arange(rows), n_words)
    window = np.flatnonzero(np.arange(len(words)) + WINDOW <= first[1:][row]) if len(words) else np.zeros(0, np.int64)
    if len(window):
        key = runs_hashes(words, WINDOW)[window] ^ mix64(row[window].astype(_U) + _U(1))
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        twice = window[n[at] > 1]
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, twice, 1)
        np.add.at(step, twice + WINDOW, -1)
        repeat = np.cumsum(step[:-1]) > 0
    by_row = lambda v: np.bincount(line_row, v, rows).astype(np.int64)
    out = {
        "n_words": n_words, "word_chars": by_row(chars), "n_symbols": by_row(symbols), "n_dup_lines": by_row(again),
        "n_repeat_words": _sums(repeat, first), "n_lines": by_row(has), "n_failed_lines": by_row(fails), "lost_chars": by_row(chars * fails),
    }
    return out, line_start, line_end, fails


def _run(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            for i, j, buf, offs in text_steps(col):
                counts, start, end, fails = measure(buf, offs)
                cols = [c.slice(i, j - i) for c in batch.columns[:-1]] + [pa.array(counts[c]) for c in _COUNTS]
                names = batch.schema.names[:-1] + _COUNTS
                if with_text:
                    data, texts = buf.tobytes(), []
                    upto = np.concatenate([[0], np.cumsum(1 + np.diff(np.searchsorted(np.flatnonzero(buf == 10), offs)))]).tolist()
                    for a, b in zip(upto[:-1], upto[1:]):
                        texts.append(b"\n".join(data[start[k] : end[k]] for k in range(a, b) if not fails[k]).decode("utf-8", "replace"))
                    cols.append(pa.array(texts, pa.string())), names.append("clean_text")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED, most_lost: int = MOST_LOST, with_text: bool = False) -> DataFrame:
    """Per document: the id, the counts, base_failed, kept (and clean_text where asked for)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", clean_text string" * with_text
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    lost = 100 * F.col("lost_chars") > most_lost * F.col("word_chars")
    out = rows.mapInArrow(_run(with_text), kinds).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & ~lost).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are kept, with all columns, their failing lines removed from the text."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    order = [n for n in names if n != at[text_col]]
    flat = docs.toDF(*names).withColumn(at[text_col], F.col(at[text_col]).cast("string"))
    kinds = dict(flat.dtypes)
    whole = flat.select(*order, at[text_col]).mapInArrow(_run(True), ", ".join(f"{n} {kinds[n]}" for n in order) + ", " + ", ".join(f"{c} long" for c in _COUNTS) + ", clean_text string")
    min_words, most_repeated, most_lost = (options.get(k, d) for k, d in (("min_words", MIN_WORDS), ("most_repeated", MOST_REPEATED), ("most_lost", MOST_LOST)))
    good = (F.col("n_words") >= min_words) & (100 * F.col("n_repeat_words") <= most_repeated * F.col("n_words")) & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars"))
    return whole.where(good).select(*[F.col("clean_text" if c == text_col else n).alias(c) for c, n in at.items()])
