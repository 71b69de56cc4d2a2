"""Language identification with interpolated Kneser-Ney character models, one per language.

Text is lower-cased, everything but letters becomes a space, runs of spaces one. A model of order 5 is
trained for each language on at most `per_lang` labelled documents (those with the smallest hash of their
id; of a document longer than `longest` characters its first ones, so the sample has a proven bound). The n-grams
of all languages lie in one sorted array of hashes for each order, with the interpolated log probability and
the back-off weight of each language beside them. Looking up an n-gram is one search for all languages.

A text's language is the one with the lowest cross-entropy per character over the whole text. The score is
the softmax of the negated cross-entropies at a temperature calibrated on documents that were kept out of the
counts. A text is rejected if it has no letter, or if its cross-entropy h is too far above that of its language's
kept-out documents: (h - middle) / sqrt(a^2 + b^2 / length) above a limit, where middle is the language's median,
and a and b, fitted on all languages' kept-out documents (b larger where a language's own need it), are how much documents
and characters differ. The limit is the value that `reject_rate` of the kept-out documents exceed, the tail above their
1 - `tail` quantile being taken as exponential, and more where they are few. Of a language with too few documents the ends of their texts are kept
out instead. At most `most_langs` languages are learned, those with the most documents.

Defined cases: null, empty or letterless text is `und` with score 0 and rejected; ties go to the first
language by name; rows with a null label are not learned from; without any labelled row every text is `und`;
rows that repeat an id are predicted alike for equal texts; texts of any length are read whole; an empty table gives an
empty result; further columns, whatever their names, are ignored by `predict` and kept by `accepted`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import few_rows, mix64

_U = np.uint64
ORDER, PER_LANG, LONGEST, MOST_LANGS, CALIBRATION, REJECT_RATE, TAIL, FEW, STEP_CHARS = 5, 400, 20_000, 400, 0.25, 0.0001, 0.1, 20, 1 << 16
UNKNOWN, _PAD, _SPACE = "und", 1, 32
_P = _U(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 pads; where each begins; its number of letters."""
    letter, pads = _is_letter(), ORDER - 1
    low = [t.lower() for t in texts]
    raw = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(t) for t in low], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    good = letter[raw]
    total = np.concatenate([[0], np.cumsum(good)])
    n_letters = total[begin[1:]] - total[begin[:-1]]
    out = np.full(len(raw) + pads * len(texts), _PAD, np.uint32)
    out[np.arange(len(raw)) + pads * (np.repeat(np.arange(len(texts)), size) + 1)] = np.where(good, raw, _SPACE)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _SPACE) | (out[:-1] >= 33)
    at = begin[:-1] + pads * np.arange(len(texts))
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[np.append(at, len(out))], n_letters


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For each order n, a hash of the n characters that end at each position."""
    out, total = [], np.zeros(len(codes), _U)
    c, power = codes.astype(_U) + _U(1), 1
    for n in range(1, ORDER + 1):
        if n <= len(c):
            total[n - 1 :] += c[: len(c) - n + 1] * _U(power)
        out.append(mix64(total + _U(n)))
        power = power * int(_P) % (1 << 64)
    return out


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # per order, sorted hashes
    logp: list[np.ndarray]  # per order, (n-grams, languages)
    back: list[np.ndarray]  # per order, log back-off of the n-gram as a context
    floor: float
    begin: np.ndarray | None = None  # (length of the context, languages), log back-off of the pads before a text as a context
    temperature: float = 1.0
    middle: np.ndarray | float = np.inf  # per language, the median cross-entropy of kept-out documents
    spread: tuple[float, np.ndarray | float] = (0.0, 0.0)  # a, and per language b
    limit: float = 0.0
    starts: list | None = None

    def find(self, n: int, h: np.ndarray) -> np.ndarray:
        """Index in the table of order n + 1, or -1: the start of the hash's bucket, then a few steps."""
        keys = self.keys[n]
        if not len(keys):
            return np.full(len(h), -1)
        if self.starts is None:
            self.starts = [None] * len(self.keys)
        if self.starts[n] is None:
            bits = max(1, min(22, int(len(keys)).bit_length() + 1))
            edge = np.searchsorted(keys >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=_U)).astype(np.int32)
            self.starts[n] = (bits, edge, int(np.diff(edge).max()))
        bits, edge, most = self.starts[n]
        bucket = (h >> _U(64 - bits)).astype(np.int64)
        at, end = edge[bucket].astype(np.int64), edge[bucket + 1]
        found = np.full(len(h), -1)
        live = np.arange(len(h))
        for step in range(most):
            live = live[at[live] + step < end[live]]
            if not len(live):
                break
            hit = keys[at[live] + step] == h[live]
            found[live[hit]] = at[live[hit]] + step
            live = live[~hit]
        return found

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text and language, nats per character; the texts' lengths so encoded; their letters."""
        codes, begin, letters = encode(texts)
        hashes = gram_hashes(codes)
        length = np.diff(begin) - (ORDER - 1)
        rest = np.flatnonzero(codes != _PAD)
        owner = np.searchsorted(begin, np.arange(len(codes)), "right") - 1
        total = np.zeros((len(texts), len(self.langs)))

        def add(pos: np.ndarray, values: np.ndarray) -> None:
            for j in range(values.shape[1]):
                total[:, j] += np.bincount(owner[pos], values[:, j], len(texts))

        for n in range(ORDER - 1, -1, -1):
            at = self.find(n, hashes[n][rest])
            hit = at >= 0
            add(rest[hit], self.logp[n][at[hit]])
            rest = rest[~hit]
            if not len(rest):
                break
            if n:
                at = self.find(n - 1, hashes[n - 1][rest - 1])
                add(rest[at >= 0], self.back[n - 1][at[at >= 0]])
                first = rest[codes[rest - 1] == _PAD]
                add(first, np.broadcast_to(self.begin[n - 1], (len(first), len(self.langs))))
        if len(rest):
            add(rest, np.full((len(rest), len(self.langs)), self.floor))
        return -total / np.maximum(length, 1)[:, None], length, letters

    def excess(self, h: np.ndarray, length: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """How far a cross-entropy is above the middle of its language, in its spread at that length."""
        middle, b = (np.broadcast_to(x, len(self.langs))[lang] for x in (self.middle, self.spread[1]))
        return (h - middle) / np.sqrt(self.spread[0] ** 2 + b**2 / np.maximum(length, 1) + 1e-12)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: und), score, cross-entropy, rejected."""
        h, length, letters = self.cross_entropy(texts)
        best = h.argmin(1)
        low = h.min(1)
        score = 1 / np.exp(np.clip((low[:, None] - h) / self.temperature, -700, 0)).sum(1)
        none = letters == 0
        bad = none | (self.excess(low, length, best) > self.limit)
        return np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, 0.0, low), bad


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: n-gram, its context (one shorter, from the left), its tail (from the right), count."""
    codes, _, _ = encode(texts)
    hashes = gram_hashes(codes)
    pos = np.flatnonzero(codes != _PAD)
    out = []
    for n in range(ORDER):
        h = hashes[n][pos]
        _, first, count = np.unique(h, return_index=True, return_counts=True)
        at = pos[first]
        out.append((h[first], hashes[n - 1][at - 1] if n else np.zeros(len(at), _U), hashes[n - 1][at] if n else np.zeros(len(at), _U), count))
    return out


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, values, len(u))


def _get(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], default)


def train(samples: dict[str, list[str]]) -> Model:
    """Models of all languages; samples: texts by language."""
    langs = sorted(samples)
    raw = [_counts(samples[lang]) for lang in langs]
    union = [np.unique(np.concatenate([r[n][0] for r in raw])) for n in range(ORDER)]
    context, tail = [], []
    for n in range(ORDER):
        every = np.concatenate([r[n][0] for r in raw])
        _, first = np.unique(every, return_index=True)
        context.append(np.concatenate([r[n][1] for r in raw])[first])
        tail.append(np.concatenate([r[n][2] for r in raw])[first])
    alphabet = max(2, len(union[0]))
    logp = [np.zeros((len(u), len(langs)), np.float32) for u in union]
    back = [np.zeros((len(u), len(langs)), np.float32) for u in union]
    pads = [h[-1:] for h in gram_hashes(np.full(ORDER - 1, _PAD, np.uint32))]
    begin = np.zeros((ORDER - 1, len(langs)))
    for j, own in enumerate(raw):
        prob: list[np.ndarray] = []
        for n in range(ORDER):
            gram, ctx, _, count = own[n]
            if n < ORDER - 1:  # continuation counts: how many different characters come before
                longer = own[n + 1]
                u, types = _sum_by(longer[2], np.ones(len(longer[2])))
                value = np.maximum(_get(u, types, gram, 0.0), 1.0)
            else:
                value = count.astype(float)
            n1, n2 = (value == 1).sum(), (value == 2).sum()
            discount = float(np.clip(n1 / max(n1 + 2 * n2, 1), 0.1, 0.95))
            u, whole = _sum_by(ctx, value)
            _, types = _sum_by(ctx, np.ones(len(ctx)))
            share = np.maximum(_get(gram, value, union[n], 0.0) - discount, 0.0)
            total = _get(u, whole, context[n], 0.0)
            weight = np.where(total > 0, discount * _get(u, types, context[n], 0.0) / np.maximum(total, 1e-9), 1.0)
            lower = np.full(len(union[n]), 1.0 / alphabet) if n == 0 else _get(union[n - 1], prob[n - 1], tail[n], 1e-9)
            p = np.where(total > 0, share / np.maximum(total, 1e-9), 0.0) + weight * lower
            prob.append(p)
            logp[n][:, j] = np.log(p)
            if n:
                back[n - 1][:, j] = np.log(_get(u, discount * types / whole, union[n - 1], 1.0))
                begin[n - 1, j] = np.log(_get(u, discount * types / whole, pads[n - 1], 1.0)[0])
    return Model(langs, union, logp, back, float(np.log(1.0 / alphabet) - 5.0), begin)


def calibrate(model: Model, samples: dict[str, list[str]], reject_rate: float = REJECT_RATE, tail: float = TAIL) -> None:
    """Set the temperature (least log loss) and what decides on rejection from documents kept out.

    A language of which none is recognized rejects nothing."""
    texts = [t for lang in model.langs for t in samples.get(lang, [])]
    truth = np.array([model.langs.index(lang) for lang in model.langs for _ in samples.get(lang, [])])
    if not len(truth):
        return
    h, length, letters = model.cross_entropy(texts)
    losses = []
    grid = np.geomspace(0.03, 2.0, 40)
    for t in grid:
        z = -(h - h.min(1, keepdims=True)) / t
        losses.append((np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    own = (h.argmin(1) == truth) & (letters > 0)  # not those with another language's label
    if not own.any():
        return
    low, length, truth = h.min(1)[own], np.maximum(length[own], 1), truth[own]
    langs = range(len(model.langs))
    model.middle = np.array([np.median(low[truth == j]) if (truth == j).any() else np.inf for j in langs])
    off = low - model.middle[truth]
    # the median of |off| at a length is about 2/3 of the spread there: b from the shorter half of the texts, a from the longer
    short = length <= np.median(length)
    size = lambda x: 1.4826 * float(np.median(np.abs(x))) if len(x) else 0.0
    a = max(size(off[~short]), 0.05)
    b = max(size((off * np.sqrt(length))[short]), 0.5)
    wide = [max(b, size((off * np.sqrt(length))[short & (truth == j)])) for j in langs]
    model.spread = (a, np.array(wide))
    z = np.sort(model.excess(low, length, truth))
    far = float(np.quantile(z, 1 - tail))
    beyond = z[z > far] - far
    scale = float(beyond.mean()) if len(beyond) else 1.0
    # few documents tell little of how far the next ones may lie
    model.limit = (far + max(scale, 0.25) * float(np.log(tail / reject_rate))) * (1 + FEW / len(z))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, longest: int = LONGEST, most_langs: int = MOST_LANGS) -> Model:
    """Train on the documents that are not held out. The sample that comes to the driver is at most
    per_lang * longest characters for each of at most most_langs languages."""
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(3), F.col(id_col)).alias("h"))
    rows = rows.withColumn("text", F.substring("text", 1, longest))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not n:
        return Model([], [], [], [], 0.0)
    # a hash below its language's bound leaves about twice per_lang documents; the window then sees only those
    bounds = few_rows(docs.sparkSession, [(lang, min(1.0, (2.0 * per_lang + 20) / count)) for lang, count in sorted(n.items())], "lang string, bound double")
    rows, bound = rows.join(F.broadcast(bounds), "lang"), F.col("bound")  # at most most_langs rows
    few = rows.where((F.shiftrightunsigned("h", 1).cast("double") / F.lit(float(1 << 63))) < bound)
    first = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= per_lang)
    train_set: dict[str, list[str]] = {}
    kept_out: dict[str, list[str]] = {}
    every = max(2, round(1 / CALIBRATION))
    for r in first.select("lang", "k", "text").orderBy("lang", "k").collect():
        if n[r["lang"]] < every:
            cut = len(r["text"]) - len(r["text"]) // every
            train_set.setdefault(r["lang"], []).append(r["text"][:cut])
            kept_out.setdefault(r["lang"], []).append(r["text"][cut:])
        else:
            (kept_out if r["k"] % every == 0 else train_set).setdefault(r["lang"], []).append(r["text"])
    for lang in kept_out:
        train_set.setdefault(lang, [])
    model = train({k: v for k, v in train_set.items() if v})
    calibrate(model, kept_out)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document: the id (and columns `keep`), lang_pred, score, cross_entropy, rejected."""
    names = [f"_c{i}" for i in range(len(keep or [id_col]))]
    picked = docs.select(*[F.col(c).alias(n) for c, n in zip(keep or [id_col], names)], F.col(text_col).cast("string").alias("_text"))
    kinds = dict(picked.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    made: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(pickle.loads(shared.value))
        m = made[0]
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            size = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
            edge = np.concatenate([[0], np.cumsum(size)])
            i = 0
            while i < len(col):
                j = max(i + 1, int(np.searchsorted(edge, edge[i] + STEP_CHARS, "right")) - 1)
                j = min(j, len(col))
                texts = [x or "" for x in col.slice(i, j - i).to_pylist()]
                if m.langs:
                    best, score, h, bad = m.predict(texts)
                else:
                    best, score, h, bad = np.full(j - i, -1), np.zeros(j - i), np.zeros(j - i), np.ones(j - i, bool)
                lang = [UNKNOWN if b < 0 else m.langs[b] for b in best]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[:-1]], pa.array(lang), pa.array(score), pa.array(h), pa.array(bad)], names=[*batch.schema.names[:-1], "lang_pred", "score", "cross_entropy", "rejected"])
                i = j

    out = picked.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep or [id_col])], "lang_pred", "score", "cross_entropy", "rejected")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text is not rejected."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    flat, at = docs.toDF(*names), docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    made: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(pickle.loads(shared.value))
        for batch in batches:
            col = batch.column(at)
            edge = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64))])
            i = 0
            while i < len(col):
                j = min(len(col), max(i + 1, int(np.searchsorted(edge, edge[i] + STEP_CHARS, "right")) - 1))
                if made[0].langs:
                    bad = made[0].predict([x or "" for x in col.slice(i, j - i).to_pylist()])[3]
                    yield batch.slice(i, j - i).filter(pa.array(~bad))
                i = j

    out = flat.mapInArrow(run, flat.schema)
    return out.toDF(*docs.columns)
