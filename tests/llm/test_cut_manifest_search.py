"""Concatenate and cut, the Merkle manifest and ranked search against plain code, and on odd rows."""

import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termlift.llm import concat_cut, merkle_manifest, queries, ranked_search
from termlift.llm._shared import SPACES, text_parts

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, part string, rank string, score string, place string, g string"
SAME = "the same words in this text appear again and again without any change at all"
LONG = " ".join(f"Word{i} naïve" + "'s," * (i % 7 == 0) for i in range(60_000))
STRANGE = "a\x0bb\x1cc   İstanbul ΣΑΣ é don't <|endoftext|> x<|startoftext|>y 12 日本語\U0001f600 ́ \x85 it's"


def odd_rows():
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 3), (4, LONG, "en", "b", None), (5, SAME, "en", "b", 1), (6, SAME, "de", None, 1)]
    rows += [(6, SAME, "de", None, 1), (None, SAME, "de", "c", 1), (7, STRANGE, "ja", "c", 1), (8, "12345 !!! ---", None, "c", 1), (9, "x" * 1_500_000, "xx", "", 2)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r + (None, "x", None, "y", None, "z") for r in odd_rows()], DOCS).repartition(3)


# ------------------------------------------------------------------ concatenate and cut


@functools.cache
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(concat_cut.vocabulary())


def plain_ids(text):
    return plain_tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def check_cut(rows, docs, length=2048):
    """rows: pieces with ids; docs: [(id, text)]. Every id in one piece, every sequence but the last full and without gaps."""
    want = collections.Counter((i, tuple(plain_ids(t))) for i, t in docs)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and 0 < r.length <= length
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.sequence_id * length + r.offset - r.start].append(r)
    got = collections.Counter()
    for parts in by_doc.values():
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]] and sum(r.length for r in parts) == parts[0].doc_tokens
        assert [r.cut_before for r in parts] == [False] + [True] * (len(parts) - 1) and [r.cut_after for r in parts] == [True] * (len(parts) - 1) + [False]
        got[parts[0].doc_id, tuple(i for r in parts for i in np.frombuffer(r.ids, "<u4").tolist())] += 1
    assert got == want
    for s, parts in by_seq.items():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        assert s == max(by_seq) or sum(n for _, n in parts) == length
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_cut_of_the_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = concat_cut.concatenate(docs.repartition(7), with_ids=True)
    check_cut(rows.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    n = rows.agg(F.max("sequence_id")).first()[0] + 1
    assert concat_cut.boundaries(rows).count() == n


def test_cut_of_odd_rows(odd):
    check_cut(concat_cut.concatenate(odd, length=64, with_ids=True).collect(), [(r[0], r[1]) for r in odd_rows()], 64)
    assert concat_cut.concatenate(odd.limit(0)).count() == 0


def test_parts_of_texts_have_the_ids_of_the_whole():
    texts = [STRANGE, "<|endoftext|><|endoftext|>", " <|endoftext|> ", "a<|endoftext|>", "'S 'LL can'T", "Å̇ 힣ᆨ", "", "  ", "ﬁ ½ ²³ ǅ ß ẞ", "a‍b", "\t\x00\x7f", "Über×Straße÷2, ÉCOLE-12ab34 İx H̱ l'été \'tis a'S <b> a_b%", "x\x85y\xa0z ŁÓDŹ ŉ ſ"]
    encoder = concat_cut.PartEncoder(concat_cut.vocabulary(), most=4)
    for _ in range(2):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        ids, counts = encoder.encode(data, offs)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain_ids(t)[:-1] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAzéÉßİ×÷ıſŉ12'’<|>.-_ \n\t\u0301\u0331\x85\xa0\u2028ΣK日H"), max_size=30), min_size=1, max_size=6))
def test_parts_of_any_texts_have_the_ids_of_the_whole(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, counts = concat_cut.encoder(concat_cut.vocabulary()).encode(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain_ids(t)[:-1] for t in texts]


def test_a_vocabulary_that_keeps_white_space_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        concat_cut.PartEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_parts_of_a_long_row_are_cut_between_words():
    texts = ["ab cd", "x" * 50 + " yy " + "z" * 30, None, "w " * 40, "v" * 45]
    for most in (1, 7, 16, 1000):
        got, row = collections.defaultdict(bytes), []
        for i, j, data, offs, whole in text_parts(pa.array(texts), SPACES, most):
            assert j == i + 1 or whole
            for k in range(i, j):
                got[k] += data[offs[k - i] : offs[k - i + 1]].tobytes()
            assert whole or SPACES[data[-1]]
            row += [i] * whole
        assert [got[k].decode() for k in range(5)] == [t or "" for t in texts] and len(set(row)) == len(row)


def test_places_run_on_over_many_partitions(spark):
    rows = spark.range(2000).select((F.col("id") % 50).cast("int").alias("part"), (F.col("id") % 7 + 1).alias("doc_tokens"))
    got = {r.part: r.before for r in concat_cut.offsets(rows, wide=8).collect()}
    at = 0
    for p in range(50):
        assert got[p] == at
        at += sum(i % 7 + 1 for i in range(p, 2000, 50))


# ------------------------------------------------------------------ manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def plain_path(tree, i, fanout):
    path = []
    for nodes in tree[:-1]:
        first = i // fanout * fanout
        path.append((nodes[first:i], nodes[i + 1 : first + fanout]))
        i //= fanout
    return path


def plain_manifest(rows, fanout, tampered):
    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        own = plain_leaf(doc_id, source, lang, n_chars, text)
        shown = plain_leaf(doc_id, source, lang, n_chars + 1, text) if tampered(doc_id) and n_chars is not None else own
        groups[lang].append((doc_id is not None, doc_id or 0, own, shown, doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names], fanout)
    out = []
    for g in names:
        for i, (_, _, own, shown, doc_id) in enumerate(sorted(groups[g])):
            path = plain_path(trees[g], i, fanout) + plain_path(top, names.index(g), fanout)
            now = shown
            for left, right in path:
                now = digest(*left, now, *right)
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], digest(*[d for left, right in path for d in left + right]), now, now == top[-1][0]))
    return sorted(out, key=str)


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def shown():
    return {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


@pytest.mark.parametrize("fanout,block", [(2, 4), (3, 9), (2, 4096)])
def test_manifest_against_plain_code(spark, fanout, block):
    """Groups from one leaf to several rounds of blocks, one of them with a third of the rows, more groups than a block."""
    rows = [(i, f"text {i} é", None if i % 50 == 0 else "big" if i % 3 else f"g{i % 37}é", "s", None if i % 11 == 0 else i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = merkle_manifest.manifest(docs, presented=shown(), fanout=fanout, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows, fanout, tampered)


@pytest.mark.parametrize("n", [1, 16, 65])
def test_sizes_about_a_block(spark, n):
    rows = [(i, str(i), "x", None, 1) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle_manifest.manifest(docs, presented=shown(), fanout=2, block=16)
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows, 2, tampered)


def test_manifest_of_odd_rows(odd):
    got = merkle_manifest.manifest(odd, presented=shown(), block=4, with_proofs=True)
    rows = got.collect()
    assert sorted([tuple(r)[:7] for r in rows], key=str) == plain_manifest(odd_rows(), 2, tampered)
    for r in rows:
        now = r.leaf
        for left, right in zip(r.lefts, r.rights):
            now = digest(left, now, right)
        assert now == r.root and digest(*[x for pair in zip(r.lefts, r.rights) for x in pair]) == r.proof_sha256
    assert merkle_manifest.manifest(odd.limit(0), presented=shown()).count() == 0


def test_a_block_is_a_power_of_the_fanout(odd):
    with pytest.raises(ValueError, match="power"):
        merkle_manifest.manifest(odd, fanout=3, block=8)


# ------------------------------------------------------------------ search


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_search(docs, items, k=10):
    counted = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    df = collections.Counter(t for _, c in counted for t in c)
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in counted:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_search_of_the_table(spark):
    docs, items = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    for window, block_bytes in ((8192, 1 << 24), (7, 1000)):
        got = ranked_search.search(docs.repartition(3), items, window=window, block_bytes=block_bytes)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_of_odd_rows(spark, odd):
    items = [(1, SAME), (1, SAME), (None, "WORD77 12345"), (2, None), (3, "?!"), (4, "nothing holds these0 terms0"), (5, "the the THE text " + "x" * 1_500_000), (6, STRANGE), (7, "")]
    table = spark.createDataFrame([(*x, "a", 1) for x in items], "item_id long, text string, doc_id string, score long")
    got = ranked_search.search(odd, table, k=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search([(r[0], r[1]) for r in odd_rows()], items, 3)
    assert ranked_search.search(odd.limit(0), table).count() == 0 == ranked_search.search(odd, table.limit(0)).count()


def test_ties_beyond_a_window_go_by_id(spark):
    """More equal scores than places, in every window."""
    docs = spark.createDataFrame([((i * 37) % 500, "apple pear" if i % 2 else "apple") for i in range(500)], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "apple"), (2, "pear apple pear")], "item_id long, text string")
    got = ranked_search.search(docs, items, window=16)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search([(r.doc_id, r.text) for r in docs.collect()], [(1, "apple"), (2, "pear apple pear")])


def test_all_thirteen_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.queries()}
