"""A Merkle manifest of a dataset: a leaf for each row, a tree for each group, a root over the groups' roots.

H is the sha256 of its inputs end to end as 64 lowercase hex digits, digests counting as such text. A leaf is H of the
row's columns, each `-` where null, else its length in UTF-8 bytes, a colon and the value. In a group, rows ascend by id; while several
nodes remain, each run of `fanout` consecutive ones (the last may be shorter, one node even) becomes their H.
The groups' roots, null first and then by UTF-8 bytes, become the root in the same way.

Leaves are made by Spark's functions; from then on only digests travel. Places in a group come from a range partitioned
sort and the counts of each partition. Nodes are dealt into aligned blocks of `block` consecutive places. In a block the
digests are one contiguous matrix of bytes with 64 columns; a level is that matrix with `fanout` digests a row, hashed row
by row, and the siblings of place i at level l follow from i // fanout^l alone. A block's root is a node of the next round,
which has `block` times fewer. On the way down every block meets the path of its own root; proofs are hashed, and
the presented leaf is folded with the siblings up to a root.

A large group is many blocks, a task holds a few of them, and nothing but one number a round reaches the driver.

Defined cases: nulls are values of their own in leaves, a null group is a group of its own and comes first; texts of any
length are hashed whole by Spark; rows that repeat an id (null first) follow by leaf, rows that repeat altogether are
leaves of their own; a group with one row has its leaf as root; one group's root is the root; an empty table gives an empty
result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import _buffers, written

COLUMNS, FANOUT, BLOCK, BROADCAST_ROWS = ("doc_id", "source", "lang", "n_chars", "text"), 2, 4096, 1_000_000
_POSITION = (1 << 33) - 1  # the place in its partition, in monotonically_increasing_id()
_PATH = "lefts array<string>, rights array<string>, root string, subroot string"


def leaf(columns: Sequence[Column]) -> Column:
    """H of the columns."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


# ------------------------------------------------------------------ digest matrices


def _hashed(data: bytes, width: int) -> np.ndarray:
    """H of each `width` bytes, as a matrix with 64 columns."""
    sha = hashlib.sha256
    return np.frombuffer("".join([sha(data[i : i + width]).hexdigest() for i in range(0, len(data), width)]).encode(), np.uint8).reshape(-1, 64)


def level_up(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The digests of runs of `fanout` rows, the last of which may be shorter."""
    full = len(nodes) // fanout * fanout
    runs = _hashed(nodes[:full].reshape(-1, 64 * fanout).tobytes(), 64 * fanout)
    return np.concatenate([runs, _hashed(nodes[full:].tobytes(), 64 * (len(nodes) - full))]) if full < len(nodes) else runs


def depth(size: int, fanout: int, block: int) -> int:
    """Levels that a block of a group of that many nodes has: until one node is left, or until blocks are."""
    levels, width = 0, 1
    while width < min(size, block):
        levels, width = levels + 1, width * fanout
    return levels


def levels(nodes: np.ndarray, size: int, fanout: int, block: int) -> list[np.ndarray]:
    out = [nodes]
    for _ in range(depth(size, fanout, block)):
        out.append(level_up(out[-1], fanout))
    return out


def siblings(tree: list[np.ndarray], fanout: int) -> list[tuple[list[bytes], list[bytes]]]:
    """For each level but the last, the siblings before and after the node above each place of the lowest."""
    out, place = [], np.arange(len(tree[0]))
    for nodes in tree[:-1]:
        first = place // fanout * fanout
        run = np.minimum(fanout, len(nodes) - first)
        left, right = [b""] * len(place), [b""] * len(place)
        for at in range(fanout):
            for n in range(at + 1, fanout + 1):
                rows = np.flatnonzero((place - first == at) & (run == n))
                for side, steps in ((left, range(at)), (right, range(at + 1, n))):
                    if len(rows) and len(steps):
                        joined, w = np.hstack([nodes[first[rows] + k] for k in steps]).tobytes(), 64 * len(steps)
                        for i, r in enumerate(rows.tolist()):
                            side[r] = joined[i * w : i * w + w]
        out.append((left, right))
        place = place // fanout
    return out


def fold(digests: list[bytes], path: list[tuple[list[bytes], list[bytes]]]) -> list[bytes]:
    """Each digest hashed with its siblings, level by level."""
    sha = hashlib.sha256
    for left, right in path:
        digests = [sha(a + x + b).hexdigest().encode() for a, x, b in zip(left, digests, right)]
    return digests


# ------------------------------------------------------------------ tasks


def _sorted_group(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A block's nodes in order, and their digests."""
    table = table.sort_by("place").combine_chunks()
    data, offs = _buffers(table["digest"].chunk(0))
    return table, data.reshape(len(offs) - 1, 64)


def _climb(fanout: int, block: int):
    def run(table: pa.Table) -> pa.Table:
        table, nodes = _sorted_group(table)
        size, g, blk = table["size"][0].as_py(), table["g"][0].as_py(), table["blk"][0].as_py()
        top = levels(nodes, size, fanout, block)[-1].tobytes().decode()
        return pa.table({"g": [g], "place": pa.array([blk], pa.int64()), "size": pa.array([-(-size // block)], pa.int64()), "digest": [top]})

    return run


def _paths(table: pa.Table, above: pa.Table, fanout: int, block: int):
    table, nodes = _sorted_group(table)
    inner = siblings(levels(nodes, table["size"][0].as_py(), fanout, block), fanout)
    lefts, rights = ([x.encode() for x in above[c][0].as_py()] for c in ("lefts", "rights"))
    return table, nodes, inner, list(zip(lefts, rights)), above["root"][0].as_py(), above["subroot"][0].as_py()


def _descend(fanout: int, block: int):
    """Nodes with their paths."""

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table, nodes, inner, upper, root, subroot = _paths(table, above, fanout, block)
        n = len(nodes)
        side = lambda k: [[level[k][i].decode() for level in inner] + [u[k].decode() for u in upper] for i in range(n)]
        kind = pa.list_(pa.string())
        return pa.table({"g": table["g"], "place": table["place"], "digest": table["digest"], "lefts": pa.array(side(0), kind), "rights": pa.array(side(1), kind), "root": [root] * n, "subroot": pa.array([subroot] * n, pa.string())})

    return run


def _prove(fanout: int, block: int, with_proofs: bool):
    """Leaves with subroot, root, proof and what the presented leaf folds to."""

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table, nodes, inner, upper, root, subroot = _paths(table, above, fanout, block)
        n, tail, sha = len(nodes), b"".join(a + b for a, b in upper), hashlib.sha256
        proofs = [b"".join(x) for x in zip(*[side for level in inner for side in level])] if inner else [b""] * n
        tops = fold([x.encode() for x in table["presented"].to_pylist()], inner)
        distinct = list(set(tops))
        # above the block all have the same siblings
        ends = dict(zip(distinct, fold(distinct, [([a] * len(distinct), [b] * len(distinct)) for a, b in upper])))
        out = {"id": table["id"], "leaf": table["digest"], "subroot": [subroot] * n, "root": [root] * n}
        out["proof_sha256"] = [sha(p + tail).hexdigest() for p in proofs]
        out["folded_root"] = [ends[t].decode() for t in tops]
        if with_proofs:
            kind = pa.list_(pa.string())
            for k, name in enumerate(("lefts", "rights")):
                out[name] = pa.array([[level[k][i].decode() for level in inner] + [u[k].decode() for u in upper] for i in range(n)], kind)
        return pa.table(out)

    return run


# ------------------------------------------------------------------ the tree


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds place (from 0) and size of the group g to rows, in the order of the named columns, nulls first.

    Rows are sorted within ranges; what lies before a range in its group comes from the counts of the ranges."""
    keys = [F.asc_nulls_first(c) for c in ("g", *order)]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION))}), "ordered")
    counts = rows.groupBy("g", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    w = Window.partitionBy("g")
    counts = written(counts.select("g", "_part", (F.sum("n").over(w.orderBy("_part")) - F.col("n") - F.col("first")).alias("_shift"), F.sum("n").over(w).alias("size")), "counts")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    return rows.join(counts, ["g", "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _blocked(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("blk", F.floor(F.col("place") / block))


def _climbed(nodes: DataFrame, fanout: int, block: int) -> list[DataFrame]:
    """The nodes and, round by round, the roots of their blocks, until each group has one."""
    out = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 1
    while most > 1:
        climbed = _blocked(out[-1].select("g", "place", "size", "digest"), block).groupBy("g", "blk").applyInArrow(_climb(fanout, block), "g string, place long, size long, digest string")
        out.append(written(climbed, "roots"))
        most = -(-most // block)
    return out


def _meet(nodes: DataFrame, above: DataFrame, block: int):
    """Blocks with the paths of their roots."""
    return _blocked(nodes, block).groupBy("g", "blk").cogroup(above.withColumnRenamed("place", "blk").groupBy("g", "blk"))


def _descended(rounds: list[DataFrame], above: DataFrame, fanout: int, block: int) -> DataFrame:
    """The paths of the roots of the lowest blocks, from those of the groups' roots."""
    for nodes in rounds[-2:0:-1]:
        above = _meet(nodes, above, block).applyInArrow(_descend(fanout, block), f"g string, place long, digest string, {_PATH}")
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: Sequence[str] = COLUMNS, presented: dict[str, Column] | None = None, fanout: int = FANOUT, block: int = BLOCK, with_proofs: bool = False) -> DataFrame:
    """Per row: its id, leaf, subroot, root, proof_sha256, folded_root and verified; with_proofs adds lefts and rights, the
    siblings before and after it at each level. `presented` names columns whose values a verifier is shown in place of
    the row's own: folded_root is what their leaf folds to."""
    if fanout < 2 or block < fanout or fanout ** depth(block, fanout, block) != block:
        raise ValueError(f"block must be a power of fanout above 1, not {block} with {fanout}")
    own, shown = [F.col(c) for c in columns], [(presented or {}).get(c, F.col(c)) for c in columns]
    # a null group comes first; "1" before a value keeps the order of the values
    group = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    rows = docs.select(F.col(id_col).alias("id"), group.alias("g"), leaf(own).alias("digest"), leaf(shown).alias("presented"))
    kind = dict(rows.dtypes)["id"]
    rounds = _climbed(written(numbered(rows.withColumn("row", F.monotonically_increasing_id()), ["id", "digest", "row"]).drop("row"), "leaves"), fanout, block)
    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")
    tops = _climbed(written(numbered(subroots, ["of"]), "subroots"), fanout, block)
    nothing = F.array().cast("array<string>")
    start = tops[-1].select("g", "place", "digest", nothing.alias("lefts"), nothing.alias("rights"), F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"))
    if len(tops) > 1:
        start = _meet(tops[0].select("g", "place", "size", "digest"), _descended(tops, start, fanout, block), block).applyInArrow(_descend(fanout, block), f"g string, place long, digest string, {_PATH}")
    names = tops[0].select(F.col("of"), "place")
    above = start.join(names, "place").select(F.col("of").alias("g"), F.lit(0).cast("long").alias("place"), "digest", "lefts", "rights", "root", F.col("digest").alias("subroot"))
    above = written(above, "paths")
    if len(rounds) > 1:
        above = _descended(rounds, above, fanout, block)
    more = ["lefts", "rights"] if with_proofs else []
    out = _meet(rounds[0], above, block).applyInArrow(
        _prove(fanout, block, with_proofs), f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + "".join(f", {c} array<string>" for c in more)
    )
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *more)
