"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; rows of one language form a tree of runs of eight, and the roots of these trees form one more.  A node's label is (level, index), so
children come before their parent.  Digests go up through a priority queue ordered by label: a node's message waits there until its parent is the least
label.  The queue is external: the part that stays inside a block of 512 neighbouring nodes is a heap in a task, what leaves the block is a row of the next
table, keyed by its receiver.  A reversed sweep, greatest label first, delivers to every child the digests beside its path, until each leaf has its proof.

A round takes three levels of all trees at once; the rounds are as many as the largest tree has levels, divided by three.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

RUN = 8
HEIGHT = 3
BLOCK = RUN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# ---- columns ------------------------------------------------------------------------------------------------------------

def leaf_digest(text: Column | None = None) -> Column:
    """sha256 (hex) of the fields in order: `-` for null, else the UTF-8 byte count, a colon and the value."""
    parts = []
    for name in FIELDS:
        value = F.col(name).cast("string") if name != "text" or text is None else text
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def folded(leaf: Column, before: Column, after: Column) -> Column:
    """The root that ``leaf`` leads to along a proof."""
    return F.aggregate(F.arrays_zip(before.alias("before"), after.alias("after")), leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def proof_digest(before: Column, after: Column) -> Column:
    """sha256 (hex) of all digests of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), ""), 256)


# ---- sweeps inside a block ----------------------------------------------------------------------------------------------

def climb(digests: list[str], total: int) -> list[list[str]]:
    """Digests of a block level by level, its own first; ``total`` nodes are on that level of the whole tree.  A tree ends at its only node."""
    levels, sizes = [digests], [total]
    queue = [(1, k // RUN, k, d) for k, d in enumerate(digests)]  # (level and index of the receiver, sender, digest)
    while queue:
        level, index = queue[0][:2]
        if level > HEIGHT or sizes[level - 1] <= 1:
            break
        if level == len(levels):
            levels.append([])
            sizes.append(-(-sizes[-1] // RUN))
        digest = sha256()
        while queue and queue[0][:2] == (level, index):
            digest.update(heapq.heappop(queue)[3].encode())
        levels[level].append(digest.hexdigest())
        heapq.heappush(queue, (level + 1, index // RUN, index, levels[level][-1]))
    return levels


def descend(levels: list[list[str]], before: list[str], after: list[str]) -> Iterator[tuple[int, list[str], list[str]]]:
    """(place in the block, digests left of the path, digests right of it, level by level) for every node of the lowest level, given those of the top."""
    queue = [(1 - len(levels), 0, before, after)]  # the greatest level first
    while queue:
        level, place, b, a = heapq.heappop(queue)
        if not level:
            yield place, b, a
            continue
        kids = levels[-level - 1][place * RUN: (place + 1) * RUN]
        for k in range(len(kids)):
            heapq.heappush(queue, (level + 1, place * RUN + k, ["".join(kids[:k]), *b], ["".join(kids[k + 1:]), *a]))


def _up(block: pa.Table) -> pa.Table:
    rows = block.sort_by("idx")
    total = rows.column("total")[0].as_py()
    top = climb(rows.column("digest").to_pylist(), total)[-1]
    return pa.table({"tree": rows.column("tree")[:1], "idx": pa.array([rows.column("idx")[0].as_py() // BLOCK], pa.int64()), "total": pa.array([-(-total // BLOCK)], pa.int64()), "digest": top})


def _down(block: pa.Table, above: pa.Table) -> pa.Table:
    rows = block.sort_by("idx")
    levels = climb(rows.column("digest").to_pylist(), rows.column("total")[0].as_py())
    found = list(descend(levels, above.column("before")[0].as_py(), above.column("after")[0].as_py()))
    strings = pa.list_(pa.string())
    return pa.table({"tree": rows.column("tree"), "idx": rows.column("idx"), "before": pa.array([b for _, b, _ in found], strings), "after": pa.array([a for _, _, a in found], strings)})


# ---- forests --------------------------------------------------------------------------------------------------------------

def roots_and_rounds(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """nodes: tree, idx, total, digest.  (tree, digest) of every tree's root, and the node tables of the rounds for the way back."""
    block = F.floor(F.col("idx") / BLOCK).alias("block")
    rounds, ended = [nodes], nodes.where("total = 1")
    while not rounds[-1].where("total > 1").isEmpty():
        rounds.append(stored(rounds[-1].where("total > 1").groupBy("tree", block).applyInArrow(_up, "tree string, idx long, total long, digest string"), "merkle-up"))
        ended = ended.unionByName(rounds[-1].where("total = 1"))
    return ended.select("tree", "digest"), rounds


def proofs(rounds: list[DataFrame], of_roots: DataFrame | None = None) -> DataFrame:
    """(tree, idx, before, after) for every node of the first round; ``of_roots`` (tree, before, after) is what goes on above each root."""
    none = F.array().cast("array<string>")
    below = None
    for nodes in reversed(rounds):
        ended = nodes.where("total = 1").select("tree", "idx")
        ended = ended.join(of_roots, "tree") if of_roots is not None else ended.select("tree", "idx", none.alias("before"), none.alias("after"))
        if below is not None:
            open_ = nodes.where("total > 1").withColumn("block", F.floor(F.col("idx") / BLOCK))
            swept = open_.groupBy("tree", "block").cogroup(below.withColumnRenamed("idx", "block").groupBy("tree", "block")).applyInArrow(
                _down, "tree string, idx long, before array<string>, after array<string>")
            ended = ended.unionByName(swept)
        below = ended if nodes is rounds[0] else stored(ended, "merkle-down")
    return below


def manifest(docs: DataFrame, **carried: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, before and after (the proof: digests left and right of the path, leaf first), and the ``carried`` columns for every row.

    A null field counts as `-`; a null language is a tree of its own and the first one; null ids come first in their tree.  Rows that share language and id
    follow by their leaf digest, and wholly equal rows take consecutive places.  An empty table gives no rows; a single row is leaf, subroot and root at
    once with an empty proof.  Columns other than the five fields are not read unless carried.
    """
    c = F.col
    tree = F.coalesce(F.concat(F.lit("="), c("lang")), F.lit(""))  # null before every language, also before the empty one
    leaves = stored(docs.select("doc_id", tree.alias("tree"), leaf_digest().alias("digest"), *[v.alias(k) for k, v in carried.items()]), "merkle-leaves")
    leaves = stored(numbered(leaves, ["tree"], ["doc_id", "digest"], "merkle-order"), "merkle-nodes")
    own, rounds = roots_and_rounds(leaves.select("tree", "idx", "total", "digest"))
    own = stored(own, "merkle-subroots")
    tops = stored(numbered(own.select(F.lit("").alias("tree"), c("tree").alias("member"), "digest"), ["tree"], ["member"], "merkle-tops"), "merkle-tops")
    root, top_rounds = roots_and_rounds(tops.select("tree", "idx", "total", "digest"))
    first = root.first()
    above = proofs(top_rounds).join(tops.select("idx", "member"), "idx").select(c("member").alias("tree"), "before", "after")
    above = stored(above, "merkle-above")
    paths = proofs(rounds, above)
    out = leaves.join(paths, ["tree", "idx"]).join(own.select("tree", c("digest").alias("subroot")), "tree")
    return out.select("doc_id", c("digest").alias("leaf"), "subroot", F.lit(first.digest if first else None).cast("string").alias("root"), "before", "after", *carried)


def tampered_leaf() -> Column:
    """The leaf of a row whose text lost its capitals A-Z where 3 divides the unsigned crc32 of the decimal id, else the leaf as it is; a null id is left alone."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return leaf_digest(F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text")))
