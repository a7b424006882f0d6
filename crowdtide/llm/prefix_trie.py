"""Trie of conversation prefixes, balanced parentheses per shard.

A conversation is the sequence of its turns' digests.  Sequences are sorted and dealt by range, so that a shard is a run of neighbours; inside a task its trie
is a string of parentheses in preorder.  The excess (open minus closed) is kept with minima of blocks and of blocks of blocks: ``findclose`` delimits every
subtree, the rank of leaf pairs `()` counts its leaves, and cumulative arrays over preorder give its savings.  Nodes on the path of a shard's first or
last sequence may go on in a neighbouring shard: their parts (the shared spines) are merged by key afterwards, everything else is whole at once.

Sequences are cut into bands of ``BAND`` turns and the deepest band is done first, so that a conversation of any length never meets in one row: a band's
subtrees hand their totals to one member of the node above.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored, whole

BAND = 512
SHARD_TURNS = 200_000
ENDS_ROW = 10_000
KEY = 32  # letters of a turn's digest in a path
HEADS = 6
NOTHING = sha256(b"").hexdigest()
SEGMENT = ["conv_id", "start", "path", "sizes", "ends", "x_conv", "x_children", "x_leaves", "x_saved"]
SHARD_SCHEMA = ("kind string, start string, path string, level long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, "
                "x_conv long, x_children long, x_leaves long, x_saved long, ends string")


class Parentheses:
    """A balanced string with minima of the excess over blocks, and over 2, 4, 8 ... blocks."""

    def __init__(self, bits: np.ndarray, block: int = 64):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        self.opens = np.flatnonzero(bits)
        padded = np.full(-(-len(bits) // block) * block, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.least = [padded.reshape(-1, block).min(axis=1)]
        while len(self.least[-1]) > 1:
            low = self.least[-1]
            if len(low) % 2:
                low = self.least[-1] = np.append(low, np.iinfo(np.int64).max)
            self.least.append(low.reshape(-1, 2).min(axis=1))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing place of every open place: the first one behind it where the excess is one less."""
        goal = self.excess[at] - 1
        out = np.full(len(at), -1, np.int64)
        left = self._scan(at + 1, goal, np.arange(len(at)), out)
        if len(left):
            block = at[left] // self.block
            level = np.zeros(len(left), np.int64)
            self._scan(self._next_block(block, level, goal[left]) * self.block, goal[left], left, out)
        return out

    def _scan(self, at: np.ndarray, goal: np.ndarray, which: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Look through the rest of each place's block; fills ``out`` and returns what was not found."""
        left = np.arange(len(at))
        at = at.copy()
        edge = np.minimum((at // self.block + 1) * self.block, len(self.excess))
        for _ in range(self.block):
            left = left[at[left] < edge[left]]
            if not len(left):
                break
            found = self.excess[at[left]] == goal[left]
            out[which[left[found]]] = at[left[found]]
            left = left[~found]
            at[left] += 1
        return which[out[which] < 0]

    def _next_block(self, block: np.ndarray, level: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first block behind each given one whose least excess reaches the goal: up the tree of minima until a right neighbour has it, then down."""
        node, height = block.copy(), level.copy()
        climbing = np.arange(len(node))
        for h, low in enumerate(self.least):
            if not len(climbing):
                break
            beside = node[climbing] + 1
            has = (node[climbing] % 2 == 0) & (beside < len(low))
            has[has] = low[beside[has]] <= goal[climbing[has]]
            node[climbing[has]] += 1
            height[climbing[has]] = h
            climbing = climbing[~has]
            node[climbing] //= 2
        for h in range(len(self.least) - 2, -1, -1):
            down = np.flatnonzero(height > h)
            node[down] *= 2
            node[down] += self.least[h][node[down]] > goal[down]
            height[down] = h
        return node


def shard_rows(t: pa.Table) -> pa.RecordBatch:
    """Nodes, parts of spine nodes and lists of ends for one shard of sorted segments."""
    starts, paths = t.column("start").to_pylist(), t.column("path").to_pylist()
    conv = t.column("conv_id").to_numpy()
    m = len(paths)
    size = np.array([1 + len(p) // KEY for p in paths], np.int64)
    common = np.zeros(m, np.int64)
    for i in range(1, m):
        if starts[i] == starts[i - 1]:
            p, q, k = paths[i - 1], paths[i], 0
            if p == q:
                k = len(p)
            else:
                while k < len(p) and p[k: k + KEY] == q[k: k + KEY]:
                    k += KEY
            common[i] = 1 + k // KEY
    opened = size - common
    closed = np.concatenate([[0], size[:-1] - common[1:]])
    runs = np.empty(2 * m + 1, np.int64)
    runs[0:-1:2], runs[1::2], runs[-1] = closed, opened, size[-1]
    tree = Parentheses(np.repeat(np.arange(2 * m + 1) % 2, runs).astype(np.int8))

    at, n = tree.opens, int(opened.sum())
    close = tree.findclose(at)
    below = (close - at + 1) // 2  # nodes of the subtree, a run in preorder
    first = np.repeat(np.arange(m), opened)
    level = tree.excess[at] - 1
    last = np.searchsorted(np.cumsum(closed + opened), close, "right") - 1
    members = last - first + 1
    bounds = np.stack([first, last + 1], axis=1).ravel()
    smallest = np.minimum.reduceat(np.append(conv, np.iinfo(np.int64).max), bounds)[::2]

    lengths = np.concatenate([[0], np.cumsum([len(p) // KEY for p in paths])])
    flat = t.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    length = np.zeros(n, np.int64)
    inner = level > 0
    length[inner] = flat[lengths[first[inner]] + level[inner] - 1]
    spine = (at < size[0]) | (close >= len(tree.bits) - size[-1])

    end = np.cumsum(opened) - 1  # the node where each segment ends
    x = {}
    for name in ("x_children", "x_leaves", "x_saved"):
        x[name] = np.zeros(n, np.int64)
        np.add.at(x[name], end, t.column(name).to_numpy())
    x_conv = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(x_conv, end, t.column("x_conv").fill_null(np.iinfo(np.int64).max).to_numpy())

    pair = tree.bits[at + 1] == 0
    leaf = np.where(x["x_children"] > 0, x["x_leaves"], 1) * (pair & ~spine)
    ranks = np.concatenate([[0], np.cumsum(leaf)])
    saving = np.concatenate([[0], np.cumsum(np.where(spine, 0, (members - 1) * length + x["x_saved"]))])
    here = np.arange(n)
    leaves, saved = ranks[here + below] - ranks[here], saving[here + below] - saving[here]

    parent = np.full(n, -1, np.int64)
    order = np.argsort(level, kind="stable")
    levels = np.searchsorted(level[order], np.arange(level.max() + 2))
    for d in range(1, len(levels) - 1):
        mine, above = order[levels[d]: levels[d + 1]], order[levels[d - 1]: levels[d]]
        parent[mine] = above[np.searchsorted(above, mine) - 1]
    children = np.bincount(parent[(parent >= 0) & ~spine], minlength=n) + np.where(spine, 0, x["x_children"])

    digest = np.full(n, NOTHING, object)
    extra: list[tuple[int, int, str]] = []
    done = np.flatnonzero(t.column("ends").to_numpy(zero_copy_only=False))
    if len(done):
        for group in np.split(done, np.flatnonzero(np.diff(end[done])) + 1):
            node = end[group[0]]
            if not spine[node]:
                digest[node] = sha256(",".join(map(str, conv[group].tolist())).encode()).hexdigest()
            else:
                for k in range(0, len(group), ENDS_ROW):
                    ids = conv[group[k: k + ENDS_ROW]].tolist()
                    extra.append((node, ids[0], ",".join(map(str, ids))))
    under_spine = (parent >= 0) & ~spine & spine[parent]
    known = (parent >= 0) & ~spine & ~under_spine
    e = np.array([node for node, _, _ in extra], np.int64)

    def key(nodes: np.ndarray) -> list[str]:
        return [paths[first[k]][: KEY * level[k]] for k in nodes.tolist()]

    named = np.flatnonzero(spine | under_spine)
    own_path: list[str | None] = [None] * n
    for k, text in zip(named.tolist(), key(np.where(spine[named], named, parent[named])), strict=True):
        own_path[k] = text
    blank = np.zeros(len(e), np.int64)
    longs = {
        "level": (level, level[e]), "conv_id": (smallest, np.array([i for _, i, _ in extra], np.int64)), "parent_conv_id": (np.where(known, smallest[parent], 0), blank),
        "n_convs": (members, blank), "n_children": (children, blank), "n_leaves": (leaves, blank), "saved_tokens": (saved, blank), "size": (length, blank), "x_conv": (x_conv, blank),
        "x_children": (x["x_children"], blank), "x_leaves": (x["x_leaves"], blank), "x_saved": (x["x_saved"], blank)}
    missing = {"parent_conv_id": np.concatenate([~known, blank == 0]), "x_conv": np.concatenate([x_conv == np.iinfo(np.int64).max, blank == 0])}
    columns = [
        pa.array([*np.where(spine, "spine", "node").tolist(), *["ends"] * len(e)], pa.string()),
        pa.array([*[starts[k] for k in first.tolist()], *[starts[first[k]] for k in e.tolist()]], pa.string()),
        pa.array([*own_path, *key(e)], pa.string()),
        *[pa.array(np.concatenate(v), pa.int64(), mask=missing.get(name)) for name, v in longs.items()],
        pa.array([*digest.tolist(), *[text for _, _, text in extra]], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "start", "path", *longs, "ends"])


def _shards(batches: Iterator[pa.RecordBatch], shard_turns: int) -> Iterator[pa.RecordBatch]:
    held, turns = [], 0
    for batch in batches:
        for first in range(0, batch.num_rows, 1000 if shard_turns > 1000 else 1):
            part = batch.slice(first, 1000 if shard_turns > 1000 else 1)
            held.append(part)
            turns += part.num_rows + len(part.column("sizes").flatten())
            if turns >= shard_turns:
                yield shard_rows(pa.Table.from_batches(held))
                held, turns = [], 0
    if sum(b.num_rows for b in held):
        yield shard_rows(pa.Table.from_batches(held))


def _ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the lists of each node, which follow each other: the digest is carried on, the lists are never joined."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (*node, digest.hexdigest())], names=["start", "path", "ends_sha256"])

    for batch in batches:
        for start, path, text in zip(*(batch.column(k).to_pylist() for k in ("start", "path", "ends")), strict=True):
            if (start, path) != node:
                if node is not None:
                    yield row()
                node, digest = (start, path), sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
    if node is not None:
        yield row()


def _band(segments: DataFrame, shard_turns: int) -> DataFrame:
    """All nodes of one band: kind, start, level, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, x_conv."""
    c, cuts = F.col, ["start", "path", "conv_id"]
    raw = stored(segments.select(*SEGMENT).repartitionByRange(*cuts).sortWithinPartitions(*cuts).mapInArrow(lambda batches: _shards(batches, shard_turns), SHARD_SCHEMA), "trie-shards")
    parts = raw.where("kind = 'spine'").groupBy("start", "path").agg(
        F.min("level").alias("level"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.min("x_conv").alias("x_conv"),
        *[F.sum(k).alias(k) for k in ("n_convs", "n_children", "n_leaves", "saved_tokens", "x_children", "x_leaves", "x_saved")])
    parts = stored(parts.withColumn("above", F.when(c("path") != "", F.expr(f"left(path, length(path) - {KEY})"))), "trie-spines")
    kids = parts.where("above IS NOT NULL").groupBy("start", c("above").alias("path")).agg(F.count("*").alias("kids"))
    parts = parts.join(kids, ["start", "path"], "left").withColumn("n_children", c("n_children") + c("x_children") + F.coalesce("kids", F.lit(0)))
    parts = parts.withColumns({"leaf": F.when(c("n_children") == 0, 1).otherwise(c("x_leaves")), "own": (c("n_convs") - 1) * c("size") + c("x_saved")})
    up = parts.where("leaf != 0 OR own != 0").select("start", "leaf", "own", F.explode(F.expr(f"transform(sequence(0, level), i -> left(path, cast({KEY} * i as int)))")).alias("path"))
    up = up.groupBy("start", "path").agg(F.sum("leaf").alias("more_leaves"), F.sum("own").alias("more_saved"))
    lists = raw.where("kind = 'ends'").select("start", "path", "conv_id", "ends").repartition("start", "path").sortWithinPartitions("start", "path", "conv_id")
    lists = lists.drop("conv_id").mapInArrow(_ends_digest, "start string, path string, ends_sha256 string")
    whole_spine = parts.join(up, ["start", "path"], "left").join(lists, ["start", "path"], "left")
    whole_spine = stored(whole_spine.select(
        F.lit("spine").alias("kind"), "start", "path", "above", "level", "conv_id", "n_convs", "n_children", (c("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (c("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "x_conv"), "trie-spine-nodes")
    heads = whole_spine.select("start", c("path").alias("above"), c("conv_id").alias("found"))
    names = ["kind", "start", "level", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "x_conv"]
    nodes = raw.where("kind = 'node'").withColumnsRenamed({"path": "above", "ends": "ends_sha256"})
    settled = nodes.where("above IS NULL").select(*names)
    hung = nodes.where("above IS NOT NULL").drop("parent_conv_id").join(heads.withColumnRenamed("found", "parent_conv_id"), ["start", "above"])
    spine = whole_spine.join(heads.withColumnRenamed("found", "parent_conv_id"), ["start", "above"], "left")
    return settled.unionByName(hung.select(*names)).unionByName(spine.select(*names))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, key, size) of the rebuilt turns, and (conv_id, depth) of all rebuilt conversations."""
    c = F.col
    role, text = whole("role"), whole("text")
    key = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(KEY))
    turns = conversations.where("conv_id IS NOT NULL").select(c("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.char_length(text).cast("long").alias("size"))
    turns = stored(numbered(stored(turns, "trie-turns"), ["conv_id"], ["turn", "key"], "trie-order"), "trie-numbered")
    convs = turns.where("idx = 0").select("conv_id", "total", (F.crc32(c("conv_id").cast("string")) % HEADS).alias("head"), (c("conv_id") - c("conv_id") % 100).alias("base"))
    bases = convs.select(c("conv_id").alias("base"), c("total").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    convs = stored(convs.withColumn("depth", c("taken") + F.greatest(c("total") - c("head"), F.lit(0))), "trie-conversations")
    heads = turns.where(c("idx") < HEADS - 1).select(c("conv_id").alias("base"), c("idx").alias("pos"), "key", "size").join(convs.select("conv_id", "base", "head"), "base").where(c("pos") < c("head"))
    own = turns.join(convs.select("conv_id", "head", "taken"), "conv_id").where(c("idx") >= c("head")).withColumn("pos", c("taken") + c("idx") - c("head"))
    names = ["conv_id", "pos", "key", "size"]
    return heads.select(*names).unionByName(own.select(*names)), convs.select("conv_id", "depth")


def segments(turns: DataFrame, convs: DataFrame, band: int) -> DataFrame:
    """One row per conversation and band of turns; ``start`` names the node where the band begins."""
    c = F.col
    rows = turns.groupBy("conv_id", F.floor(c("pos") / band).alias("band")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "size"))).alias("t"))
    rows = rows.select("conv_id", "band", F.array_join(F.transform("t", lambda s: s["key"]), "").alias("path"), F.transform("t", lambda s: s["size"]).alias("sizes"))
    w = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(F.xxhash64(F.lit(seed), c("band"), c("path")).cast("decimal(38,0)")).over(w).cast("string") for seed in (1, 2)]
    rows = rows.withColumn("start", F.coalesce(F.concat_ws(",", F.lit(""), *sums), F.lit(""))).join(convs, "conv_id").withColumn("ends", c("depth") <= (c("band") + 1) * band)
    bare = convs.where("depth = 0").select("conv_id", F.lit(0).cast("long").alias("band"), F.lit("").alias("path"), F.array().cast("array<bigint>").alias("sizes"), F.lit("").alias("start"), F.lit(True).alias("ends"))
    return rows.drop("depth").withColumn("start", F.when(c("band") == 0, "").otherwise(c("start"))).unionByName(bare)


def prefix_nodes(conversations: DataFrame, band: int = BAND, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null turns come first, turns of one number follow by the digest of role and text; a null role or text is empty; rows without conv_id belong to no
    conversation.  Repeated rows are repeated turns.  An empty table gives no node.  Other columns are not read.
    """
    c = F.col
    segs = stored(segments(*rebuilt(conversations), band), "trie-segments")
    deepest = segs.agg(F.max("band")).first()[0]
    if deepest is None:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    out, totals = [], None
    for k in range(deepest, -1, -1):
        mine = segs.where(c("band") == k)
        if totals is None:
            mine = mine.withColumns({"x_conv": F.lit(None).cast("long"), **{x: F.lit(0).cast("long") for x in SEGMENT[-3:]}})
        else:
            mine = mine.join(totals, "conv_id", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in SEGMENT[-3:]})
        nodes = _band(mine, shard_turns)
        if k:
            nodes = stored(nodes, "trie-band")
            totals = nodes.where("level = 0").select("conv_id", c("conv_id").alias("x_conv"), c("n_children").alias("x_children"), c("n_leaves").alias("x_leaves"), c("saved_tokens").alias("x_saved"))
        elif deepest:
            nodes = stored(nodes, "trie-band")
        out.append((k, nodes))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above, result = None, None
    for k, nodes in reversed(out):
        if k:  # the first nodes of a band hang on the node that one member of the band above names
            inside = nodes.where("level > 1")
            top = nodes.where("level = 1").join(above, c("parent_conv_id") == c("named"), "left").withColumn("parent_conv_id", c("holder")).drop("named", "holder")
            nodes_out = inside.unionByName(top)
        else:
            nodes_out = nodes
        above = nodes.where("x_conv IS NOT NULL").select(c("x_conv").alias("named"), c("conv_id").alias("holder"))
        nodes_out = nodes_out.withColumn("depth", c("level") + k * band).select(*names)
        result = nodes_out if result is None else result.unionByName(nodes_out)
    return result
