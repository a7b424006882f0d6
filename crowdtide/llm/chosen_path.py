"""N-gram Jaccard join by chosen paths.

Every document is a set of word shingles; equal sets are one.  In each run a set x draws its shingles by a hash of the run: those below 1 / (threshold |x|).  Two sets
of similarity at or above the threshold draw, in expectation, at least one common shingle per run, so that a run misses a pair with probability 1/e at most; runs are
repeated until the bound on the recall meets its target.  A drawn shingle names a bucket.  Buckets with many sets are split again by a second drawn shingle where this
parts them; all are compared in tiles of bounded size.

A pair is compared in the largest of its common buckets only, so that nothing has to be counted twice or made distinct, and a tile gives one row per set: its number of
links and a root of its part.  Shingles go to a tile only for sets that a bitmap leaves a possible partner there; the bitmap bounds the intersection from above, so that
no link is lost.  No list of pairs is ever written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import Powers, free_name, mix, slices, stored, whole
from .components import components
from .winnowing import Words

TILE, WEIGHT = 8192, 1 << 20  # sets, and shingles of all sets, on a side of a tile
BLOCK = 512  # sets on a side of what a tile compares at once
HOT = 4096
PROBE = 16  # one set in so many shows whether a second shingle parts a hot bucket
BITS = 1024


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold is missed with probability 1 - recall at most."""
    return math.ceil(-math.log(1 - recall))


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a run; a text of fewer than n words is one shingle, one without words has none."""
    rows, at = words.grams(n)
    hashes = words.hash_of(at, n)
    cuts = np.searchsorted(rows, np.arange(len(words.first)))
    out = []
    for k, size in enumerate(np.diff(words.first)):
        if size >= n:
            out.append(np.unique(hashes[cuts[k]: cuts[k + 1]]))
        elif size:
            out.append(words.hash_of(words.first[k: k + 1], int(size)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def draw(shingles: np.ndarray, runs: int, threshold: float) -> np.ndarray:
    """Buckets of a set: hashes of (run, shingle) for the drawn shingles."""
    bound = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(shingles)))))
    found = []
    for r in range(runs):
        u = mix(shingles + np.uint64((0xA24BAED4963EE407 * (r + 1)) & (2**64 - 1)))
        found.append(mix(u[u <= bound] ^ np.uint64(r + 1)))
    return np.unique(np.concatenate(found))


def bitmap(shingles: np.ndarray) -> bytes:
    """BITS bits, of which every shingle sets one: a bit of x that y lacks stands for a shingle at least that y lacks."""
    bits = np.zeros(BITS, bool)
    bits[mix(shingles) % np.uint64(BITS)] = True
    return np.packbits(bits).tobytes()


def _signatures(keyed: DataFrame, n: int, runs: int, threshold: float) -> DataFrame:
    """(doc_id, h, signature, keys, size, bits): the identity of a text's shingle set (null without words), its buckets, shingles and bitmap."""
    fields = keyed.select("doc_id", "h").schema.add("signature", "binary").add("keys", ArrayType(LongType())).add("size", "integer").add("bits", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            signatures, keys, counts, bits = [], [], [], []
            for _, _, data, offsets in slices(batch, "text"):
                for s in shingle_sets(Words(data, offsets, powers), n):
                    signatures.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    keys.append(draw(s, runs, threshold).view(np.int64) if len(s) else np.zeros(0, np.int64))
                    counts.append(len(s))
                    bits.append(bitmap(s) if len(s) else None)
            sizes = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(signatures, pa.binary()), lists, pa.array(counts, pa.int32()),
                                              pa.array(bits, pa.binary())], names=fields.names)

    return keyed.mapInArrow(run, fields)


def _counted(flat: DataFrame) -> DataFrame:
    """(rep, buckets) from (rep, size, key): the keys that a set shares with another, with the number of sets there and of their shingles."""
    many = flat.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1")
    return flat.join(many, "key").groupBy("rep").agg(F.collect_list(F.struct("n", "key", "weight")).alias("buckets"))  # of one set: its drawn shingles


def _parted(first: DataFrame) -> DataFrame:
    """The keys of the hot buckets of ``first`` that a second hot bucket parts.

    A pair that also shares a bucket that stays whole meets there, so that only hot buckets have to part each other.  They do not in a group of near copies, which draw the
    same shingles: there the parts would hold more pairs than the bucket.
    """
    hot = F.sort_array(F.transform(F.filter("buckets", lambda b: b["n"] > HOT), lambda b: b["key"]))
    probed = first.where(F.pmod(F.xxhash64("rep"), F.lit(PROBE)) == 0).select(hot.alias("hot")).where("size(hot) > 0")
    alone = probed.select(F.explode("hot").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    both = probed.select("hot", F.explode("hot").alias("key")).select("key", F.explode("hot").alias("other")).where("key <> other").groupBy("key", "other").agg(F.count("*").alias("m"))
    inside = both.groupBy("key").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
    return alone.join(inside, "key", "left").where(F.coalesce("pairs", F.lit(0)) < F.col("n") * F.col("n")).select("key")


def _members(reps: DataFrame) -> DataFrame:
    """(rep, buckets): for every set the buckets that it shares with another, largest first; hot ones that can be parted are replaced by their parts."""
    first = stored(_counted(reps.select("rep", "size", F.explode("keys").alias("key"))), "paths")
    hot = first.select("rep", F.explode(F.filter("buckets", lambda b: b["n"] > HOT)).alias("b")).select("rep", F.col("b.key").alias("key"))
    split = hot.join(_parted(first), "key").groupBy("rep").agg(F.sort_array(F.collect_list("key")).alias("split"))  # of one set
    split = stored(split.join(reps.select("rep", "size"), "rep"), "split")
    parts = F.expr("flatten(transform(split, (b, at) -> transform(slice(split, at + 2, size(split)), c -> xxhash64(b, c))))")
    parts = _counted(split.select("rep", "size", F.explode(parts).alias("key"))).withColumnRenamed("buckets", "parts")
    whole_ones = F.expr("if(split is null, buckets, filter(buckets, b -> not array_contains(split, b.key)))")
    buckets = F.when(F.col("parts").isNull(), whole_ones).otherwise(F.concat(whole_ones, "parts"))
    out = first.join(split.select("rep", "split"), "rep", "left").join(parts, "rep", "left").select("rep", F.sort_array(buckets, asc=False).alias("buckets"))
    return stored(out, "buckets")


def _packed(shingles: np.ndarray) -> bytes:
    """Five high bytes of each hash: two different shingles of a pair of sets agree in them with probability 2**-40."""
    return np.unique(shingles >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


# ---- tiles ----------------------------------------------------------------------------------------------------------------

def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one tile at a time from rows that are sorted by tile."""
    held: list[dict] = []
    tile = None
    for batch in batches:
        for row in batch.to_pylist():
            mine = (row["key"], row["i"], row["j"])
            if mine != tile and held:
                yield held
                held = []
            tile = mine
            held.append(row)
    if held:
        yield held


def _covers(group: list[dict]) -> np.ndarray:
    """For each row the bits of its larger buckets that another row has too; two rows with a common bit are compared in a larger bucket."""
    flat = np.array([b for g in group for b in g["larger"]], np.int64)
    owner = np.repeat(np.arange(len(group)), [len(g["larger"]) for g in group])
    _, at, many = np.unique(flat, return_inverse=True, return_counts=True)
    use, column = many[at] > 1, (np.cumsum(many > 1) - 1)[at]
    bits = np.zeros((len(group), -(-int((many > 1).sum()) // 64)), np.uint64)
    np.bitwise_or.at(bits, (owner[use], column[use] // 64), np.uint64(1) << (column[use] % 64).astype(np.uint64))
    return bits


def _uncovered(covers: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Boolean matrix: no larger bucket has both rows."""
    out = np.ones((len(x), len(y)), bool)
    for left, right in zip(covers[x].T, covers[y].T, strict=True):
        if left.any() and right.any():
            out &= (left[:, None] & right[None, :]) == 0
    return out


def _blocks(group: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of two sides, whose products make the tile; a block with itself holds each of its pairs twice."""
    at, block = np.arange(len(group)), np.array([g["block"] for g in group])
    within = group[0]["i"] == group[0]["j"]
    left, right = (at, at) if within else (at[block == group[0]["i"]], at[block != group[0]["i"]])
    for k in range(0, len(left), BLOCK):
        for m in range(k if within else 0, len(right), BLOCK):
            yield left[k: k + BLOCK], right[m: m + BLOCK]


def _flag(rows: DataFrame, threshold: float) -> DataFrame:
    """The tile rows that have a pair of their own: one that no larger bucket holds and whose sizes and bitmaps allow the similarity."""
    fields = "key long, i int, j int, block int, rep binary, larger array<bigint>"

    def wanted(group: list[dict]) -> np.ndarray:
        covers = _covers(group)
        sizes = np.array([g["size"] for g in group])
        bits = np.frombuffer(b"".join(g["bits"] for g in group), np.uint64).reshape(len(group), -1)
        spare = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        out = np.zeros(len(group), bool)

        def mark(x: np.ndarray, y: np.ndarray) -> None:
            if not len(x) or not len(y):
                return
            both = np.zeros((len(x), len(y)), np.int32)
            for left, right in zip(bits[x].T, bits[y].T, strict=True):
                both += np.bitwise_count(left[:, None] & right[None, :])
            most = both + np.minimum(spare[x][:, None], spare[y][None, :])
            ok = most >= threshold / (1 + threshold) * (sizes[x][:, None] + sizes[y][None, :]) - 1e-6
            ok &= (x[:, None] != y[None, :])
            if ok.any():
                ok &= _uncovered(covers, x, y)
            out[x] |= ok.any(1)
            out[y] |= ok.any(0)

        for x, y in _blocks(group):
            mark(x[~out[x]], y)
            mark(x, y[~out[y]])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches):
            out += [(g["key"], g["i"], g["j"], g["block"], g["rep"], g["larger"]) for g, w in zip(group, wanted(group), strict=True) if w]
            if len(out) > 8192:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    def _table(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "i", "j", "block", "rep", "larger"])

    return rows.mapInArrow(run, fields)


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix: Jaccard similarity at or above the threshold, from exact intersections (a product of 0/1 matrices over the shared shingles)."""
    sizes = [np.array([len(s) for s in side], float) for side in (left, right)]
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, at, many = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(many > 1) - 1
    use = many[at] > 1
    n = int((many > 1).sum())
    both = np.zeros((len(left), len(right)))
    for low in range(0, n, 4096):
        columns = shared[at]
        part = use & (columns >= low) & (columns < low + 4096)
        marks = np.zeros((len(left) + len(right), min(4096, n - low)), np.float32)
        marks[owner[part], columns[part] - low] = 1
        both += marks[: len(left)] @ marks[len(left):].T
    return both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-9


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, root): for every set of a tile with links, the documents linked there and a set of its part, the same for all of them."""
    fields = "rep binary, links long, root binary"

    def links_of(group: list[dict]) -> list[tuple]:
        covers = _covers(group)
        sets = [_unpacked(g["set"]) for g in group]
        copies = np.array([g["copies"] for g in group], np.int64)
        links, part = np.zeros(len(group), np.int64), np.arange(len(group))
        for x, y in _blocks(group):
            match = similar([sets[k] for k in x], [sets[k] for k in y], threshold)
            if x[0] == y[0]:
                match &= np.triu(np.ones_like(match), 1)
            if not match.any():
                continue
            match &= _uncovered(covers, x, y)
            links[x] += match @ copies[y]
            links[y] += copies[x] @ match
            for k in np.flatnonzero(match.any(1)):
                met = np.unique(np.append(part[y[match[k]]], part[x[k]]))
                if len(met) > 1:
                    part[np.isin(part, met)] = met[0]
        return [(group[k]["rep"], int(links[k]), group[part[k]]["rep"]) for k in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["rep", "links", "root"])

        for group in _groups(batches):
            out += links_of(group)
            if len(out) > 8192:
                yield table()
                out = []
        if out:
            yield table()

    return rows.mapInArrow(run, fields)


def _with_sets(near: DataFrame, n: int) -> DataFrame:
    """Tile rows with the set's shingles, for texts with the list of tiles that want them."""
    fields = "key long, i int, j int, block int, rep binary, larger array<bigint>, copies long, set binary"
    kinds = {"key": pa.int64(), "i": pa.int32(), "j": pa.int32(), "block": pa.int32(), "rep": pa.binary(), "larger": pa.list_(pa.int64()), "copies": pa.int64(), "set": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for first, count, data, offsets in slices(batch, "text"):
                rows = batch.slice(first, count).select(["rep", "copies", "wanted"]).to_pylist()
                columns: dict[str, list] = {k: [] for k in kinds}
                for s, row in zip(shingle_sets(Words(data, offsets, powers), n), rows, strict=True):
                    for w in row["wanted"]:
                        for k, v in (*w.items(), ("rep", row["rep"]), ("copies", row["copies"]), ("set", _packed(s))):
                            columns[k].append(v)
                    if len(columns["set"]) > 256:
                        yield pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], names=list(kinds))
                        columns = {k: [] for k in kinds}
                if columns["set"]:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], names=list(kinds))

    return near.mapInArrow(run, fields)


def link(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999999) -> DataFrame:
    """(doc_id, h, class_id, n_links) for every row of ``docs`` (doc_id, text); h is the 32-bit hash of the text.

    n_links counts the other documents whose sets of n-word shingles have Jaccard similarity at or above ``threshold``, copies included; class_id is the least doc_id of the
    documents connected by links (null if all their ids are null).  Words are runs of letters and digits, ASCII ones in lower case; a shorter text is one shingle.  Texts without words (null, empty) have no link
    and are their own class.  Repeated rows are copies of each other.  Other columns are not read.
    """
    text = whole("text")
    keyed = docs.select("doc_id", F.hash(text).alias("h"), text.alias("text"))
    signed = stored(_signatures(keyed, n, runs_for(recall), threshold), "signatures")
    reps = stored(signed.where("signature is not null").groupBy(F.col("signature").alias("rep")).agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "h")).alias("one"), F.first("keys").alias("keys"), F.min("doc_id").alias("first_id"),
        F.first("size").alias("size"), F.first("bits").alias("bits")), "sets")
    members = _members(reps)

    tiles = F.ceil(F.greatest(F.col("b.n") / TILE, F.col("b.weight") / WEIGHT)).cast("int")
    listed = members.join(reps.select("rep", "size", "bits"), "rep").select("rep", "size", "bits", F.transform("buckets", lambda b: b["key"]).alias("ids"), F.posexplode("buckets").alias("at", "b"))
    listed = listed.select("rep", "size", "bits", F.expr("slice(ids, 1, at)").alias("larger"), F.col("b.key").alias("key"), tiles.alias("tiles"))
    listed = listed.withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("tiles")).cast("int"))
    spread = listed.select("key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"), "block", "rep", "size", "bits", "larger")
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "size", "bits", "larger")
    flagged = stored(_flag(spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), threshold), "tiles")

    wanted = flagged.groupBy("rep").agg(F.collect_list(F.struct("key", "i", "j", "block", "larger")).alias("wanted"))  # of one set: its buckets, times their tiles
    wanted = wanted.join(reps.select("rep", "copies", "one"), "rep")
    near = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("h") == F.col("one.h"))).select("text", "rep", "copies", "wanted").dropDuplicates(["rep"])
    compared = stored(_compare(_with_sets(near, n).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), threshold), "links")

    roots = components(compared.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    sets = (reps.select("rep", "copies", "first_id").join(per, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
            .select("rep", "copies", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root")))
    sets = stored(sets, "classes")
    classes = sets.groupBy("root").agg(F.min("first_id").alias("class_id"))
    sets = sets.join(classes, "root").select(F.col("rep").alias("signature"), "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "root")
    out = signed.select("doc_id", "h", "signature").join(sets, "signature", "left")
    return out.select("doc_id", "h", "root", F.when(F.col("signature").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **options: float) -> DataFrame:
    """One document of each class (the least doc_id, then the least text hash), with its own columns; texts without words all stay.

    Rows equal in doc_id and text are one document and give one row.
    """
    linked = stored(link(docs.select("doc_id", "text"), **options), "linked")
    least = linked.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("one"))
    kept = linked.where("root is null").select("doc_id", "h").unionByName(least.select("one.doc_id", "one.h"))
    keys = [free_name(docs, k) for k in ("id_text", "id_null", "text_hash")]

    def keyed(df: DataFrame, h: Column) -> DataFrame:
        return df.withColumns(dict(zip(keys, (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), h), strict=True)))

    # joined and made distinct by the same plain keys: the texts are shuffled once
    own = keyed(docs, F.hash(whole("text")))
    return own.join(keyed(kept, F.col("h")).select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys).drop(*keys)
