"""Removal of byte strings that occur more than once, by hash-compared suffix sorting.

Two equal strings of ``length`` bytes hold the same anchor: the grams of ``GRAM`` bytes whose hash is least among the length - GRAM + 1 grams of the string.  So
suffixes fall into buckets by anchor, and a string can only repeat inside one bucket.

1.  Every text gives its anchors, each with a hash of its context (what a string around it can cover).  Anchors that occur once are done.
2.  Equal contexts collapse into one with a count: copies cost one entry however many there are.
3.  Where an anchor has several contexts, one text of each goes to its bucket.  There the suffixes from the anchor and the reversed prefixes before it are
    sorted by a merge sort whose comparisons find the common extension by binary search over prefix polynomial hashes, checked on the bytes.
    Two contexts with L common bytes to the left and R to the right share every string inside; ranks cut at common extensions of r and l bytes say which.
4.  The covered ranges go back to the anchors' texts and are cut out.

A bucket with more than ``bucket_rows`` contexts (a common line in many surroundings) is not sorted in one task: its strings are counted one by one by hash, in partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, mix, prefix_hash, slices, span_hash, stored, whole

GRAM = 64


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """Least (or greatest) of every w neighbours: runs of w, met from both sides."""
    n = len(x)
    pad = -n % w
    fill = np.iinfo(x.dtype).max if best is np.minimum else np.iinfo(x.dtype).min
    blocks = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, w)
    left = best.accumulate(blocks, axis=1).ravel()
    right = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[: n - w + 1], left[w - 1: n])


def anchors_of(prefix: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are least in some string of ``length`` bytes of one text; ties all count."""
    n = len(prefix) - 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    hashes = mix(span_hash(prefix, at, at + GRAM, powers))
    w = length - GRAM + 1
    least = _sliding(hashes, w, np.minimum)
    # a gram is chosen if it equals the least of a window that holds it: the greatest of these least values
    edge = np.zeros(w - 1, np.uint64)
    chosen = _sliding(np.concatenate([edge, least, edge]), w, np.maximum) == hashes
    return np.flatnonzero(chosen), hashes[chosen]


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """(doc_id, place, gram, context) for every anchor; ``place`` packs the text's 32-bit hash ``h`` and the position."""
    fields = keyed.select("doc_id").schema.add("place", "long").add("gram", "long").add("context", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            high = np.asarray(batch.column("h").to_pylist(), np.int64) << 32
            for first, count, data, offsets in slices(batch, "text"):
                rows, places, grams, contexts = [], [], [], []
                for k in range(count):
                    text = data[offsets[k]: offsets[k + 1]]
                    if len(text) < length:
                        continue
                    at, hashes = anchors_of(prefix_hash(text + np.uint64(1), powers), length, powers)
                    raw = text.tobytes()
                    rows.append(np.full(len(at), first + k))
                    places.append(high[first + k] | at)
                    grams.append(hashes)
                    contexts += [_context_hash(raw, a, length) for a in at.tolist()]
                if rows:
                    taken = batch.column("doc_id").take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([taken, pa.array(np.concatenate(places)), pa.array(np.concatenate(grams).view(np.int64)),
                                                      pa.array(np.array(contexts, np.uint64).view(np.int64))], names=fields.names)

    return keyed.mapInArrow(run, fields)


def _context_hash(raw: bytes, at: int, length: int) -> int:
    """A second hash, of another family, of what strings around an anchor can cover, and of where that is cut by the text's ends."""
    low = max(0, at - length + GRAM)
    return xxhash.xxh3_64_intdigest(raw[low: at + length], seed=at - low)


# ---- sorting inside buckets --------------------------------------------------------------------------------------------

class Suffixes:
    """Strings of many buckets, bucket by bucket; comparisons find common extensions by binary search over prefix hashes."""

    def __init__(self, strings: list[bytes], bucket: np.ndarray, powers: Powers):
        self.strings, self.bucket, self.powers = strings, bucket, powers
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
        self.prefix = prefix_hash(self.data + np.uint64(1), powers)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings a and b (arrays): the largest with equal hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        x, y = self.begin[a], self.begin[b]
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = span_hash(self.prefix, x, x + mid, self.powers) == span_hash(self.prefix, y, y + mid, self.powers)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether string a comes before b; a string comes after its own prefixes."""
        n = self.common(a, b)
        inside = (n < self.size[a]) & (n < self.size[b])
        return np.where(inside, self.data[self.begin[a] + np.where(inside, n, 0)] < self.data[self.begin[b] + np.where(inside, n, 0)], self.size[a] < self.size[b])

    def order(self) -> np.ndarray:
        """Merge sort of every bucket, all merges of a level at once: an element goes to its place in its own run plus its rank in the run beside it."""
        n = len(self.strings)
        order = np.arange(n)
        first = np.searchsorted(self.bucket, self.bucket, "left")
        last = np.searchsorted(self.bucket, self.bucket, "right")
        width = 1
        while len(place := np.flatnonzero(last - first > width)):
            start, end = first[place], last[place]
            run = (place - start) // width
            left = run % 2 == 0
            own = start + run * width
            beside = np.minimum(np.where(left, own + width, own - width), end)
            low, high = beside.copy(), np.minimum(beside + width, end)
            while (open_ := low < high).any():
                mid = (low + high) // 2
                probe = np.where(open_, mid, place)
                # an element of the left run stays before equal ones of the right run
                before = np.where(left, self.less(order[probe], order[place]), ~self.less(order[place], order[probe]))
                low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
            merged = order.copy()
            merged[start + run // 2 * 2 * width + (place - own) + (low - beside)] = order[place]
            order, width = merged, 2 * width
        return order

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of each sorted string with the one before it, checked on the bytes; -1 where a bucket begins."""
        out = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(self.bucket[1:] == self.bucket[:-1]) + 1
        out[at] = self.common(order[at - 1], order[at])
        for k in at.tolist():
            a, b, n = self.strings[order[k - 1]], self.strings[order[k]], int(out[k])
            if a[:n] != b[:n]:  # a collision of hashes
                out[k] = next(i for i in range(n) if a[i] != b[i])
        return out


def shared_ranges(bucket: np.ndarray, lefts: list[bytes], rights: list[bytes], copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts around anchors (sorted by bucket): first and last byte, relative to the anchor, that repeated strings cover; equal if none does.

    ``lefts`` hold the bytes before the anchor, reversed; ``rights`` those from the anchor on.  A string that begins l bytes before the anchor is shared by two contexts
    if l bytes agree to the left and length - l to the right: equal classes of both sorted orders, cut at these lengths.  The strings of one context all hold the
    anchor, so that what they cover is one range.
    """
    n, powers = len(bucket), Powers()
    sides = []
    for strings in (lefts, rights):
        suffixes = Suffixes(strings, bucket, powers)
        order = suffixes.order()
        sides.append((order, suffixes.neighbours(order), suffixes.size))
    start, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for left in range(length - GRAM, -1, -1):
        ids = []
        for (order, common, size), need in zip(sides, (left, length - left), strict=True):
            own = np.empty(n, np.int64)
            own[order] = np.cumsum(common < need)
            ids.append(np.where(size >= need, own, -1))
        fits = np.flatnonzero((ids[0] >= 0) & (ids[1] >= 0))
        _, at, many = np.unique(ids[0][fits] * (n + 1) + ids[1][fits], return_inverse=True, return_counts=True)
        repeated = fits[(many[at] > 1) | (copies[fits] > 1)]
        start[repeated] = np.minimum(start[repeated], -left)
        end[repeated] = length - left
    return start, end


# ---- the distributed part ------------------------------------------------------------------------------------------------

def _contexts(near: DataFrame, length: int) -> DataFrame:
    """(gram, context, copies, many, left, bytes) for the wanted places of each text."""
    fields = "gram long, context long, copies long, many boolean, left int, bytes binary"
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                raw = text.encode()
                for w in wanted:
                    low = max(0, w["at"] - length + GRAM)
                    out.append((w["gram"], w["context"], w["copies"], w["many"], w["at"] - low, raw[low: w["at"] + length]))
                if len(out) >= 4096:
                    yield _rows(out, names)
                    out = []
            if out:
                yield _rows(out, names)

    return near.mapInArrow(run, fields)


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"gram": pa.int64(), "context": pa.int64(), "copies": pa.int64(), "many": pa.bool_(), "left": pa.int32(), "bytes": pa.binary(), "window": pa.binary(), "before": pa.int32(), "after": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[n]) for n, x in zip(names, zip(*out, strict=True), strict=True)], names=names)


def _sorted_buckets(contexts: DataFrame, length: int, batch_rows: int) -> DataFrame:
    """(gram, context, before, after) from buckets that lie together and in order in a partition."""
    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        gram, lefts = t.column("gram").to_numpy(), t.column("left").to_pylist()
        raw = t.column("bytes").to_pylist()
        bucket = np.cumsum(np.r_[0, gram[1:] != gram[:-1]])
        start, end = shared_ranges(bucket, [x[:k][::-1] for x, k in zip(raw, lefts, strict=True)], [x[k:] for x, k in zip(raw, lefts, strict=True)], t.column("copies").to_numpy(), length)
        found = np.flatnonzero(end > start)
        return pa.RecordBatch.from_arrays([pa.array(gram[found]), pa.array(t.column("context").to_numpy()[found]), pa.array(start[found].astype(np.int32)), pa.array(end[found].astype(np.int32))],
                                          names=["gram", "context", "before", "after"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            if count + len(gram) > batch_rows and len(gram):
                last = int(np.searchsorted(gram, gram[-1], "left"))  # the last bucket may go on
                if last or count and held[-1].column("gram")[-1].as_py() != gram[-1]:
                    yield flush([*held, batch.slice(0, last)] if last else held)
                    held, count = [], 0
                    batch = batch.slice(last)
            held.append(batch)
            count += batch.num_rows
        if count:
            yield flush(held)

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "gram long, context long, before int, after int")


def _counted_strings(contexts: DataFrame, length: int) -> DataFrame:
    """(gram, context, before, after) for large buckets: every string is counted by its hash, wherever its contexts lie."""
    fields = "gram long, context long, copies long, before int, window binary"
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gram", "context", "copies", "left", "bytes")]
            out = []
            for gram, context, copies, left, raw in zip(*columns, strict=True):
                out += [(gram, context, copies, k - left, xxhash.xxh3_128_digest(raw[k: k + length])) for k in range(min(left, len(raw) - length) + 1)]
                if len(out) >= 16384:
                    yield _rows(out, names)
                    out = []
            if out:
                yield _rows(out, names)

    windows = contexts.mapInArrow(run, fields)
    key = ["gram", "before", "window"]  # a string may hold several anchors: it is counted once for each and for each place of it
    twice = windows.groupBy(*key).agg(F.sum("copies").alias("n")).where("n > 1").select(*key)
    return windows.join(twice, key, "left_semi").groupBy("gram", "context").agg(F.min("before").alias("before"), (F.max("before") + length).alias("after"))


def _cut(joined: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) from texts with their ranges."""
    fields = joined.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                raw = text.encode()
                kept, at, removed, spans = [], 0, 0, 0
                last = 0  # end of the removed run
                for r in sorted((max(0, r["at"] + r["before"]), min(len(raw), r["at"] + r["after"])) for r in ranges or ()):
                    if r[0] > last or not spans:
                        kept.append(raw[last: r[0]])
                        spans += 1
                        at = r[0]
                        last = at
                    if r[1] > last:
                        removed += r[1] - last
                        last = r[1]
                kept.append(raw[last:])
                out.append((len(raw), removed, spans, b"".join(kept)))
            n, removed, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=fields.names)

    return joined.mapInArrow(run, fields)


def deduplicate(docs: DataFrame, length: int = 200, bucket_rows: int = 50_000, batch_rows: int = 10_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: the remaining bytes) for every row of ``docs`` (doc_id, text).

    Every byte covered by a string of ``length`` bytes that starts anywhere else too goes, in all its occurrences; strings are judged on the input.  Null
    texts are empty.  Repeated rows repeat their whole text.  Texts shorter than ``length`` stay.  Other columns are not read.  ``bucket_rows`` only says how a bucket is worked on.
    Strings count as equal when two hashes of 64 bits of different families agree, or when sorting has compared their bytes.
    """
    text = whole("text")
    keyed = docs.select("doc_id", F.hash(text).alias("h"), text.alias("text"))
    anchors = _anchor_rows(keyed, length)
    often = anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    live = stored(anchors.join(often, "gram", "left_semi"), "anchors")

    per = stored(live.groupBy("gram", "context").agg(F.count("*").alias("copies"), F.min(F.struct("place", "doc_id")).alias("rep")), "contexts")
    several = per.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > bucket_rows).alias("many"))
    wanted = (per.join(several, "gram").select(F.col("rep.doc_id").alias("_id"), F.shiftright("rep.place", 32).cast("int").alias("_h"),
                                               F.struct(F.col("rep.place").bitwiseAND((1 << 32) - 1).cast("int").alias("at"), "gram", "context", "copies", "many").alias("w"))
              .groupBy("_id", "_h").agg(F.collect_list("w").alias("wanted")))  # of one text: at most its anchors
    near = (keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("_id", "_h", "text", "wanted")
            .dropDuplicates(["_id", "_h"]))
    contexts = stored(_contexts(near.select("text", "wanted"), length), "buckets")
    ranges = _sorted_buckets(contexts.where("not many"), length, batch_rows).unionByName(_counted_strings(contexts.where("many"), length))
    single = F.col("copies") > 1
    covered = ranges.unionByName(per.where(single).select("gram", "context", F.lit(GRAM - length).alias("before"), F.lit(length).alias("after")))
    covered = covered.groupBy("gram", "context").agg(F.min("before").alias("before"), F.max("after").alias("after"))
    spans = (live.join(covered, ["gram", "context"])
             .select(F.col("doc_id").alias("_id"), F.shiftright("place", 32).cast("int").alias("_h"), F.struct(F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("at"), "before", "after").alias("r"))
             .distinct().groupBy("_id", "_h").agg(F.collect_list("r").alias("ranges")))  # of one text: at most its anchors
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "text", "ranges")
    return _cut(joined, length)
