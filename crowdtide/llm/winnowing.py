"""Benchmark decontamination by winnowing.

A text's fingerprints are the minimum hashes of its k-word grams in every window of w consecutive grams, so two texts that share k + w - 1 consecutive words
share a fingerprint.  Document and benchmark fingerprints are joined; around each hit the full windows are read and joined with the benchmark's windows on
their words, which extends the hits and leaves no false match.  Items shorter than a window are one window of their own: their few distinct lengths are looked
up at every position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, ascii_lower, free_name, mix, prefix_hash, slices, span_hash, stored, whole, word_hashes, word_spans

GRAM = 5


def _word_table() -> np.ndarray:
    """Word bytes: digits, letters, and every byte of a character beyond ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


class Words:
    """Words of a run of texts: spans, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, powers: Powers):
        self.data = ascii_lower()[data]
        self.starts, self.ends = word_spans(data, offsets, _word_table())
        self.hashes = word_hashes(data, self.starts, self.ends, ascii_lower(), powers) if len(self.starts) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.starts, offsets)
        self.prefix = prefix_hash(self.hashes, powers)
        self.powers = powers

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and first word (in the run) of every n-gram that lies inside one text."""
        sizes = np.maximum(np.diff(self.first) - n + 1, 0)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return rows, self.first[rows] + inside

    def hash_of(self, at: np.ndarray, n: int) -> np.ndarray:
        return mix(span_hash(self.prefix, at, at + n, self.powers) ^ np.uint64(n))

    def text(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.starts[k]: self.ends[k]].tobytes() for k in range(at, at + n))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out = x[: len(x) - w + 1].copy()
    for k in range(1, w):
        np.minimum(out, x[k: len(x) - w + 1 + k], out=out)
    return out


def winnow(hashes: np.ndarray, rows: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the minimum of some window of w grams of one text (all ties); a text with fewer grams is one window."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    picked = np.zeros(n, bool)
    if n >= w:
        least = _sliding_min(hashes, w)
        least[rows[: n - w + 1] != rows[w - 1:]] = np.iinfo(np.uint64).max  # windows over two texts count for none
        valid = rows[: n - w + 1] == rows[w - 1:]
        for k in range(w):
            picked[k: n - w + 1 + k] |= (hashes[k: n - w + 1 + k] == least) & valid
    begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    ends = np.r_[begins[1:], n]
    for b, e in zip(begins[ends - begins < w], ends[ends - begins < w], strict=True):
        picked[b:e] |= hashes[b:e] == hashes[b:e].min()
    return np.flatnonzero(picked)


def _fingerprints(keyed: DataFrame, window: int, lengths: list[int], short_only: bool) -> DataFrame:
    """(key columns, n, print, at): winnowed grams under n = 0; for n in ``lengths`` all n-grams.

    ``short_only``: benchmark side, where an n-gram counts only as a whole item.
    """
    keys = [c for c in keyed.columns if c != "text"]
    fields = keyed.select(*keys).schema.add("n", "integer").add("print", "long").add("at", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for first, _, data, offsets in slices(batch, "text"):
                words = Words(data, offsets, powers)
                sizes = np.diff(words.first)
                found = []
                rows, at = words.grams(GRAM)
                if short_only:
                    enough = sizes[rows] >= window
                    rows, at = rows[enough], at[enough]
                hashes = words.hash_of(at, GRAM)
                pick = winnow(hashes, rows, window - GRAM + 1)
                found.append((np.zeros(len(pick), np.int32), rows[pick], at[pick], hashes[pick]))
                for n in lengths:
                    rows, at = words.grams(n)
                    if short_only:
                        own = sizes[rows] == n
                        rows, at = rows[own], at[own]
                    found.append((np.full(len(rows), n, np.int32), rows, at, words.hash_of(at, n)))
                n, rows, at, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                taken = batch.select(keys).take(pa.array(first + rows))
                yield pa.RecordBatch.from_arrays(
                    [*(taken.column(c) for c in keys), pa.array(n), pa.array(hashes.view(np.int64)), pa.array((at - words.first[rows]).astype(np.int32))], names=fields.names)

    return keyed.mapInArrow(run, fields)


def _windows(keyed: DataFrame, window: int, places: bool) -> DataFrame:
    """(key columns, n, at, words): full windows as text; with ``places`` (array of struct n, at) only those around the hits."""
    keys = [c for c in keyed.columns if c not in ("text", "places")]
    fields = keyed.select(*keys).schema.add("n", "integer").add("at", "integer").add("words", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            hits = batch.column("places").to_pylist() if places else None
            for first, count, data, offsets in slices(batch, "text"):
                words = Words(data, offsets, powers)
                rows, ns, ats, texts = [], [], [], []
                for k in range(count):
                    size = int(words.first[k + 1] - words.first[k])
                    if hits is None:
                        n = min(window, size)
                        wanted = [(n, at) for at in range(size - n + 1)] if n else []
                    else:
                        wanted = {(p["n"], p["at"]) for p in hits[first + k] if p["n"]}
                        around = window - GRAM
                        wanted |= {(window, at) for p in hits[first + k] if not p["n"] for at in range(max(0, p["at"] - around), min(p["at"], size - window) + 1)}
                        wanted = sorted(wanted)
                    for n, at in wanted:
                        rows.append(first + k)
                        ns.append(n)
                        ats.append(at)
                        texts.append(words.text(int(words.first[k]) + at, n))
                taken = batch.select(keys).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in keys), pa.array(ns, pa.int32()), pa.array(ats, pa.int32()), pa.array(texts, pa.binary())], names=fields.names)

    return keyed.mapInArrow(run, fields)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Add n_words, n_hit, n_items, items (sorted array of item ids as strings) and contaminated to the rows of ``docs``; its own columns of these names are replaced.

    A document word is hit inside any occurrence of ``window`` consecutive item words, or of all words of a shorter item.  Null texts and texts
    without words have no hit and items without words match nothing; a null item_id matches but is not listed (it counts as an item).  Repeated rows of a document give
    the same answer each; repeated items count once.  ``window`` must be at least five.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM}")
    results = {"n_words", "n_hit", "n_items", "items", "contaminated"}
    rest = [c for c in docs.columns if c.lower() not in results]
    id_key, text = F.col(id_column).alias("_id"), whole(text_column)
    keyed = docs.select(id_key, F.xxhash64(text).alias("_h"), text.alias("text"))
    items = benchmark.select("item_id", whole("text").alias("text"))
    windows = stored(_windows(items, window, False).drop("at").distinct(), "benchmark-windows")
    lengths = [r.n for r in windows.where(F.col("n") < window).select("n").distinct().collect()]  # at most window - 1 numbers

    prints = _fingerprints(items, window, lengths, True).select("n", "print").distinct()
    hits = _fingerprints(keyed, window, lengths, False).join(prints, ["n", "print"], "left_semi")
    # Places of one document: at most its number of words for each length.
    places = stored(hits.groupBy("_id", "_h").agg(F.collect_set(F.struct("n", "at")).alias("places")), "hits")
    d, p = keyed.alias("d"), places.alias("p")
    near = d.join(p, F.col("d._id").eqNullSafe(F.col("p._id")) & (F.col("d._h") == F.col("p._h"))).select("d._id", "d._h", "d.text", "p.places").dropDuplicates(["_id", "_h"])
    found = _windows(near, window, True).join(windows, ["n", "words"]).select("_id", "_h", "n", "at", "item_id")
    found = stored(found, "found")
    # Words covered by the windows of one document: each start covers up to the next start or its own end.
    spans = found.groupBy("_id", "_h", "at").agg(F.max("n").alias("n"))
    runs = spans.groupBy("_id", "_h").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("spans"))
    covered = F.expr("aggregate(spans, struct(0 as end, 0L as hit), (a, s) -> struct(greatest(a.end, s.end) as end, "
                     "a.hit + greatest(0, s.end - greatest(a.end, s.at)) as hit), a -> a.hit)")
    listed = (found.select("_id", "_h", "item_id").distinct().groupBy("_id", "_h")
              .agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items")))
    marks = runs.withColumn("n_hit", covered).drop("spans").join(listed.withColumnsRenamed({"_id": "_id2", "_h": "_h2"}), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2"))).drop("_id2", "_h2")
    h = free_name(docs, "_h")
    m, own = marks.alias("m"), docs.select(*rest, F.xxhash64(text).alias(h), _count_words(text).alias("n_words")).alias("o")
    joined = own.join(m, F.col(f"o.{id_column}").eqNullSafe(F.col("m._id")) & (F.col(f"o.{h}") == F.col("m._h")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(*[F.col(f"o.`{c}`") for c in rest], "o.n_words", F.coalesce("m.n_hit", zero).alias("n_hit"), F.coalesce("m.n_items", zero).alias("n_items"),
                         F.coalesce("m.items", F.array().cast("array<string>")).alias("items"), F.col("m.n_hit").isNotNull().alias("contaminated"))


def _count_words(text):
    return F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit, with their own columns."""
    marked = contamination(docs.select("doc_id", "text"), benchmark, window)
    key, h = free_name(docs, "_id"), free_name(docs, "_h")
    bad = marked.where("contaminated").select(F.col("doc_id").alias(key), F.xxhash64(whole("text")).alias(h)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(whole("text")) == F.col(h)), "left_anti")
