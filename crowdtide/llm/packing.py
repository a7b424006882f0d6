"""Packing of documents into fixed-length token sequences by cutting-stock column generation.

Every document becomes pieces: as many whole sequences as it fills, and one remainder.  The histogram of remainder lengths (in classes of a few
tokens, rounded up) is a cutting-stock problem: a linear program over patterns of lengths whose columns are priced by an unbounded knapsack.
The rounded solution is a list of patterns with multiplicities; pieces are ranked inside their class and their rank says which pattern copy and which
place in it they take, by arithmetic and one join with the plan.

Only the histogram reaches the driver: at most ``size / width`` counts, whatever the number of documents.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored, whole
from .pair_index_bpe import Generations, by_chunks, runs

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"
CACHED_WORDS = 150_000  # in each of two generations
RUN_BYTES = 1 << 21  # text of about this size is encoded at a time; a longer text is a run of its own
TAIL = ".,;:!?*#%$&|"


# ---- tokens and pieces ----------------------------------------------------------------------------------------------

class WordEncoder:
    """Ids of texts; the distinct words between blanks of a batch are encoded together and the texts gathered from them as whole arrays.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in order.  It also parts a run of letters from what follows, so that
    a word is looked up as its letters and its rest.  Runs of letters go through the tokenizer many at a time: the last id of each marks a word's end.
    """

    def __init__(self, tokenizer_file: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.end_id = end_id
        self.words = Generations(CACHED_WORDS)

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_letters(self, runs_: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        groups = [runs_[k: k + 512] for k in range(0, len(runs_), 512)]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(cuts) != len(group):  # a letter that the tokenizer takes apart
                out.update((w, self._one(w)) for w in group)
                continue
            packed, last = ids.tobytes(), 0
            for w, cut in zip(group, cuts, strict=True):
                out[w] = packed[last:cut]
                last = cut
        return out

    def word_ids(self, words: list[str]) -> list[bytes]:
        out = self.words.get_all(words)
        letters, todo = [], []
        for k, ids in enumerate(out):
            if ids is None:
                w = words[k]
                if w.isalpha():
                    letters.append(w)
                    todo.append((k, w, ""))
                else:
                    head = w.rstrip(TAIL)
                    if head.isalpha():
                        letters.append(head)
                        todo.append((k, head, w[len(head):]))
                    else:
                        out[k] = self._one(w) if w else b""
                        todo.append((k, None, ""))
        known = self._encode_letters(list(dict.fromkeys(letters)))
        tails: dict[str, bytes] = {"": b""}
        fresh = {}
        for k, head, tail in todo:
            if head is not None:
                if tail not in tails:
                    tails[tail] = self._one(tail)
                out[k] = known[head] + tails[tail]
            fresh[words[k]] = out[k]
        self.words.put_all(fresh)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, the end id behind each, and the offsets of the texts."""
        ids, offsets = by_chunks(texts, self.word_ids)
        return np.insert(ids, offsets[1:], np.uint32(self.end_id)).astype("<u4"), offsets + np.arange(len(offsets))


def worker_encoder(tokenizer_file: str, end_id: int) -> WordEncoder:
    """One encoder for all tasks of a Python worker: its caches stay warm and no task leaves a tokenizer of its own behind.

    Functions travel by value, so that this module's own variables would be new in every task; the tokenizer library's module stays.
    """
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if (tokenizer_file, end_id) not in kept:
        kept.clear()
        kept[tokenizer_file, end_id] = WordEncoder(tokenizer_file, end_id)
    return kept[tokenizer_file, end_id]


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int, size: int, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """One row per piece: ``keep`` columns, start, length, ids_crc32, doc_tokens."""
    kept = docs.select(*keep, whole(text_column).alias("text"))
    fields = kept.select(*keep).schema
    for name in [c.strip().split(" ")[0] for c in PIECES.split(",")]:
        fields = fields.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the lists of words are long and hold no cycles
        try:
            encoder = worker_encoder(tokenizer_file, end_id)
            for batch in batches:
                for first, n in runs(batch.column("text"), RUN_BYTES):
                    part = batch.slice(first, n)
                    ids, offsets = encoder.encode(part.column("text"))
                    packed = memoryview(ids.tobytes())
                    rows, out = [], []
                    for k, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                        for at in range(a, b, size):
                            to = min(at + size, b)
                            rows.append(k)
                            out.append((at - a, to - at, zlib.crc32(packed[4 * at: 4 * to]), b - a))
                    taken = part.take(pa.array(rows, pa.int64()))
                    numbers = np.array(out, np.int64).reshape(-1, 4)
                    yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in keep), *(pa.array(numbers[:, j]) for j in range(4))], names=fields.names)
        finally:
            gc.enable()  # the worker goes on to other tasks

    return kept.mapInArrow(run, fields)


# ---- the linear program -------------------------------------------------------------------------------------------------

@dataclass
class Plan:
    """Pattern p holds counts[p][c] pieces of class c and is used copies[p] times."""

    counts: np.ndarray
    copies: np.ndarray
    bound: float


def _best_pattern(value: np.ndarray, units: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of classes within ``capacity`` units."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = units <= c
        if not fits.any():
            continue
        worth = np.where(fits, best[np.maximum(c - units, 0)] + value, -1.0)
        k = int(worth.argmax())
        best[c], chosen[c] = (best[c - 1], -1) if best[c - 1] >= worth[k] else (worth[k], k)
    pattern, c = np.zeros(len(units)), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            pattern[chosen[c]] += 1
            c -= units[chosen[c]]
    return best[capacity], pattern


def plan_patterns(demand: np.ndarray, units: np.ndarray, capacity: int, gap: float = 0.002, rounds: int = 3000) -> Plan:
    """Patterns and multiplicities that cover ``demand`` pieces of each class (``units`` long) exactly.

    Column generation with an explicit basis: start from one pattern per class, price by knapsack, pivot, and stop when the bound of the
    duals shows the program to be within ``gap`` of its optimum (or after ``rounds`` pivots; any basis is a valid plan).  Copies are rounded down; what remains is
    packed best-fit, longest first.
    """
    n = len(units)
    if not n:
        return Plan(np.zeros((0, 0), int), np.zeros(0, int), 0.0)
    basis = np.diag((capacity // units).astype(float))
    inverse = np.diag(1.0 / (capacity // units))
    level = inverse @ demand
    bound = 0.0
    for k in range(rounds):
        price = np.ones(n) @ inverse
        worth, pattern = _best_pattern(np.maximum(price, 0), units, capacity)
        total = level.sum()
        bound = max(bound, total / max(worth, 1.0))
        if worth <= 1 + 1e-9 or total <= bound * (1 + gap):
            break
        step = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, level / step, np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        if k % 100 == 99:
            inverse = np.linalg.inv(basis)
            level = np.maximum(inverse @ demand, 0)
        else:
            inverse[out] /= step[out]
            others = np.arange(n) != out
            inverse[others] -= np.outer(step[others], inverse[out])
            level = np.maximum(level - ratio[out] * step, 0)
            level[out] = ratio[out]
    whole_copies = np.floor(level + 1e-9).astype(np.int64)
    patterns = basis.T.round().astype(np.int64)
    left = demand.astype(np.int64) - whole_copies @ patterns
    while (left < 0).any():  # rounding noise: give a copy back
        p = int(np.flatnonzero((patterns[:, left < 0].sum(axis=1) > 0) & (whole_copies > 0))[0])
        whole_copies[p] -= 1
        left = left + patterns[p]
    rest: dict[tuple[int, ...], int] = {}
    open_bins: list[tuple[int, np.ndarray]] = []
    for c in np.argsort(-units):
        for _ in range(int(left[c])):
            fit = [(free, j) for j, (free, _) in enumerate(open_bins) if free >= units[c]]
            if fit:
                free, j = min(fit)
                open_bins[j][1][c] += 1
                open_bins[j] = (free - units[c], open_bins[j][1])
            else:
                counts = np.zeros(n, np.int64)
                counts[c] = 1
                open_bins.append((capacity - units[c], counts))
    for _, counts in open_bins:
        rest[tuple(counts)] = rest.get(tuple(counts), 0) + 1
    used = whole_copies > 0
    counts = np.vstack([patterns[used], np.array(list(rest), np.int64).reshape(-1, n)])
    return Plan(counts, np.concatenate([whole_copies[used], np.array(list(rest.values()), np.int64)]), bound)


# ---- assignment ------------------------------------------------------------------------------------------------------------

def assign(cut: DataFrame, size: int, width: int = 16, rank_rows: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to pieces (columns doc_id, start, length at least); ``cut`` is read several times and should be stored.

    Ranks inside a class are made in slices of about ``rank_rows`` pieces dealt by hash, so that a class with a third of all pieces is no single group.
    """
    spark = cut.sparkSession
    klass, part, rank, base = (free_name(cut, x) for x in ("class", "slice", "rank", "base"))
    full = F.col("length") == size
    sized = cut.withColumn(klass, F.when(full, F.lit(0)).otherwise(F.ceil(F.col("length") / width)).cast("int"))
    total = cut.count()
    slices = max(1, -(-total // rank_rows))
    sized = sized.withColumn(part, F.pmod(F.xxhash64(*[F.col(c) for c in cut.columns]), F.lit(slices)).cast("int"))
    groups = sized.groupBy(klass, part).agg(F.count("*").alias(base))
    counted = {r[0]: r[1] for r in groups.groupBy(klass).agg(F.sum(base)).collect()}  # one number per class
    # Rows equal in every column are interchangeable, so that the order among them does not matter.
    inside = Window.partitionBy(klass, part).orderBy(*[F.col(c) for c in cut.columns])
    sliced = Window.partitionBy(klass).orderBy(part)  # slices of a class: total / rank_rows rows
    starts = groups.withColumn(base, F.sum(base).over(sliced) - F.col(base))
    ranked = (sized.withColumn(rank, F.row_number().over(inside).cast("long") - 1)
              .join(starts, [klass, part]).withColumn(rank, F.col(rank) + F.col(base)).drop(part, base))

    n_full = counted.pop(0, 0)
    classes = sorted(counted)
    units = np.array(classes, np.int64)
    plan = plan_patterns(np.array([counted[c] for c in classes], float), units, size // width)
    rows, first = [], n_full  # sequences of full pieces come first
    begins = np.zeros(len(classes), np.int64)
    for counts, copies in zip(plan.counts, plan.copies, strict=True):
        for k in np.flatnonzero(counts):
            taken = int(counts[k] * copies)
            rows.append((classes[k], int(begins[k]), int(begins[k]) + taken, int(counts[k]), int(first)))
            begins[k] += taken
        first += int(copies)
    ranges = spark.createDataFrame(rows, f"`{klass}` int, _from long, _to long, _each long, _first long")
    # A class occurs in few patterns; the list of its ranges travels as one array.
    ranges = ranges.groupBy(klass).agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_each", "_first"))).alias("_ranges"))
    sequence = F.expr(f"transform(filter(_ranges, r -> `{rank}` >= r._from and `{rank}` < r._to), r -> r._first + (`{rank}` - r._from) div r._each)[0]")
    placed = (ranked.join(ranges, klass, "left")
              .withColumn("sequence_id", F.when(F.col(klass) == 0, F.col(rank)).otherwise(sequence)).drop("_ranges", klass))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), rank)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop(rank)


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 2, size: int = 4096, width: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack every document: a row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece that holds the end id alone; a null id is kept.  Repeated rows are packed as often as they occur; equal
    rows are interchangeable.  No row gives no sequence.  Other columns are not read.
    """
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return assign(stored(pieces(named, tokenizer_file, end_id, size), "pieces"), size, width)
