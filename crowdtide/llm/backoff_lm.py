"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), where h' is h without its first word.  Its states are the
n-grams that occur at least ``min_count`` times in training; an arc consumes a token, and a failure arc leads from a state to its longest
proper suffix with weight m / (c(h) + m).  A text is scored in one traversal from left to right that carries the state.

Words rarer than ``min_count`` share one arc; its mass is dealt among them in proportion to their smoothed unigram probability, so that the model sums to one over all words.

No task holds the whole model.  Documents lie in blocks of a bucketed table; each block asks for the n-grams that it holds, as sorted hashes in one packed
cell per hash range; a range adds up the training counts of all blocks and answers each in the order of its question.  Questions and answers are the only
shuffles, and a hot n-gram is one entry per block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, ascii_lower, bucket_of, mix, slices, stored, whole, word_hashes, word_spans

END, START, RARE = np.uint64(1), np.uint64(2), np.uint64(3)  # tokens that are no words
PRIOR = 0.1
QUESTION = "block long, part int, n int, grams binary, counts binary"
ANSWER = "block long, n int, part int, counts binary"


def _space_table() -> np.ndarray:
    table = np.ones(256, bool)
    table[[32, *range(9, 14)]] = False
    return table


class Texts:
    """Token hashes of texts, each closed by END."""

    def __init__(self, table: pa.Table):
        powers = Powers()
        fold, is_word = ascii_lower(), _space_table()
        tokens, sizes = [], []
        for _, _, data, offsets in slices(table, "text"):
            starts, ends = word_spans(data, offsets, is_word)
            hashes = word_hashes(data, starts, ends, fold, powers) if len(starts) else np.zeros(0, np.uint64)
            counts = np.diff(np.searchsorted(starts, offsets))
            places = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
            out = np.full(len(hashes) + len(counts), END)
            out[places] = hashes
            tokens.append(out)
            sizes.append(counts + 1)
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes


def _extend(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from the hash of its history and its last token."""
    return mix(history * np.uint64(0x9E3779B97F4A7C15) + token)


class Model:
    """Parameters that are the same everywhere; four numbers come from the whole corpus."""

    def __init__(self, order: int, min_count: int, strength: float, total: int = 0, distinct: int = 0, known_total: int = 0, known_distinct: int = 0, documents: int = 0):
        self.order, self.min_count, self.strength, self.documents = order, min_count, strength, documents
        self.total, self.scale = total, total + PRIOR * (distinct + 1)
        self.rare_mass = 1.0 - (known_total + PRIOR * known_distinct) / self.scale  # all words but the frequent ones
        self.rare_total = total - known_total

    def grams(self, texts: Texts, counts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-gram hash ending at each token, whether its history is a state, count of the history).

        ``counts[k]`` holds the training count of the k-gram that ends at each token (counts[0] is not used).  The history of an n-gram is the (n - 1)-gram that ends one token before; the
        start of a text is a token of its own.
        """
        inside = np.arange(len(texts.tokens)) - texts.first[texts.row]
        if n == 1:
            return texts.tokens, np.ones(len(inside), bool), np.zeros(len(inside), np.int64)
        symbols = np.where(counts[1] >= self.min_count, texts.tokens, RARE)  # as arcs see them: rare words are one
        history, seen = np.roll(symbols, 1), np.roll(np.where(symbols == RARE, self.rare_total, counts[1]), 1)
        history[inside == 0], seen[inside == 0] = START, self.documents
        state = seen >= self.min_count
        for k in range(2, n):
            history, seen = np.roll(_extend(history, symbols), 1), np.roll(counts[k], 1)
            state = (inside >= k - 1) & (seen >= self.min_count)
        return _extend(history, symbols), state, seen

    def log_probabilities(self, texts: Texts, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of every token, and by smoothed unigrams alone: the traversal adds the arc, or the failure arcs and the arc, from the state that the tokens before have led to."""
        unigram = (counts[1] + PRIOR) / self.scale
        rare = counts[1] < self.min_count
        p = np.where(rare, self.rare_mass, unigram)
        for n in range(2, self.order + 1):
            _, state, seen = self.grams(texts, counts, n)
            p = np.where(state, (counts[n] + self.strength * p) / (seen + self.strength), p)
        return np.log10(np.where(rare, p * (unigram / self.rare_mass), p)), np.log10(unigram)


def _questions(texts: Texts, train: np.ndarray, grams: np.ndarray, asked: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, sorted distinct n-grams, their training counts in this block)."""
    grams, own = grams[asked], train[texts.row][asked]
    distinct, at = np.unique(grams, return_inverse=True)
    counts = np.bincount(at[own], minlength=len(distinct)).astype(np.uint32)
    bounds = [(k << 64) // parts for k in range(1, parts)]
    cuts = [0, *np.searchsorted(distinct, np.array(bounds, np.uint64)).tolist(), len(distinct)]
    for part in range(parts):
        a, b = cuts[part], cuts[part + 1]
        if b > a:
            yield part, distinct[a:b], counts[a:b]


def _pack_grams(x: np.ndarray) -> bytes:
    """Sorted hashes as byte planes of their differences: the high bytes are mostly zero and compress away."""
    import zlib

    return zlib.compress(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack_grams(x: bytes) -> np.ndarray:
    import zlib

    planes = np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(x: np.ndarray) -> bytes:
    import zlib

    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack_counts(x: bytes) -> np.ndarray:
    import zlib

    planes = np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _answer(group: pa.Table, min_count: int) -> pa.Table:
    """Adds up the questions of one hash range; answers each block in the order of its question.  A row under block -1 holds the range's own sums."""
    n, part = group.column("n")[0].as_py(), group.column("part")[0].as_py()
    grams = [_unpack_grams(x) for x in group.column("grams").to_pylist()]
    counts = [_unpack_counts(x) for x in group.column("counts").to_pylist()]
    sizes = np.cumsum([0, *map(len, grams)])
    distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    rows = [(b, n, part, _pack_counts(totals[at[sizes[k]: sizes[k + 1]]])) for k, b in enumerate(group.column("block").to_pylist())]
    frequent = totals >= min_count
    sums = [totals.sum(), (totals > 0).sum(), totals[frequent].sum(), frequent.sum(), totals[distinct == END].sum()]
    rows.append((-1, n, part, np.array(sums, np.int64).tobytes()))
    block, ns, parts, cells = zip(*rows, strict=True)
    return pa.table({"block": pa.array(block, pa.int64()), "n": pa.array(ns, pa.int32()), "part": pa.array(parts, pa.int32()), "counts": pa.array(cells, pa.binary())})


def _recall(model: Model, texts: Texts, answers: pa.Table, orders: int) -> list[np.ndarray]:
    """Pairs a block's questions, made again, with their answers: the count of the n-gram that ends at each token, 0 where it was not asked for."""
    counts = [np.zeros(0, np.int64)]
    cells = sorted(zip(answers.column("n").to_pylist(), answers.column("part").to_pylist(), answers.column("counts").to_pylist(), strict=True))
    for n in range(1, orders + 1):
        grams, state, _ = model.grams(texts, counts, n)
        _, at = np.unique(grams[state], return_inverse=True)
        own = np.zeros(len(grams), np.int64)
        if len(at):
            own[state] = np.concatenate([_unpack_counts(c) for k, _, c in cells if k == n])[at]
        counts.append(own)
    return counts


def _ask(blocks: DataFrame, answered: list[DataFrame], model: Model, n: int, parts: int) -> DataFrame:
    """The questions of every block for n-grams, given the answers to the shorter ones."""
    def questions(texts: Texts, counts: list[np.ndarray], table: pa.Table) -> pa.Table:
        train = ~np.array(table.column("held_out").to_pylist(), bool)
        grams, state, _ = model.grams(texts, counts, n)
        found = [(p, _pack_grams(g), _pack_counts(c)) for p, g, c in _questions(texts, train, grams, state, parts)]
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(found), pa.int64()), "part": pa.array([f[0] for f in found], pa.int32()), "n": pa.array([n] * len(found), pa.int32()),
                         "grams": pa.array([f[1] for f in found], pa.binary()), "counts": pa.array([f[2] for f in found], pa.binary())})

    def first(table: pa.Table) -> pa.Table:
        return questions(Texts(table), [], table)

    def further(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = Texts(table)
        return questions(texts, _recall(model, texts, answers, n - 1), table)

    if not answered:
        return blocks.groupBy("block").applyInArrow(first, QUESTION)
    return blocks.groupBy("block").cogroup(_union(answered).groupBy("block")).applyInArrow(further, QUESTION)


def score(docs: DataFrame, held_out: str = "held_out", order: int = 3, min_count: int = 1, strength: float = 40.0, block_rows: int = 3072) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text and the boolean column ``held_out``; the model learns from rows where that is not true).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score (the automaton), a row for each input row.  A null text
    is empty and has one token, the end.  A null held_out counts as false.  Without training rows every token is unknown.  Other columns are not read.
    Every n-gram that occurs in training is a state unless ``min_count`` asks for more.  ``block_rows`` bounds the texts of one block; the model's tables of a block grow with it, and the number of cells exchanged falls with it.
    """
    spark = docs.sparkSession
    place = F.monotonically_increasing_id()
    blocks = docs.select("doc_id", whole("text").alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"),
                         (F.shiftright(place, 33) * (1 << 24) + F.floor((place.bitwiseAND((1 << 33) - 1)) / block_rows)).cast("long").alias("block"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lm_blocks_{uuid.uuid4().hex}"
    blocks.write.format("parquet").bucketBy(parts, "block").saveAsTable(name)
    blocks = spark.table(name)

    model = Model(order, min_count, strength)
    answered: list[DataFrame] = []
    total = 0
    for n in range(1, order + 1):
        questions = _ask(blocks, answered, model, n, parts)
        answers = stored(questions.groupBy("part").applyInArrow(lambda t: _answer(t, min_count), ANSWER), f"answers-{n}")
        if n == 1:  # five numbers of each hash range
            sums = np.zeros(5, np.int64)
            for r in answers.where("block = -1").select("counts").toLocalIterator():
                sums += np.frombuffer(bytes(r[0]), np.int64)
            total = int(sums[0])
            model = Model(order, min_count, strength, *(int(x) for x in sums))
        answered.append(answers.where("block >= 0"))

    def traverse(texts_table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = Texts(texts_table)
        counts = _recall(model, texts, answers, order)
        logs, unigram = model.log_probabilities(texts, counts)
        add = lambda x: np.add.reduceat(x, texts.first)
        return pa.table({"doc_id": texts_table.column("doc_id"), "held_out": texts_table.column("held_out"), "n_tokens": texts.sizes.astype(np.int64),
                         "n_known": add((counts[1] > 0).astype(np.int64)), "base_score": add(unigram), "score": add(logs)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = blocks.groupBy("block").cogroup(_union(answered).groupBy("block")).applyInArrow(
        traverse, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = stored(scored, "scores")
    spark.sql(f"drop table {name}")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def with_fold(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    return docs.select("doc_id", "text", (bucket_of("doc_id", folds) == held).alias("held_out"))
