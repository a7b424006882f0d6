"""BPE encoding and decoding with a pair occurrence index, from the file of a word-end BPE tokenizer.

Inside a task the distinct chunks between ASCII blanks of a batch are found by Arrow's dictionary encoding, parted by the tokenizer's pattern, and the pieces
that no cache knows are merged together: all their symbols lie in one array with neighbour links, an index maps each pair of adjacent symbols to all its
positions, and the ranks of the pairs present are applied in ascending order.  A merge takes every position of its pair, left to right, and only the lists
of the pairs that appear beside the merged symbols are extended.  Words never touch, so the order is that of each word alone.  The ids of texts are then
gathered from those of their chunks as whole arrays.  Nothing leaves the task but rows, and no shuffle is needed.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import free_name, whole

CACHED = 150_000  # chunks and pieces in each generation of a cache; older ones are worked out again
RUN_BYTES = 1 << 23  # text of about this size is encoded at a time; a longer text is a run of its own


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Generations:
    """A cache of two generations: an entry that is asked for again survives when the older half goes."""

    def __init__(self, limit: int = CACHED):
        self.limit, self.young, self.old = limit, {}, {}

    def get_all(self, keys: list) -> list:
        """The values of all keys, None where there is none."""
        found = list(map(self.young.get, keys))
        if self.old:
            old = self.old.get
            for k, value in enumerate(found):
                if value is None and (value := old(keys[k])) is not None:
                    found[k] = self.young[keys[k]] = value
        return found

    def put_all(self, entries: dict) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young.update(entries)


class Bpe:
    """Reads a tokenizer file of the BPE kind with a word-end suffix, a splitting pattern and byte letters; any other kind is an error."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        loose = any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        if model["type"] != "BPE" or not plain or len(splits) != 1 or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or loose:
            raise ValueError(f"{tokenizer_file} is not a word-end BPE tokenizer of the known kind")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if longest_first else None
        v = self.vocabulary
        self.width = max(v.values()) + 2  # the greatest symbol is in no pair
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.product = [v[a + b] for a, b in pairs]  # by rank
        self.rank = {v[a] * self.width + v[b]: rank for rank, (a, b) in enumerate(pairs)}
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self.sorted_keys, self.sorted_ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        self.inner = {x: v[x] for x in letters}
        self.last = {x: v[x + self.suffix] for x in letters}
        reader = Tokenizer.from_file(tokenizer_file)
        self.normalizer, self.splitter = reader.normalizer, reader.pre_tokenizer
        self.chunks, self.pieces = Generations(), Generations()
        names = {k: t for t, k in [*v.items(), *self.special.items()]}
        self.names = pa.array([names.get(k) for k in range(max(names) + 1)], pa.string())

    # ---- chunks to pieces ----

    def _plain(self, part: str) -> list[str]:
        """Pieces, in byte letters.  Letters beyond ASCII are folded and classed as the tokenizer file's own rules do: Unicode tables differ by version."""
        if part.isascii():
            found = self.pattern.findall(part.lower())
            return found if part.isprintable() else [p.translate(self.letters) for p in found]
        return [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]

    def _split(self, chunk: str) -> list[str | int]:
        """Pieces of a chunk; the id in the place of a special token."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        if self.special_pattern is None or not any(t in chunk for t in self.special):
            return self._plain(chunk)
        out: list[str | int] = []
        for k, part in enumerate(self.special_pattern.split(chunk)):
            if k % 2:
                out.append(self.special[part])
            else:
                out.extend(self._plain(part))
        return out

    # ---- pieces to ids ----

    def _index(self, symbols: np.ndarray, starts: np.ndarray) -> dict[int, list[int]]:
        """All positions of every pair that can merge, by the rank of the pair."""
        if len(symbols) < 2:
            return {}
        keys = symbols[:-1] * self.width + symbols[1:]
        found = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        ranks = np.where(self.sorted_keys[found] == keys, self.sorted_ranks[found], -1)
        ranks[starts[(starts > 0) & (starts < len(symbols))] - 1] = -1  # the last symbol of a piece has no neighbour
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        present, first = np.unique(ranks[at], return_index=True)
        places = at.tolist()
        if not places:
            return {}
        return {r: places[a:b] for r, a, b in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(places)], strict=True)}

    def merged(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of every piece, all merged together through one index of pairs."""
        symbols: list[int] = []
        starts = [0]
        for piece in pieces:
            symbols.extend([self.inner[x] for x in piece[:-1]])
            symbols.append(self.last[piece[-1]])
            starts.append(len(symbols))
        n, width = len(symbols), self.width
        where = self._index(np.array(symbols, np.int64), np.array(starts))
        symbols.append(width - 1)  # the place that links without a neighbour lead to
        after, before = list(range(1, n + 2)), list(range(-1, n))
        for s in starts:
            before[s] = n
            after[s - 1] = n
        active = list(where)
        heapq.heapify(active)
        rank_of = self.rank.get
        while active:
            rank = heapq.heappop(active)
            places = where.pop(rank)
            places.sort()
            new = self.product[rank]
            for i in places:
                j = after[i]
                if rank_of(symbols[i] * width + symbols[j]) != rank:
                    continue  # an overlapping place or an earlier rank took it
                symbols[i], symbols[j] = new, -1
                k = after[i] = after[j]
                before[k] = i
                h = before[i]
                for near, at in ((rank_of(new * width + symbols[k]), i), (rank_of(symbols[h] * width + new), h)):
                    if near is not None:
                        if near in where:
                            where[near].append(at)
                        else:
                            where[near] = [at]
                            heapq.heappush(active, near)
        ids = np.array(symbols[:n], np.int64)
        left = ids >= 0
        ends = np.zeros(n + 1, np.int64)
        np.cumsum(left, out=ends[1:])
        packed, cuts = ids[left].astype("<u4").tobytes(), (4 * ends[np.array(starts)]).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Packed little-endian ids of every chunk."""
        out = self.chunks.get_all(chunks)
        todo = [(k, self._split(chunks[k])) for k, ids in enumerate(out) if ids is None]
        need = list({p for _, parts in todo for p in parts if isinstance(p, str)})
        known = {p: ids for p, ids in zip(need, self.pieces.get_all(need), strict=True) if ids is not None}
        fresh = [p for p in need if p not in known]
        made = dict(zip(fresh, self.merged(fresh), strict=True))
        self.pieces.put_all(made)
        known |= made
        for k, parts in todo:
            out[k] = b"".join([known[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in parts])
        self.chunks.put_all({chunks[k]: out[k] for k, _ in todo})
        return out

    # ---- texts ----

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one behind the other, and the offsets of the texts among them."""
        return by_chunks(texts, self.chunk_ids)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The tokens of every text joined by a blank; ids outside the vocabulary are left out."""
        known = (ids < len(self.names)) if len(ids) else np.zeros(0, bool)
        if not known.all() or self.names.null_count:
            known &= ~self.names.is_null().to_numpy(zero_copy_only=False)[np.where(known, ids, 0)]
            before = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(known, out=before[1:])
            ids, offsets = ids[known], before[offsets]
        tokens = self.names.take(pa.array(ids.astype(np.int64)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")


MARKS = np.isin(np.arange(256), list(b".,;:!?*#%$&|"))
ALNUM = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def _bare(chunks: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Chunks in fewer forms, with the same ids: ASCII ones in lower case, and one closing mark behind a letter or digit taken off; its byte per chunk, 0 for none.

    A mark after a letter or digit begins a piece of its own.  A chunk with other letters keeps its case, as the tokenizer composes before it folds; one with `<` too, as
    special tokens are told apart by case.
    """
    _, offsets, buffer = chunks.buffers()
    at = np.frombuffer(offsets, np.int64)[chunks.offset: chunks.offset + len(chunks) + 1]
    data = np.frombuffer(buffer, np.uint8)[at[0]: at[-1]] if buffer is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(data):
        return chunks, np.zeros(len(chunks), np.uint8)
    length = np.diff(at)
    odd = np.concatenate([[0], np.cumsum((data >= 128) | (data == 60))])
    fold = np.repeat(odd[at[1:]] == odd[at[:-1]], length) & (data >= 65) & (data <= 90)
    data = data + np.where(fold, np.uint8(32), np.uint8(0))
    last = np.clip(at[1:] - 1, 0, len(data) - 1)
    marked = (length >= 2) & MARKS[data[last]] & ALNUM[data[np.maximum(last - 1, 0)]]
    marks = np.where(marked, data[last], 0).astype(np.uint8)
    keep = np.ones(len(data), bool)
    keep[last[marked]] = False
    ends = at.copy()
    ends[1:] -= np.cumsum(marked)
    return pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(ends), pa.py_buffer(data[keep])), marks


def by_chunks(texts: pa.Array, chunk_ids: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts and their offsets, gathered from the packed ids of the distinct chunks between ASCII blanks."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    bare, marks = _bare(split.flatten())
    coded = bare.dictionary_encode()
    packed = chunk_ids(coded.dictionary.to_pylist())
    size = np.array([len(p) // 4 for p in packed], np.int64)
    flat = np.frombuffer(b"".join(packed), "<u4")
    mark_ids = np.zeros(256, "<u4")
    used = np.unique(marks[marks > 0])
    mark_ids[used] = np.frombuffer(b"".join(chunk_ids([chr(m) for m in used])), "<u4")  # one id each: every mark is in the vocabulary
    first = np.cumsum(size) - size
    slot = coded.indices.to_numpy(zero_copy_only=False)
    n = size[slot] if len(slot) else np.zeros(0, np.int64)
    ends = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n + (marks > 0), out=ends[1:])
    ids = np.zeros(ends[-1], "<u4")
    if ends[-1]:
        closing = ends[1:][marks > 0] - 1
        inner = np.ones(ends[-1], bool)
        inner[closing] = False
        before = np.cumsum(n) - n
        ids[inner] = flat[np.repeat(first[slot] - before, n) + np.arange(n.sum())]
        ids[closing] = mark_ids[marks[marks > 0]]
    words = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), out=words[1:])
    return ids, ends[words]


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) with about ``limit`` bytes of text."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(sizes):
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield first, last - first
        first = last


def _as_binary(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())


def _map(df: DataFrame, given: str, tokenizer_file: str, added: dict[str, str], work) -> DataFrame:
    kept = [c for c in df.columns if c != given]
    schema = df.select(*kept).schema
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(tokenizer_file)
        for batch in batches:
            column = batch.column(given)
            for first, rows in runs(column):
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *work(bpe, column.slice(first, rows))], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer_file: str, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text", decoded: bool = False) -> DataFrame:
    """``keep`` columns and ``ids`` (binary, little-endian unsigned 32-bit) for every row; with ``decoded``, the text that ``decode`` gives for them too.

    Null and empty texts, and texts of white space only, have no ids (an empty binary) and decode to the empty text.  Repeated rows give repeated rows,
    an empty table an empty one, and columns not in ``keep`` are not read.  A kept column called like an added one is an error of the caller.
    """
    text = free_name(docs.select(*keep), "text")
    rows = docs.select(*keep, whole(text_column).alias(text))

    def work(bpe: Bpe, texts: pa.Array) -> list[pa.Array]:
        ids, offsets = bpe.encode(texts)
        return [_as_binary(ids, offsets), *([bpe.decode(ids, offsets)] if decoded else [])]

    return _map(rows, text, tokenizer_file, {"ids": "binary"} | ({"decoded": "string"} if decoded else {}), work)


def decode(coded: DataFrame, tokenizer_file: str, ids_column: str = "ids") -> DataFrame:
    """The other columns and ``decoded`` for rows of packed ids; null ids count as none."""
    from pyspark.sql import functions as F

    rows = coded.withColumn(ids_column, F.coalesce(F.col(ids_column), F.lit(b"")))

    def work(bpe: Bpe, packed: pa.Array) -> list[pa.Array]:
        sizes = pc.binary_length(packed).to_numpy(zero_copy_only=False) // 4
        offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        return [bpe.decode(np.frombuffer(b"".join(packed.to_pylist()), "<u4"), offsets)]

    return _map(rows, ids_column, tokenizer_file, {"decoded": "string"}, work)
