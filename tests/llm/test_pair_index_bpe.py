"""BPE by pair occurrence index against the tokenizers library, texts and single letters."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crowdtide.llm import pair_index_bpe
from crowdtide.llm.pair_index_bpe import Bpe, decode, encode
from crowdtide.llm.queries import QUERIES

FILE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)
OWN = Bpe(FILE)


def same(texts):
    ids, offsets = OWN.encode(pa.array(texts, pa.string()))
    decoded = OWN.decode(ids, offsets).to_pylist()
    for k, want in enumerate(LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[k]: offsets[k + 1]].tolist() == want.ids, texts[k]
        assert decoded[k] == LIBRARY.decode(want.ids, skip_special_tokens=False)


def test_letters():
    """Every 7th code point beside letters, repeated, folded and with an accent; the first 1,000 all."""
    for points in (range(1000), range(1000, 0x110000, 7)):
        letters = [chr(c) for c in points if not 0xD800 <= c < 0xE000]
        same([f"ab{x}cd {x}{x.upper()}́'s" for x in letters])


def test_special_texts():
    same(["A<|endoftext|>b c", "<|startoftext|><|endoftext|>", "<|endoftext", "\x1ca\x1fb\x85c d", "ΟΔΟΣ ΑΣ", "aaaaaaa aaaa aa", "it's IT'S don't 12\r\nz", "", " \t\n", "x" * 5000])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aehinorst' .,<|>12\n"), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_random_texts(texts):
    same(texts)


def test_small_caches_give_the_same():
    small = Bpe(FILE)
    small.chunks.limit = small.pieces.limit = 3
    texts = ["one two three four", "four five six one", "", "six seven one one"]
    for _ in range(2):
        ids, offsets = small.encode(pa.array(texts))
        for k, want in enumerate(LIBRARY.encode_batch(texts, add_special_tokens=False)):
            assert ids[offsets[k]: offsets[k + 1]].tolist() == want.ids


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_bpe_encoding_and_decoding"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_runs():
    """Every row once, runs of about the limit, a long text alone."""
    texts = pa.array(["a" * n for n in (3, 0, 90, 500, 1, 1)])
    assert list(pair_index_bpe.runs(texts, 100)) == [(0, 3), (3, 1), (4, 2)] and list(pair_index_bpe.runs(texts.slice(0, 0), 9)) == []


def test_odd_rows(spark):
    data = [(1, None, "x"), (1, None, "x"), (2, "", None), (None, "Word " * 3000, "x"), (3, "Ünï <|endoftext|>", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, decoded string")
    coded = encode(docs, FILE)
    rows = coded.collect()
    assert sorted(((r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted(((d or 0), LIBRARY.encode(t or "", add_special_tokens=False).ids) for d, t, _ in data)
    again = decode(coded.union(spark.createDataFrame([(9, None), (8, bytearray(b"\xff\xff\xff\x7f\x01\x00\x00\x00"))], coded.schema)), FILE)
    texts = {r.doc_id: r.decoded for r in again.collect()}
    assert texts[9] == "" and texts[8] == LIBRARY.decode([1], skip_special_tokens=False)
    assert texts[3] == LIBRARY.decode(LIBRARY.encode("Ünï <|endoftext|>", add_special_tokens=False).ids, skip_special_tokens=False)
    assert encode(docs.where(F.lit(False)), FILE).count() == 0


def test_other_tokenizers_are_an_error():
    with pytest.raises(ValueError):
        Bpe(public_tokenizers.path("byte_bpe_50k.json"))
