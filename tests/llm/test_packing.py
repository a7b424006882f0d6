"""Packing: exact round trip of ids, gapless sequences, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crowdtide.llm.packing import pack, plan_patterns

FILE = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    t = Tokenizer.from_file(FILE)
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def checked(rows, docs, size):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, text in docs:
        want, at = np.array(ids_of(text), "<u4"), 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want))
            assert r.ids_crc32 == zlib.crc32(want[at: at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    padded = used = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        used += at
        padded += at if at & (at - 1) == 0 else size
    return 1 - used / padded


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack(docs, FILE).collect()
    assert checked(rows, [(r.doc_id, r.text) for r in docs.collect()], 4096) < 0.05


def test_odd_rows(spark):
    data = [(1, None, "x"), (2, "", "x"), (3, "  \n\t ", "x"), (4, "A<|endoftext|>b c d é x\x85y it's 12\r\nz", "x"), (None, "word " * 9000, "x"), (5, "w" * 30000, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, length string")
    checked(pack(docs, FILE).collect(), [d[:2] for d in data], 4096)
    twice = pack(docs.union(docs), FILE).collect()
    assert sum(r.length for r in twice) == 2 * sum(len(ids_of(d[1])) for d in data)
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert pack(docs.limit(0), FILE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    units = np.unique(rng.integers(1, 65, 30))
    demand = rng.integers(1, 400, len(units)).astype(float)
    plan = plan_patterns(demand, units, 64)
    assert (plan.copies @ plan.counts == demand).all()
    assert (plan.counts @ units <= 64).all()
    assert plan.copies.sum() <= 1.01 * max(plan.bound, demand @ units / 64) + len(units)
