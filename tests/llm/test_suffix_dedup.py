"""Substring removal against brute force; the sort against Python's."""

import random
from collections import Counter

import numpy as np
import pytest

from crowdtide.llm.common import Powers
from crowdtide.llm.suffix_dedup import Suffixes, deduplicate


def brute(docs, length=200):
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(r[k: k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        mark = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if seen[r[k: k + length]] > 1:
                mark[k: k + length] = True
        out.append((d, len(r), int(mark.sum()), int((mark[:-1] & ~np.r_[False, mark[:-2]]).sum()) if len(r) else 0, bytes(np.frombuffer(r, np.uint8)[~mark[:-1]])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=str)


def test_sort():
    rng = random.Random(3)
    bucket, strings = [], []
    for b in range(40):
        for _ in range(rng.randrange(1, 30)):
            bucket.append(b)
            strings.append(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))))
    s = Suffixes(strings, np.array(bucket), Powers())
    order = s.order().tolist()
    assert order == sorted(range(len(strings)), key=lambda k: (bucket[k], strings[k], k))
    for k, n in enumerate(s.neighbours(np.array(order)).tolist()):
        if n >= 0:
            a, b = strings[order[k - 1]], strings[order[k]]
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


@pytest.mark.parametrize("bucket_rows", [5000, 2])
def test_random(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(n) for n in (150, 199, 205, 260, 420, 900)]
    docs = []
    for k in range(60):
        parts = [rng.choice(shared)[rng.randrange(40):] if rng.random() < 0.5 else word(rng.randrange(300)) for _ in range(rng.randrange(1, 6))]
        docs.append((k, "".join(parts)))
    docs += [(100, "ab" * 400), (101, "z" * 199), (102, "z" * 201), (103, None), (104, ""), (105, docs[3][1]), (105, docs[3][1]), (None, docs[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(deduplicate(df, bucket_rows=bucket_rows, batch_rows=50)) == brute(docs)


def test_generated(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(deduplicate(df)) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert deduplicate(df.limit(0)).count() == 0
