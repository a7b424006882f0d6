"""Language model against a dictionary implementation, and its sum to one."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from crowdtide.llm.backoff_lm import score, with_fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


class Plain:
    def __init__(self, texts, order, min_count, strength):
        self.order, self.min, self.m = order, min_count, strength
        lists = [tokens(t) for t in texts]
        self.c = Counter(w for t in lists for w in t)
        self.N, self.V = sum(self.c.values()), len(self.c)
        self.scale = self.N + 0.1 * (self.V + 1)
        self.known = {w for w in self.c if self.c[w] >= min_count}
        self.rare_mass = 1 - sum(self.c[w] + 0.1 for w in self.known) / self.scale
        self.g = Counter()
        for t in lists:
            s = ["<s>", *(w if w in self.known else "<rare>" for w in t)]
            self.g["<s>",] += 1
            for k in range(1, len(s)):
                for n in range(1, order + 1):
                    if k - n + 1 >= 0:
                        self.g[tuple(s[k - n + 1: k + 1])] += 1

    def unigram(self, w):
        return (self.c[w] + 0.1) / self.scale

    def p(self, history, w):
        s = w if w in self.known else "<rare>"
        p = self.unigram(w) if w in self.known else self.rare_mass
        for n in range(1, self.order):
            h = tuple(history[-n:])
            if len(h) < n or self.g[h] < self.min:
                break
            p = (self.g[(*h, s)] + self.m * p) / (self.g[h] + self.m)
        return p if w in self.known else p * self.unigram(w) / self.rare_mass

    def text(self, text):
        h, total = ["<s>"], 0.0
        for w in tokens(text):
            total += math.log10(self.p(h, w))
            h.append(w if w in self.known else "<rare>")
        return total


def check(spark, docs, order, min_count, strength, block_rows):
    df = with_fold(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = score(df, order=order, min_count=min_count, strength=strength, block_rows=block_rows).collect()
    held = {d for d, _ in docs if zlib.crc32(str("" if d is None else d).encode()) % 10 == 0}
    plain = Plain([t for d, t in docs if d not in held], order, min_count, strength)
    assert len(rows) == len(docs)
    texts = {d: t for d, t in docs}
    for r in rows:
        t = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(t), sum(plain.c[w] > 0 for w in t), plain.N)
        assert r.base_score == pytest.approx(sum(math.log10(plain.unigram(w)) for w in t))
        assert r.score == pytest.approx(plain.text(texts[r.doc_id]))
    return plain


def test_random(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randrange(80))) + rng.choice(["", "\n", " É"])) for k in range(200)]
    plain = check(spark, [*docs, (None, None), (900, "")], 3, 4, 5.0, 7)
    words = [*plain.c, "never seen"]
    for h in (["<s>"], ["<s>", "a"], ["a", "b"], ["<rare>", "e"], ["a", "<rare>"]):
        assert sum(plain.p(h, w) for w in words) == pytest.approx(1.0)


def test_generated(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs, 3, 10, 40.0, 50)


def test_without_training(spark):
    df = spark.createDataFrame([(1, "a b", True, "x")], "doc_id long, text string, held_out boolean, block string")
    r = score(df).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, np.isfinite(r.score)) == (3, 0, 0, True)
    assert score(df.limit(0)).count() == 0
