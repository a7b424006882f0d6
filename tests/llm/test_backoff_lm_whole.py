"""Every training n-gram is a state."""

import zlib

import pytest

from crowdtide.llm.queries import QUERIES

from .test_backoff_lm import Plain


def test_rare_passage(spark, tmp_path):
    passage = "quick zebras vex jolly wizards"
    docs = [(k, f"filler words number {k}") for k in range(40)] + [(101, passage), (102, passage)]
    held = [d for d in range(200, 260) if zlib.crc32(str(d).encode()) % 10 == 0][0]
    train = [(d, t) for d, t in docs if zlib.crc32(str(d).encode()) % 10]
    assert sum(t == passage for _, t in train) >= 1
    docs.append((held, passage))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in QUERIES["op10_lm_scoring"](spark, str(tmp_path)).collect()}
    plain = Plain([t for _, t in train], 3, 1, 40.0)
    assert got[held] == pytest.approx(plain.text(passage))
    assert got[held] > Plain([t for _, t in train], 3, 10, 40.0).text(passage)
    words = [*plain.c, "never seen"]
    for h in (["<s>"], ["<s>", "quick"], ["quick", "zebras"], ["never", "seen"]):
        assert sum(plain.p(h, w) for w in words) == pytest.approx(1.0)
