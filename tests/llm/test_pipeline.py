"""The pipeline stage by stage: decisions take effect, columns stay, every stage agrees with its operator's brute force."""

import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from crowdtide.llm import divergence
from crowdtide.llm.common import stored, table

from .test_chosen_path import brute as jaccard
from .test_fuzzy_lines import norm
from .test_packing import checked
from .test_winnowing import brute as hits

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        after[name] = stored(stage(spark, docs, DIR), f"test-{name}")
        if name != "packing":
            assert after[name].columns == docs.columns
        docs = after[name]
    first = table(spark, DIR, "documents")
    good = {r.doc_id for r in divergence.measure(first).where("kept").collect()}
    assert {r.doc_id for r in after["quality_rules"].collect()} == good
    lines = [norm(x) for r in after["line_dedup"].collect() for x in r.text.split("\n") if len(norm(x).split(" ")) >= 5]
    assert len(lines) == len(set(lines))
    assert after["line_dedup"].where(F.col("n_chars") != F.char_length("text")).count() == 0
    before = [(r.doc_id, r.text) for r in after["line_dedup"].collect()]
    classes = {c for _, c, _ in jaccard(before)}
    left = [(r.doc_id, r.text) for r in after["near_duplicates"].collect()]
    assert {d for d, _ in left} == classes
    items = [tuple(r) for r in table(spark, DIR, "benchmark").collect()]
    clean = {h[0] for h in hits(left, items) if not h[5]}
    final = [(r.doc_id, r.text) for r in after["decontamination"].collect()]
    assert {d for d, _ in final} == clean
    checked(after["packing"].collect(), final, 4096)


def test_registered(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert len(rows) > 0 and zlib.crc32(np.array([2], "<u4").tobytes()) >= 0
