"""Own columns that are called like the operators' helpers stay as they are."""

import pytest
from pyspark.sql import functions as F

from crowdtide.llm import divergence, fuzzy_lines, winnowing

NAMES = ("_id", "_h", "gone", "h", "lines", "_id2", "_h2", "n", "at", "key")
ROWS = [(k, " ".join(f"word{k} {x}" for x in "this is a line of quite plain words and nothing else that could be odd here or there".split()) + "\nthe same five words again\n", "en") for k in range(6)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.select("*", *[F.concat(F.lit(f"own {n} "), "doc_id").alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("a", " ".join(ROWS[2][1].split()[:14]))], "item_id string, text string")


def kept(df, n):
    rows = df.collect()
    assert len(rows) == n and all(r[x] == f"own {x} {r.doc_id}" for r in rows for x in NAMES)
    return rows


def test_quality_rules(docs):
    kept(divergence.keep_good(docs), divergence.measure(docs).where("kept").count())


def test_decontamination(docs, benchmark):
    assert {r.doc_id for r in kept(winnowing.decontaminate(docs, benchmark), 5)} == {0, 1, 3, 4, 5}
    assert {r.doc_id for r in kept(winnowing.contamination(docs, benchmark), 6) if r.contaminated} == {2}


def test_line_dedup(docs):
    rows = kept(fuzzy_lines.deduplicate(docs), 6)
    assert sum("the same five words again" in r.text for r in rows) == 1
