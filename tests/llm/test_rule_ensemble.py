"""Rule ensemble: held-out accuracy, compiled scores equal a plain evaluation, odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from crowdtide.llm.rule_ensemble import Ensemble, Rule, classify, fit, statistics

DIR = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    scored, model = classify(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    ones = [r for r in rows if r.quality == 1]
    zeros = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == 1 for r in ones) / len(ones) > 0.95
    assert sum(r.predicted == 0 for r in zeros) / len(zeros) > 0.85
    assert 0 < len(model.rules) <= 120
    stats = statistics(docs.limit(50)).withColumn("score", model.score()).collect()
    for r in stats:
        total = model.intercept + sum(w for rule, w in model.rules if all((r[n] > v) == above for n, above, v in rule.tests))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "w " * 5000, "z"), (3, "w " * 5000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (3, 1)], "doc_id long, quality int")
    rows = classify(docs, labels)[0].collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert classify(docs.limit(0), labels)[0].count() == 0
    assert fit(statistics(docs).withColumn("quality", F.lit(1))).rules == ()
    assert Ensemble(((Rule((("s_words", True, 1.0),)), 2.0),), -1.0).score() is not None
