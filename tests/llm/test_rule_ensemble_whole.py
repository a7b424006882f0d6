"""The lasso sees every path of the trees."""

from crowdtide.llm import rule_ensemble
from crowdtide.llm.rule_ensemble import Rule, fit


def test_last_rules(spark, monkeypatch):
    useful = Rule((("s_a", True, 50.0),))
    useless = [Rule((("s_b", True, float(k)),)) for k in range(150)]
    monkeypatch.setattr(rule_ensemble, "tree_rules", lambda forest, names: [*useless, useful])
    rows = spark.createDataFrame([(float(k), float(k * 37 % 151), int(k > 50)) for k in range(100)], "s_a double, s_b double, quality int")
    assert useful in [r for r, _ in fit(rows).rules]
