"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on the statistics of labelled documents; every path from a root is a conjunctive rule.  A logistic regression with a lasso penalty over the
rules (as 0/1 columns) keeps few of them.  The kept rules and weights compile into one Spark column expression, so that scoring is a projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import bucket_of, stored, whole

SPACE = r"\x20\x09-\x0D"
# Character classes that statistics count, as patterns.
CLASSES = {"upper": r"\p{Lu}", "digit": r"[0-9]", "symbol": r"[#*$%&|<>=+^~_\\/@{}\[\]]", "stop": r"[.,;:]", "shout": r"[!?]", "mark": r"[^\p{L}\p{N}\s]", "ends": rf"[.!?](?=[{SPACE}]|$)"}
SMALL_WORDS = "the of and to in a is that it for de la que le und die der en el les des un et y von das los est".split()


def statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Replace the text by statistics of it (all doubles); null and empty texts have zeros."""
    df = docs.withColumn("_text", whole(text_column)).drop(text_column)
    df = pin(df, _words=F.array_remove(F.split("_text", f"[{SPACE}]+"), ""), _lines=F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    df = pin(df, _n=F.size("_words").cast("double"), _chars=F.greatest(F.char_length("_text"), F.lit(1)).cast("double"), _distinct=F.size(F.array_distinct("_words")).cast("double"),
             _pairs=F.size(F.array_distinct(F.transform("_words", lambda w, i: F.hash(w, F.try_element_at("_words", i + 2))))).cast("double"),
             _same=F.size(F.filter("_words", lambda w, i: w == F.try_element_at("_words", i + 2))).cast("double"),
             _small=F.size(F.filter("_words", lambda w: F.lower(w).isin(SMALL_WORDS))).cast("double"))
    per_word = F.greatest("_n", F.lit(1.0))
    columns = {
        "s_words": F.log1p("_n"), "s_word_length": F.char_length(F.array_join("_words", "")) / per_word, "s_distinct": F.col("_distinct") / per_word, "s_pairs": F.col("_pairs") / per_word,
        "s_same_next": F.col("_same") / per_word, "s_small": F.col("_small") / per_word, "s_lines": F.size("_lines") / per_word,
        "s_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))) / F.greatest(F.size("_lines"), F.lit(1)),
        **{f"s_{k}": F.regexp_count("_text", F.lit(p)) / F.col("_chars") for k, p in CLASSES.items()},
        "s_bar": F.size(F.filter("_words", lambda w: w == "|")) / per_word,
    }
    df = pin(df, **{k: v.cast("double") for k, v in columns.items()})
    return df.drop("_text", "_words", "_lines", "_n", "_chars", "_distinct", "_pairs", "_same", "_small")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, limit in self.tests:
            out = out & ((F.col(name) > limit) if above else (F.col(name) <= limit))
        return out.cast("double")


@dataclass(frozen=True)
class Ensemble:
    """Compiled model: probability of label 1 as a column over the statistics."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + rule.column() * weight
        return 1 / (1 + F.exp(-total))


def tree_rules(forest: object, names: list[str]) -> list[Rule]:
    """Every path of every tree as a rule; a path that tests a statistic twice in one direction keeps the tighter test."""
    found: dict[Rule, None] = {}
    for tree in forest.trees:
        stack = [(tree._call_java("rootNode"), ())]
        while stack:
            node, tests = stack.pop()
            if tests:
                tight: dict[tuple[str, bool], float] = {}
                for name, above, limit in tests:
                    old = tight.get((name, above))
                    tight[name, above] = limit if old is None else max(old, limit) if above else min(old, limit)
                found[Rule(tuple((n, a, v) for (n, a), v in sorted(tight.items())))] = None
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                name, limit = names[split.featureIndex()], split.threshold()
                stack += [(node.leftChild(), (*tests, (name, False, limit))), (node.rightChild(), (*tests, (name, True, limit)))]
    return list(found)


def fit(labelled: DataFrame, label: str = "quality", trees: int = 12, depth: int = 3, penalty: float = 0.002, max_rows: int = 200_000, seed: int = 7) -> Ensemble:
    """Fit the ensemble to rows of statistics with a 0/1 label.

    The fit uses at most about ``max_rows`` labelled rows, drawn by hash of their values (documented bound; the label's share is kept).  Rows with a null label count
    for none.  Without both labels the score is the share of label 1, or one half without rows.
    """
    names = [c for c in labelled.columns if c.startswith("s_")]
    rows = labelled.where(F.col(label).isin(0, 1)).select(*names, F.col(label).cast("double").alias("label"))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        share = 0.5 if not n else ones / n
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Ensemble((), math.log(share / (1 - share)))
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(*names), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    rows = stored(rows, "labelled")
    frame = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=seed).fit(frame)
    rules = tree_rules(forest, names)
    marked = rows.select("label", F.array(*[r.column() for r in rules]).alias("marks"))
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(marked.select("label", array_to_vector("marks").alias("features")))
    kept = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if abs(w) > 1e-9)
    return Ensemble(kept, float(lasso.intercept))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7) -> tuple[DataFrame, Ensemble]:
    """(doc_id, held_out, score, predicted for every row of ``docs``; the fitted ensemble).

    Labels are learned only where crc32(doc_id) modulo ``folds`` is not ``held``.  A null id is a held-out or training row by the empty text's checksum
    and has no label.  Repeated rows are scored each; several labels of one document are several training rows.  Columns other than doc_id and text are not read.
    """
    stats = stored(statistics(docs.select("doc_id", "text")).withColumn("held_out", bucket_of("doc_id", folds) == held), "statistics")
    known = labels.select("doc_id", label).where(F.col(label).isNotNull() & (bucket_of("doc_id", folds) != held))
    model = fit(stats.where(~F.col("held_out")).join(known, "doc_id"), label)
    scored = stats.select("doc_id", "held_out", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")), model
