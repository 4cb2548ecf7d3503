"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on statistics of labelled texts; every path from a root is a rule, a conjunction of
comparisons. A logistic regression with an L1 penalty weighs the rules and drops most of them. Those that
stay are compiled into Spark column expressions, so scoring a table is a projection over its statistics.

Null and empty texts have statistics 0 and get a score as any other; repeated rows get equal scores; an empty table
gives an empty result. Of a doc_id with two labels the lower one counts, and each of its rows is learnt from; null
ids, and labels other than 0 and 1, are not learnt from. Only doc_id and text are read, extra columns stay as they are (names
hf_* are this module's own).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import exp

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, materialise, one_order
from .stats import NAMES, text_stats

MOST_LABELS = 20_000  # labelled rows that trees and weights are fitted on
TREES, DEPTH, PENALTY = 24, 3, 0.002
THRESHOLD = 0.3

Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", bound), all of which hold


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, stats: str) -> Column:
        """Probability of label 1 as a column over the struct column `stats`."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score_row(self, stats: dict[str, float]) -> float:
        """The same for one row of statistics."""
        ok = lambda s, op, x: stats[s] <= x if op == "<=" else stats[s] > x
        return 1 / (1 + exp(-self.intercept - sum(w for r, w in zip(self.rules, self.weights, strict=True) if all(ok(*c) for c in r))))


def holds(rule: Rule, stats: str) -> Column:
    whole = F.lit(True)
    for name, op, bound in rule:
        value = F.col(f"{stats}.{name}")
        whole = whole & (value <= bound if op == "<=" else value > bound)
    return whole


def paths(tree: str, names: tuple[str, ...]) -> list[Rule]:
    """All root-to-node paths of a tree's printed form, which has one If or Else line for each node."""
    found, above = [], []
    for line in tree.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line):
            depth = len(m[1])
            above = [c for c in above if c[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            found.append(tuple(c for _, c in above))
    return found


def fit_rules(rows: DataFrame, stats: str = "stats", label: str = "label", seed: int = 42) -> RuleModel:
    """rows: statistics and a label 0 or 1, a bounded sample; its order and partitions don't matter. A model without
    rules if there is one label only or no row."""
    rows = one_order(rows.select(*[F.col(f"{stats}.{n}").alias(n) for n in NAMES], F.col(label).cast("double").alias("label")))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or ones in (0, n):
        return RuleModel((), (), -4.0 if n and not ones else 4.0)
    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=max(2, n // 500), subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = tuple(dict.fromkeys(r for tree in forest.trees for r in paths(tree.toDebugString, NAMES)))
    facts = rows.select("label", *[holds_flat(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    facts = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(facts).select("label", "features")
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(facts)
    kept = [(r, w) for r, w in zip(rules, fitted.coefficients.toArray().tolist(), strict=True) if abs(w) > 1e-9]
    return RuleModel(tuple(r for r, _ in kept), tuple(w for _, w in kept), fitted.intercept)


def holds_flat(rule: Rule) -> Column:
    whole = F.lit(True)
    for name, op, bound in rule:
        whole = whole & (F.col(name) <= bound if op == "<=" else F.col(name) > bound)
    return whole


def learnt_from(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """(doc_id, label) of at most about `most` labelled rows that are not held out; of two labels the lower one."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    return bounded_sample(known, most, "doc_id")


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs. The model is fitted on at most about
    `most` labelled rows that are not held out; every row is scored, from its text alone."""
    measured = materialise(docs.select("doc_id", text_stats(F.col("text")).alias("stats")))
    model = fit_rules(measured.join(learnt_from(labels, most), "doc_id"))
    return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score("stats").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """docs without the rows whose score is under the threshold. Texts are measured once more, so the rows
    need no key."""
    sample = docs.select("doc_id", "text").join(learnt_from(labels, most), "doc_id").select("label", text_stats(F.col("text")).alias("stats"))
    model = fit_rules(sample)
    measured = docs.withColumn("hf_stats", text_stats(F.col("text")))
    return measured.where(model.score("hf_stats") >= THRESHOLD).drop("hf_stats")
