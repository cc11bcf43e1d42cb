"""Quality classifier: a sparse ensemble of conjunctive rules.

Statistics of a text (one narrow Arrow pass over whole texts) feed a small
random forest; every path from a root is a conjunction of thresholds, a
candidate rule.  A logistic model with a lasso penalty over the rules keeps
few of them, and the model is compiled to one Spark column expression.

Fitting reads at most ``max_labels`` labelled rows, those with the smallest
hash of doc_id: a documented bound on the fit alone.  Scoring shuffles nothing.

Defined cases: null and empty texts have all statistics zero and are scored;
a very long text is read whole, its counts of words held at once; with labels of
one kind only (or none) the score is their smoothed share of 1; a score that
equals the threshold predicts 1; repeated rows score alike and train each; a
doc_id with unlike labels counts as 0; rows with null label or doc_id don't
train, and a null doc_id is scored and never held out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, cut, table

MAX_LABELS = 20_000
TREES = 12
DEPTH = 4
LASSO = 0.002
THRESHOLD = 0.3
STATISTICS = (
    "log_words",
    "mean_word",
    "upper_share",
    "digit_share",
    "mark_share",
    "bang_per_word",
    "pipe_per_word",
    "stop_per_word",
    "comma_per_word",
    "distinct_words",
    "repeated_lines",
    "words_per_line",
    "top_word_share",
    "other_share",
)
Rule = tuple[tuple[str, str, float], ...]


def text_statistics(text: str | None) -> list[float]:
    """The STATISTICS of one text."""
    text = text or ""
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = int(data[65:91].sum() + data[97:123].sum())
    solid = max(int(data.sum() - data[9:14].sum() - data[32]), 1)
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    return [
        math.log1p(n),
        solid / n,
        int(data[65:91].sum()) / max(letters, 1),
        int(data[48:58].sum()) / solid,
        int(sum(data[ord(c)] for c in "#*$%&|<>")) / solid,
        int(data[ord("!")]) / n,
        int(data[ord("|")]) / n,
        int(data[ord(".")]) / n,
        int(data[ord(",")]) / n,
        len(counts) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        n / max(len(lines), 1),
        max(counts.values()) / n,
        int(data[128:].sum()) / solid,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, each of STATISTICS) for each row of docs."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = np.array([text_statistics(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(x)) for x in rows.T)], names=["doc_id", *STATISTICS])

    schema = "doc_id long, " + ", ".join(f"{x} double" for x in STATISTICS)
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), of, schema)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1, over columns named as STATISTICS."""
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            margin = margin + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def condition(rule: Rule) -> Column:
    parts = [F.col(name) <= value if sign == "<=" else F.col(name) > value for name, sign, value in rule]
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def tree_rules(description: str, names: tuple[str, ...] = STATISTICS) -> set[Rule]:
    """The conjunctions of all nodes under the root, from a tree's printed form; repeated bounds on a statistic are tightened."""
    found: set[Rule] = set()
    path: list[tuple[int, str, str, float]] = []
    for line in description.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            indent = len(m[1])
            while path and path[-1][0] >= indent:
                path.pop()
            path.append((indent, names[int(m[2])], m[3], float(m[4])))
            bounds: dict[tuple[str, str], float] = {}
            for _, name, sign, value in path:
                tighter = min if sign == "<=" else max
                bounds[name, sign] = tighter(bounds.get((name, sign), value), value)
            found.add(tuple(sorted((name, sign, value) for (name, sign), value in bounds.items())))
    return found


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labels: int = MAX_LABELS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """A model from docs (doc_id, text) and labels (doc_id, label_col of 0 or 1)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.min(label_col).cast("double").alias("label"))
    known = cut(known)
    # About twice max_labels ids pass a threshold on their hash, which bounds what the last step of the ranking reads.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = known.where(place < F.lit(2.0 * max_labels / max(known.count(), 1) * (1 << 30)))
    # Broadcast: at most max_labels rows, a parameter.
    chosen = F.broadcast(cut(near.orderBy(place, "doc_id").limit(max_labels)))
    rows = with_statistics(docs.join(chosen, "doc_id", "left_semi")).join(chosen, "doc_id")
    # The statistics of all chosen rows, numbers alone, are dealt to one partition in a fixed order: equal data give an equal model.
    rows = cut(rows.repartition(1).sortWithinPartitions("doc_id", *STATISTICS))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = math.log((ones + 1) / (n - ones + 1))
    if ones in (0, n):
        return RuleModel(prior, ())
    vectors = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=42).fit(vectors)
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees)))
    if not rules:
        return RuleModel(prior, ())
    fired = cut(rows.select("label", array_to_vector(F.array(*(condition(r).cast("double") for r in rules))).alias("features")))
    model = LogisticRegression(maxIter=60, regParam=lasso, elasticNetParam=1.0).fit(fired)
    weights = model.coefficients.toArray()
    return RuleModel(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = with_statistics(docs).select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
