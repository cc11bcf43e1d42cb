"""Dependency-tree features over token arrays (struct i, head, dep, pos, is_punct, is_space); a root is its own head."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dependency labels that open a clause.
CLAUSES = ("acl", "relcl", "ccomp", "xcomp", "advcl")
FEATURES = (
    "max_dependency_depth", "mean_dependency_depth", "dependency_tree_height", "depth_variance", "acl_count", "relcl_count", "ccomp_count",
    "xcomp_count", "advcl_count", "clause_nesting_depth", "mean_dependency_distance", "max_dependency_distance", "long_dependency_ratio",
    "amod_count", "advmod_count", "nmod_count", "compound_count", "modifier_density", "coordination_count", "max_branching_factor",
)


def _levels(heads: list[int], ones: np.ndarray) -> np.ndarray:
    """For each token the sum of ones over its path to the root (itself included), by pointer doubling; cycles end after log2(n) steps."""
    head = np.array(heads)
    n = len(head)
    head = np.where((head < 0) | (head >= n), np.arange(n), head)
    total, up = ones.astype(np.int64), head
    root = head == np.arange(n)
    total = np.where(root, 0, total)
    for _ in range(max(n, 1).bit_length()):
        total, up = total + total[up], up[up]
    return total + ones[up]


def clause_features(heads: list[int], deps: list[str]) -> list[float]:
    """The FEATURES of one sentence; zeros for an empty one."""
    n = len(heads)
    if not n:
        return [0.0] * len(FEATURES)
    depth = _levels(heads, np.ones(n, np.int64)) - 1
    nesting = _levels(heads, np.array([d in CLAUSES for d in deps], np.int64))
    distance = np.abs(np.arange(n) - np.array(heads))
    arcs = distance[distance > 0]
    children = np.bincount([h for k, h in enumerate(heads) if h != k], minlength=1)
    count = {d: float(deps.count(d)) for d in (*CLAUSES, "amod", "advmod", "nmod", "compound", "conj", "cc")}
    modifiers = count["amod"] + count["advmod"] + count["nmod"]
    return [
        float(depth.max()), float(depth.mean()), float(depth.max() + 1), float(depth.var()), count["acl"], count["relcl"], count["ccomp"],
        count["xcomp"], count["advcl"], float(nesting.max()), float(arcs.mean()) if len(arcs) else 0.0, float(arcs.max()) if len(arcs) else 0.0,
        float((arcs >= 5).mean()) if len(arcs) else 0.0, count["amod"], count["advmod"], count["nmod"], count["compound"], modifiers / n,
        count["conj"] + count["cc"], float(children.max()) if len(children) else 0.0,
    ]


def with_clause_features(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """df with one double column for each of FEATURES."""

    def features(heads: pd.Series, deps: pd.Series) -> pd.Series:
        return pd.Series([clause_features([int(x) for x in h], list(d)) for h, d in zip(heads, deps, strict=True)])

    udf = F.pandas_udf(features, "array<double>")
    out = df.withColumn("_f", udf(F.transform(tokens, lambda t: t["head"]), F.transform(tokens, lambda t: t["dep"])))
    return out.select(*df.columns, *(F.col("_f")[k].alias(name) for k, name in enumerate(FEATURES)))


def syntax_depth(tokens: Column) -> Column:
    """Tree depth over tokens that are neither punctuation nor space; a root counts 1."""

    def depth(series: pd.Series) -> pd.Series:
        out = []
        for rows in series:
            heads = [int(r["head"]) for r in rows]
            levels = _levels(heads, np.ones(len(heads), np.int64)) if heads else np.zeros(0)
            out.append(max((int(x) for x, r in zip(levels, rows, strict=True) if not (r["is_punct"] or r["is_space"])), default=0))
        return pd.Series(out, dtype="int64")

    return F.pandas_udf(depth, "long")(tokens)


def attribute_words(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t["pos"].isin("ADJ", "NOUN")))


def gaps(positions: Column) -> Column:
    """Tokens between neighbouring positions of an ordered array, which is bound to a variable so that it is built once."""

    def between(held: Column) -> Column:
        return F.transform(F.slice(held, F.lit(2), F.greatest(F.size(held) - 1, F.lit(0))), lambda p, i: p - F.get(held, i) - 1)

    return F.flatten(F.transform(F.array(positions), between))


def frequency_label(ratio: Column, low: float, high: float) -> Column:
    return F.when(ratio < low, "low").when(ratio < high, "medium").otherwise("high")
