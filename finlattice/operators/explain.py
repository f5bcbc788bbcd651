"""Shapley values of forests and boosted trees.

What a tree says of a row is split among its features as Shapley values of the game in which an
unknown feature sends a row down both branches, by the shares of training rows that went there (the
path-dependent expectation).  For each leaf only the features on its path play, and the sum over all
their subsets is a polynomial whose coefficients follow feature by feature: work is leaves times the
square of the depth, not two to the number of features.

A model's nodes are read from where Spark saves them; of a forest the probability of class 1 is
explained, of boosted trees the margin.  Leaves with their paths are broadcast, at most `most_leaves`;
rows are explained batch by batch where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch_folder, unused

MOST_LEAVES = 200_000


class Leaf(NamedTuple):
    """value: of the leaf, weighted; features on its path, each with the range (low, high] and the share of rows that stay in it."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def leaves_of(nodes: dict[int, tuple], weight: float) -> list[Leaf]:
    """nodes: id to (value, rows, left, right, feature, threshold); left is negative in a leaf."""
    out, stack = [], [(0, {})]
    while stack:
        at, path = stack.pop()
        value, rows, left, right, feature, threshold = nodes[at]
        if left < 0:
            named = sorted(path.items())
            out.append(Leaf(weight * value, tuple(f for f, _ in named), *(tuple(s[i] for _, s in named) for i in range(3))))
            continue
        low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
        for child, edges in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
            stack.append((child, path | {feature: (*edges, share * nodes[child][1] / rows)}))
    return out


def leaves(model, spark) -> list[Leaf]:
    """Of a fitted classifier of Spark ML with trees without categories."""
    path = scratch_folder(spark, "trees")
    model.write().save(path)
    boosted = not hasattr(model, "numClasses") or model.__class__.__name__.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1 / len(model.trees)] * len(model.trees)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # a row a node
    trees: list[dict[int, tuple]] = [{} for _ in weights]
    for r in rows:
        value = r.prediction if boosted else r.impurityStats[1] / max(sum(r.impurityStats), 1e-300)
        if r.split.numCategories > 0:
            raise ValueError("categorical splits have no thresholds")
        threshold = r.split.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else math.nan
        trees[r.treeID][r.id] = (value, float(r.rawCount), r.leftChild, r.rightChild, r.split.featureIndex, threshold)
    return [leaf for nodes, w in zip(trees, weights, strict=True) for leaf in leaves_of(nodes, w)]


def expected(paths: list[Leaf]) -> float:
    """What is said of a row of which nothing is known."""
    return sum(leaf.value * math.prod(leaf.share) for leaf in paths)


def values(paths: list[Leaf], x: np.ndarray) -> np.ndarray:
    """rows x features: Shapley values; with the expectation they add up to the prediction."""
    out = np.zeros(x.shape)
    for leaf in paths:
        m = len(leaf.features)
        if not m:
            continue
        own = x[:, leaf.features]
        stays = (own > leaf.low) & (own <= leaf.high)
        # coefficients, by the number of known features, of the product of (share + stays * t)
        poly = np.zeros((m + 1, len(x)))
        poly[0] = 1
        for j, share in enumerate(leaf.share):
            poly[1 : j + 2] = poly[1 : j + 2] * share + poly[: j + 1] * stays[:, j]
            poly[0] *= share
        weight = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
        for j, (feature, share) in enumerate(zip(leaf.features, leaf.share, strict=True)):
            known = np.empty((m, len(x)))  # the product without this factor: divided by (share + t)
            known[m - 1] = poly[m]
            for k in range(m - 1, 0, -1):
                known[k - 1] = poly[k] - share * known[k]
            total = weight @ np.where(stays[:, j], known, poly[:m] / share)
            out[:, feature] += leaf.value * (stays[:, j] - share) * total
    return out


def shapley_values(model, df: DataFrame, features: list[str], into: str = "shapley", most_leaves: int = MOST_LEAVES) -> DataFrame:
    """df with `into` (expected, and an array of a value for each feature in order); null where a feature is."""
    paths = leaves(model, df.sparkSession)
    if len(paths) > most_leaves:
        raise ValueError(f"{len(paths)} leaves are more than {most_leaves}")
    sent = df.sparkSession.sparkContext.broadcast(paths)

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            some, found = ~np.isnan(x).any(axis=1), [None] * len(x)
            for i, row in zip(np.flatnonzero(some), values(sent.value, x[some]), strict=True):
                found[i] = row.tolist()
            yield pd.Series(found, dtype=object)

    return df.withColumn(into, F.struct(F.lit(expected(paths)).alias("expected"), explain(*[F.col(f).cast("double") for f in features]).alias("values")))


def importance(model, df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance, mean): the mean size, and the mean, of each feature's Shapley values over df."""
    into = unused(df, "_shapley")
    rows = shapley_values(model, df, features, into).select(F.col(f"{into}.values").alias("v")).where("v IS NOT NULL")
    means = rows.agg(*[f(c).alias(f"{name}{i}") for i in range(len(features)) for name, f, c in (("s", F.avg, F.abs(F.get("v", F.lit(i)))), ("m", F.avg, F.get("v", F.lit(i))))])
    return means.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"s{i}").alias("importance"), F.col(f"m{i}").alias("mean")) for i, f in enumerate(features)])).alias("r")).select("r.*")
