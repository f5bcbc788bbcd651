"""Shapley values against sums over all subsets, and against the models' own predictions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from finlattice.operators import explain, ml

FEATURES = list("abcde")


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(3)
    rows = []
    for _ in range(600):
        x = [round(r.random(), 2) for _ in FEATURES]
        rows.append((*x, float(r.random() < 0.05 + 0.6 * (x[0] > 0.5) + 0.3 * (x[1] > 0.4 and x[2] < 0.7))))
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label double").coalesce(2).persist()


def conditional(nodes, x, known, at=0):
    """What a tree says if only some features are known."""
    value, rows, left, right, feature, threshold = nodes[at]
    if left < 0:
        return value
    if feature in known:
        return conditional(nodes, x, known, left if x[feature] <= threshold else right)
    return sum(nodes[c][1] / rows * conditional(nodes, x, known, c) for c in (left, right))


def by_subsets(nodes, x, m):
    out = []
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) * (conditional(nodes, x, {*s, i}) - conditional(nodes, x, set(s))) for k in range(m) for s in itertools.combinations(rest, k)))
    return out


def random_tree(r, m, depth):
    nodes, stack = {}, [(0, 1000.0, 0)]
    ids = itertools.count(1)
    while stack:
        at, rows, d = stack.pop()
        if d == depth or r.random() < 0.15:
            nodes[at] = (r.random(), rows, -1, -1, -1, math.nan)
            continue
        left, right, part = next(ids), next(ids), r.uniform(0.05, 0.95)
        nodes[at] = (0.0, rows, left, right, r.randrange(m), round(r.random(), 1))
        stack += [(left, rows * part, d + 1), (right, rows * (1 - part), d + 1)]
    return nodes


@pytest.mark.parametrize("depth", [0, 1, 3, 6])
def test_values_are_those_of_all_subsets(depth):
    r = random.Random(depth)
    for _ in range(4):
        nodes = random_tree(r, 4, depth)  # features come again on a path
        x = np.round(np.random.default_rng(depth).random((12, 4)), 1)
        paths = explain.leaves_of(nodes, 2.0)
        got = explain.values(paths, x)
        assert explain.expected(paths) == pytest.approx(2 * conditional(nodes, x[0], set()))
        for row, mine in zip(x, got, strict=True):
            assert mine == pytest.approx([2 * v for v in by_subsets(nodes, row, 4)], abs=1e-9)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_values_add_up_to_the_prediction(data, kind):
    model = ml.train_forest(data, FEATURES, 7, 5) if kind == "forest" else ml.train_boosted(data, FEATURES, 6, 3)
    rows = explain.shapley_values(model, ml.probabilities(model, data, FEATURES, "p"), FEATURES).collect()
    for r in rows:
        total = r.shapley.expected + sum(r.shapley["values"])
        assert total == pytest.approx(r.p if kind == "forest" else math.log(r.p / (1 - r.p)) / 2, abs=1e-8)
    told = {r.feature: r for r in explain.importance(model, data, FEATURES).collect()}
    sizes = np.mean([np.abs(r.shapley["values"]) for r in rows], axis=0)
    assert [told[f].importance for f in FEATURES] == pytest.approx(sizes.tolist())
    assert max(told, key=lambda f: told[f].importance) == "a" and told["e"].importance < told["a"].importance


def test_gaps_and_bounds(data):
    model = ml.train_forest(data, FEATURES, 2, 2)
    gap = data.limit(3).withColumn("a", F.when(F.monotonically_increasing_id() == 0, None).otherwise(F.col("a")))
    got = explain.shapley_values(model, gap, FEATURES).collect()
    assert [r.shapley["values"] is None for r in got] == [r.a is None for r in got] and any(r.a is None for r in got)
    assert explain.shapley_values(model, data.limit(0), FEATURES).count() == 0
    with pytest.raises(ValueError):
        explain.shapley_values(model, data, FEATURES, most_leaves=3)
