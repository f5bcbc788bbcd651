"""Ensemble weights: conditions of optimality, bounds, and the grid."""

import itertools
import math
import random

import numpy as np
import pytest

from finlattice.operators import ml

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def told(spark):
    r = random.Random(5)
    rows = []
    for _ in range(800):
        truth = r.random()
        y = float(r.random() < truth)
        noisy = [min(0.99, max(0.01, truth + r.gauss(0, s))) for s in (0.1, 0.15)]
        rows.append((*noisy, r.random(), 1 - truth, y))
    return rows, spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES) + ", label double").persist()


def loss_and_gradient(rows, w):
    x, y = np.array(rows)[:, :4], np.array(rows)[:, 4]
    p = x @ w
    return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(), ((-y / p + (1 - y) / (1 - p))[:, None] * x).mean(axis=0)


@pytest.mark.parametrize("low,high", [(0.0, 1.0), (0.05, 0.4), (0.25, 0.25)])
def test_conditions_of_optimality(told, low, high):
    rows, df = told
    w, loss = ml.simplex_weights(df, NAMES, low=low, high=high)
    w = np.array(w)
    want, g = loss_and_gradient(rows, w)
    assert loss == pytest.approx(want) and w.sum() == pytest.approx(1) and (w >= low - 1e-12).all() and (w <= high + 1e-12).all()
    inside = (w > low + 1e-6) & (w < high - 1e-6)
    price = g[inside].mean() if inside.any() else np.median(g)
    assert np.allclose(g[inside], price, atol=1e-5)  # one price where the bounds don't bind
    if low < high:
        assert (g[w <= low + 1e-6] >= price - 1e-5).all() and (g[w >= high - 1e-6] <= price + 1e-5).all()


def test_not_worse_than_a_grid(told):
    rows, df = told
    _, loss = ml.simplex_weights(df, NAMES)
    grid = [np.array(g) / 10 for g in itertools.product(range(11), repeat=4) if sum(g) == 10]
    assert loss <= min(loss_and_gradient(rows, g)[0] for g in grid) + 1e-9
    assert ml.simplex_weights(df, ["a"]) == ([1.0], pytest.approx(loss_and_gradient(rows, np.array([1.0, 0, 0, 0]))[0]))


def test_nearest_point_of_the_simplex():
    r = np.random.default_rng(1)
    for _ in range(30):
        v, low, high = r.standard_normal(5), np.full(5, 0.05), np.full(5, 0.5)
        x = ml.on_simplex(v, low, high)
        assert x.sum() == pytest.approx(1) and (x >= low - 1e-12).all() and (x <= high + 1e-12).all()
        for other in r.dirichlet(np.ones(5), 200):
            if (other >= low).all() and (other <= high).all():
                assert ((x - v) ** 2).sum() <= ((other - v) ** 2).sum() + 1e-9


def test_odd_tables(told):
    _, df = told
    w, loss = ml.simplex_weights(df.limit(0), ["a", "b"])
    assert w == [0.5, 0.5] and math.isnan(loss)
    with pytest.raises(ValueError):
        ml.simplex_weights(df, ["a", "b"], high=0.4)
    sure = df.selectExpr("label AS a", "1 - label AS b", "label", "CAST(NULL AS DOUBLE) AS c")
    assert ml.simplex_weights(sure, ["a", "b"])[0] == pytest.approx([1, 0], abs=1e-6) and ml.simplex_weights(sure, ["a", "c"])[0] == [0.5, 0.5]
