"""Panels, chronological splits, tree models on Spark ML, ensembles and their weights."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labelled_panel(panel: DataFrame, bars: DataFrame, ahead: int = 5, threshold: float = 0.0, key: str = "symbol", date: str = "bar_date", price: str = "close") -> DataFrame:
    """Factor rows with the forward return and its class; rows with any gap go."""
    w = Window.partitionBy(key).orderBy(date)
    forward = bars.select(key, date, (F.lead(price, ahead).over(w) / F.nullif(F.col(price), F.lit(0.0)) - 1).alias("forward"))
    return panel.join(forward, [key, date]).dropna("any").withColumn("label", (F.col("forward") > threshold).cast("double"))


def chronological_split(df: DataFrame, train: float = 0.7, date: str = "bar_date") -> tuple[DataFrame, DataFrame]:
    """Rows up to the day by which a share of `train` has passed, and the later ones.

    The day comes from counts by day, so no task sorts all rows.
    """
    days = df.groupBy(date).count()
    upto = days.withColumn("_s", F.sum("count").over(Window.orderBy(date)) / F.sum("count").over(Window.partitionBy()))  # a row a day
    cut = upto.where(F.col("_s") <= train).agg(F.max(date)).first()[0]
    return (df.limit(0), df) if cut is None else (df.where(F.col(date) <= F.lit(cut)), df.where(F.col(date) > F.lit(cut)))


def folds(df: DataFrame, n: int = 5, date: str = "bar_date") -> list[tuple[DataFrame, DataFrame]]:
    """Expanding windows: fold i trains on the first i of n + 1 spans of days and tests on the next."""
    days = df.select(date).distinct().withColumn("_t", F.ntile(n + 1).over(Window.orderBy(date)))  # a row a day
    marked = df.join(F.broadcast(days), date)
    return [(marked.where(F.col("_t") <= i).drop("_t"), marked.where(F.col("_t") == i + 1).drop("_t")) for i in range(1, n + 1)]


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def train_forest(df: DataFrame, features: list[str], trees: int = 200, depth: int = 8, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(assembled(df, features))


def train_boosted(df: DataFrame, features: list[str], rounds: int = 100, depth: int = 5, rate: float = 0.05, seed: int = 42, validation: str | None = None):
    """Gradient-boosted trees; validation: a boolean column that marks the rows that stop the rounds early."""
    from pyspark.ml.classification import GBTClassifier

    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    return (model.setValidationIndicatorCol(validation) if validation else model).fit(assembled(df, features))


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, map(float, model.featureImportances.toArray()), strict=True), key=lambda p: (-p[1], p[0]))


def eliminate(df: DataFrame, features: list[str], keep: int = 10, step: float = 0.1, n: int = 3, **how) -> list[str]:
    """Recursive elimination: drops the least important tenth while the mean AUC over the folds doesn't fall."""
    best, best_auc, now = list(features), -1.0, list(features)
    while True:
        scores = []
        for train, test in folds(df, n):
            model = train_forest(train, now, **how)
            scores.append(auc(probabilities(model, test, now, "p"), "p").first()[0] or 0.5)
        mean = sum(scores) / len(scores)
        if mean >= best_auc:
            best, best_auc = now, mean
        if len(now) <= keep:
            return best
        ranked = [f for f, _ in importances(train_forest(df, now, **how), now)]
        now = ranked[: max(keep, len(now) - max(1, int(step * len(features))))]


def probabilities(model, df: DataFrame, features: list[str], name: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(assembled(df, features))
    return out.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def auc(df: DataFrame, score: str | Column, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """The share of (positive, negative) pairs in right order, ties half, from counts by score; of each group, if by is given."""
    s, by = F.col(score) if isinstance(score, str) else score, by or []
    at = df.groupBy(*by, s.alias("s")).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    spans = at.withColumn("g", F.floor(F.col("s") * 256))  # two levels of running sums, so no task holds all scores
    low = spans.groupBy(*by, "g").agg(F.sum("n").alias("gn")).withColumn("before", F.coalesce(F.sum("gn").over(Window.partitionBy(*by).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = spans.withColumn("inner", inner).join(low, [*by, "g"])
    return rows.groupBy(*by).agg((F.sum(F.col("p") * (F.col("before") + F.col("inner") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auc"))


def weighted(names: list[str], weights: list[float]) -> Column:
    total = sum(weights) or 1.0
    return reduce(lambda a, b: a + b, [F.col(n) * (w / total) for n, w in zip(names, weights, strict=True)])


def best_weights(df: DataFrame, names: list[str], steps: int = 11, label: str = "label") -> tuple[list[float], float]:
    """The weights on a grid that give the highest AUC, by exact scores; all grid points are scored in one job."""
    grid = _grid(len(names), steps - 1)
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), weighted(names, [float(x) for x in g]).alias("s")) for i, g in enumerate(grid)]))
    scores = auc(df.select(label, points.alias("q")).select(label, "q.i", "q.s"), "s", label, by=["i"])
    i, value = scores.orderBy(F.desc("auc"), "i").first()
    return [x / (steps - 1) for x in grid[i]], value


def _grid(parts: int, total: int) -> list[tuple[int, ...]]:
    if parts == 1:
        return [(total,)]
    return [(x, *rest) for x in range(total, -1, -1) for rest in _grid(parts - 1, total - x)]


def on_simplex(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The nearest point with sum 1 between the bounds: all values moved by one amount and cut off, found by halving."""
    a, b = (v - high).min() - 1, (v - low).max() + 1
    for _ in range(200):
        c = (a + b) / 2
        a, b = (c, b) if np.clip(v - c, low, high).sum() > 1 else (a, c)
    return np.clip(v - (a + b) / 2, low, high)


def _quadratic_step(w: np.ndarray, g: np.ndarray, h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The point of the simplex with the least g (x - w) + (x - w) h (x - w) / 2, by projected gradients with momentum."""
    rate = 1 / max(np.linalg.eigvalsh(h)[-1], 1e-12)
    x = y = w
    t = 1.0
    for _ in range(5000):
        new = on_simplex(y - rate * (g + h @ (y - w)), low, high)
        if (y - new) @ (new - x) > 0:
            t = 1.0  # momentum led uphill
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        x, y, moved = new, new + (last - 1) / t * (new - x), np.abs(new - x).max()
        if moved < 1e-13:
            break
    return x


def simplex_weights(df: DataFrame, names: list[str], label: str = "label", low: float = 0.0, high: float = 1.0, rounds: int = 50, least: float = 1e-9) -> tuple[list[float], float]:
    """Weights between the bounds with sum 1 of least mean log loss, and that loss, by sequential quadratic programming.

    The loss is convex in the weights.  Each round is one job that adds up loss, gradient and Hessian: as
    many numbers as pairs of models, whatever the rows.  Probabilities are kept `least` off 0 and 1; rows
    with a missing value are left out, and without rows all weigh alike.
    """
    k = len(names)
    if not k * low <= 1 <= k * high:
        raise ValueError(f"no {k} weights between {low} and {high} add up to 1")
    bounds = np.full(k, low), np.full(k, high)
    rows = df.dropna("any", subset=[*names, label]).select(F.col(label).cast("double").alias("y"), *[F.greatest(F.lit(least), F.least(F.lit(1 - least), F.col(n).cast("double"))).alias(f"p{i}") for i, n in enumerate(names)])

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        p = reduce(lambda a, b: a + b, [F.col(f"p{i}") * float(x) for i, x in enumerate(w)])
        y = F.col("y")
        first = -(y / p) + (1 - y) / (1 - p)
        second = y / (p * p) + (1 - y) / ((1 - p) * (1 - p))
        cells = [(i, j) for i in range(k) for j in range(i + 1)]
        loss = F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))
        found = rows.agg(loss, *[F.avg(first * F.col(f"p{i}")) for i in range(k)], *[F.avg(second * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in cells]).first()
        h = np.zeros((k, k))
        for (i, j), v in zip(cells, found[1 + k :], strict=True):
            h[i, j] = h[j, i] = v or 0.0
        return (math.nan if found[0] is None else found[0]), np.array([v or 0.0 for v in found[1 : 1 + k]]), h

    w = on_simplex(np.full(k, 1 / k), *bounds)
    loss, g, h = at(w)
    for _ in range(rounds if loss == loss else 0):
        step = _quadratic_step(w, g, h + 1e-12 * np.eye(k), *bounds) - w
        if -(g @ step) < 1e-12:
            break
        size = 1.0
        while (new := at(w + size * step))[0] > loss + 1e-4 * size * (g @ step) and size > 1e-6:
            size /= 2
        if new[0] >= loss:
            break
        w, (loss, g, h) = w + size * step, new
    return w.tolist(), loss


def stack(train: DataFrame, trainers: list, features: list[str], n: int = 5):
    """A logistic model on out-of-fold probabilities of the base models, and the base models on all rows."""
    from pyspark.ml.classification import LogisticRegression

    parts = []
    for fit, test in folds(train, n):
        for i, trainer in enumerate(trainers):
            test = probabilities(trainer(fit, features), test, features, f"base_{i}")
        parts.append(test)
    names = [f"base_{i}" for i in range(len(trainers))]
    held = assembled(reduce(DataFrame.unionByName, parts).select("label", *names), names)
    meta = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.1).fit(held)
    return meta, [t(train, features) for t in trainers], names


def holdout_metrics(df: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    """Accuracy, precision, recall, F1 and MSE of probabilities against 0/1 labels."""
    yes, y = F.col(score) >= 0.5, F.col(label) == 1
    sums = df.agg(F.avg((yes == y).cast("double")).alias("accuracy"), F.count_if(yes & y).alias("tp"), F.count_if(yes).alias("said"), F.count_if(y).alias("true"), F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("mse"))
    p, r = F.col("tp") / F.nullif(F.col("said"), F.lit(0)), F.col("tp") / F.nullif(F.col("true"), F.lit(0))
    return sums.select("accuracy", p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"), "mse")
