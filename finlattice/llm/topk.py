"""Exact top-k search: a Voronoi kNN join on integer inner products.

Every vector goes to the cell of its nearest pivot.  A cell's summary holds its row count and
radius.  For a query q and a row x of a cell with pivot p and radius r,
    q.p - |q| r  <=  q.x  <=  q.p + |q| r,
so the summaries bound a query's k-th best score from below.  Each query is first solved in its
own cell, which raises that bound, and is then replicated only to cells whose upper bound reaches
it; a cell is solved by one exact matrix product per block, and the best k of all blocks remain.
Only queries are replicated, and only where they may find something.

Cells are split by hash into blocks of about BLOCK rows and their queries into blocks of QUERIES,
so that a vector that a third of the rows share fills many tasks, not one.  What is broadcast and
collected are `pivots` vectors and as many summaries.

Components are quantised to floor(256 * x), x as double.  Scores are exact: blocks whose scores could
pass 2^53 are multiplied as 64-bit integers, and vectors whose scores could pass 2^63 are an error.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor
do rows without an id; shorter vectors count as padded with zeros; ties go to the smaller id; rows
that share the query's id are the query's own, and the least of its vectors asks; a query without other rows has no result row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

PIVOTS = 64
BLOCK = 8192
QUERIES = 1024
#: Below every score: marks the query's own row.
OWN = -(2**62)


class Cells:
    """Pivots, and the summaries once they are known."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.counts = np.zeros(len(pivots), np.int64)
        self.radii = np.zeros(len(pivots))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = (x**2).sum(axis=1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(axis=1)[None]
        cell = square.argmin(axis=1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of each query (row) in each cell (column), with a margin for rounding."""
        middle = q @ self.pivots.T
        reach = np.linalg.norm(q, axis=1)[:, None] * self.radii[None]
        margin = 1e-9 * (np.abs(middle) + reach) + 1e-6
        return middle - reach - margin, middle + reach + margin

    def at_least(self, low: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that k other rows reach by the summaries alone (one row may be its own)."""
        order = np.argsort(-low, axis=1)
        enough = np.cumsum(self.counts[order], axis=1) > k
        at = enough.argmax(axis=1)
        value = np.take_along_axis(low, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]
        return np.where(enough.any(axis=1), value, -np.inf)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Quantised vectors, one a row, padded to width."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    place = np.arange(width)[None] < sizes[:, None]
    out[place] = np.floor(256.0 * flat)
    return out


def _unpack(rows, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(-1, width)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of x and y."""
    largest = float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1]
    if largest < 2**53:
        return x @ y.T
    if largest >= 2**62:
        raise ValueError("a score may pass the range of a 64-bit integer")
    return x.astype(np.int64) @ y.astype(np.int64).T


def solve(k: int, width: int):
    """Best k of a block of rows for each query of a block."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            rows = rows.sort_values("id")
            ids = rows["id"].to_numpy()
            for q, s in zip(queries["query_id"].to_numpy(), products(_unpack(queries["vector"], width), _unpack(rows["vector"], width)), strict=True):
                s[ids == q] = OWN
                if len(s) > k:  # ids ascend, so of equal scores the first remain
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    above, equal = np.flatnonzero(s > least), np.flatnonzero(s == least)
                    at = np.concatenate([above, equal[: k - len(above)]])
                else:
                    at = np.arange(len(s))
                out += [(q, ids[i], int(s[i])) for i in at if s[i] > OWN]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): for each row where `queries` holds, the k other rows of the highest inner products."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_).isNotNull() & usable(F.col(vector))).select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector"), queries.alias("is_query"))
    width = max(rows.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    sample = rows.select("vector", F.xxhash64("id").alias("h")).orderBy("h", "vector").limit(pivots).collect()
    points = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        points[i, : len(r.vector)] = np.floor(256.0 * np.asarray(r.vector, float))
    cells = Cells(np.unique(points, axis=0)) if len(sample) else Cells(np.zeros((1, width)))
    sent = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            cell, far = sent.value.assign(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2), pa.array(cell, pa.int32()), pa.array(far)], ["id", "vector", "is_query", "cell", "far"])

    placed = materialise(rows.mapInArrow(assign, "id long, vector binary, is_query boolean, cell int, far double"), "knn-cells")
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        cells.counts[r.cell], cells.radii[r.cell] = r.n, r.far
    known = spark.sparkContext.broadcast(cells)

    blocks = spark.createDataFrame([(i, max(1, -(-int(n) // block))) for i, n in enumerate(cells.counts)], "cell int, blocks int")
    data = placed.join(F.broadcast(blocks), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "vector")

    def search(routed: DataFrame) -> DataFrame:
        """routed: (cell, query_id, vector)."""
        crowd = routed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / QUERIES).cast("int").alias("crowds"))
        asked = routed.join(F.broadcast(crowd), "cell").join(F.broadcast(blocks), "cell")  # a row for each cell
        asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.col("crowds")).cast("int").alias("crowd"), "query_id", "vector")
        held = data.join(F.broadcast(crowd), "cell").select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"), "id", "vector")
        key = ["cell", "block", "crowd"]
        return asked.groupBy(key).cogroup(held.groupBy(key)).applyInPandas(solve(k, width), "query_id long, id long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asking = placed.where("is_query").groupBy(F.col("id").alias("query_id")).agg(F.min(F.struct("vector", "cell")).alias("q")).select("q.cell", "query_id", "q.vector")
    home = materialise(best(search(asking)), "knn-home")
    reached = home.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, ids, vector, reached = (batch.column(i) for i in range(4))
            if not len(cell):
                continue
            low, high = known.value.bounds(_unpack(vector.to_pylist(), width))
            floor = np.fmax(known.value.at_least(low, k), reached.to_numpy(zero_copy_only=False).astype(float))
            go = (high >= floor[:, None]) & (known.value.counts > 0)
            go[np.arange(len(cell)), cell.to_numpy()] = False
            row, to = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), ids.take(pa.array(row)), vector.take(pa.array(row))], ["cell", "query_id", "vector"])

    routed = materialise(asking.join(reached, "query_id", "left").select("cell", "query_id", "vector", "reached").mapInArrow(route, "cell int, query_id long, vector binary"), "knn-routes")
    return best(home.select("query_id", "id", "score").unionByName(search(routed))).select("query_id", "rank", "id", "score")
