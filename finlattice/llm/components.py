"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges (a, b), the smallest node that it is connected with.

    Each round is two aggregations and two joins over the edges, written to the shared folder; the
    number of rounds grows with the logarithm of the longest path.  Nothing is collected but whether
    any node isn't settled yet: one with two edges down, or with one down and one up.
    """

    def rounds(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # a node that many are linked to is dealt over SALTS parts
        salted = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        large = salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["a", "salt"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        return small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a > b").distinct()

    def settled(e: DataFrame) -> bool:
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("s"))
        return ends.groupBy("s.node").agg(F.sum("s.down").alias("down"), F.max("s.up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty()

    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    while not settled(e):
        e = materialise(rounds(e), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
