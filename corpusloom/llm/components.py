"""Connected components of a large graph, without holding any part of it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: root is the smallest node of its component.

    `edges` has long columns a and b; direction, repetition and loops do not matter. Each round hangs the neighbours
    of a node on its smallest neighbour, first the larger ones, then the smaller ones, until nothing changes; the
    number of rounds grows with the logarithm of the size. Rounds are written, so that a lost executor costs one round
    at most; a node in many edges is met by an aggregate before a join.
    """

    def clean(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first()

    now = materialise(clean(edges), "edges")
    before, after = None, state(now)
    while before != after:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Larger neighbours hang on the smallest node around.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(clean(large), "large")
        # Smaller neighbours, and the node itself, hang on the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").unionAll(least.select("a", "m")).toDF("a", "b")
        now = materialise(clean(small), "edges")
        before, after = after, state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
