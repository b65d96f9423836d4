"""Connected components by alternating star contractions; the edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_trials.llm.common import checkpoint


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, m): of each u the least of itself and its v."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, root) for all ends of ``edges`` (a, b), of type long: ``root`` is the least node that can be reached.

    A large star ties every larger neighbour of a node to its least neighbour, a small star every smaller one. Both keep
    the components, and the edges end as one star around each least node, after a number of rounds that grows with the
    logarithm of the longest chain. A node of many edges is one key of a minimum with partial sums and of a
    join of two numbers a row, which one task reads: the edges come from spanning forests, so a node has at most one for
    each other fingerprint it is near to, whatever the number of copies. Edges that repeat or tie a node to itself do no harm; no edges give no rows.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_smallest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _smallest(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = checkpoint(small.where("u <> v").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
