"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.common import materialize

#: Rounds before the loop gives up; each at least halves the depth of every tree, so it is never reached.
MOST_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that a plain exchange lies below the join and Spark can split a node with very many edges
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge; edges are rows (a, b) of one sortable type.

    Each round is two aggregations with map-side partial results and two equi-joins, written to a scratch table, and the
    number of rounds follows the logarithm of the longest path. Nothing but a count and a checksum reaches the driver.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.crc32(F.concat_ws("~", "a", "b").cast("binary")))).head())

    before = state(now)
    if before[0]:
        for _ in range(MOST_ROUNDS):
            now = materialize(_small_star(_large_star(now)).distinct(), "edges")
            after = state(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    # now every edge leads from a node to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
