"""Connected components by alternating star contraction.

Each round points every node at the smallest node of its neighbourhood, first
over the larger neighbours and then over the smaller ones; the graph becomes a
set of stars after a number of rounds that is logarithmic in its size. Rounds
are written to the shared folder, so that a lost executor repeats one at most.
Only whether the graph consists of stars reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlake.storage import Workspace


def _large_star(edges: DataFrame, space: Workspace) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that adaptive execution can split the edges of a star's centre in the join
    lowest = space.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lowest-large")
    return both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame, space: Workspace) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    lowest = space.save(down.groupBy("a").agg(F.min("b").alias("low")), "lowest-small")
    moved = down.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node either has one neighbour below it or is such a neighbour."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").isEmpty()


def connected_components(edges: DataFrame, space: Workspace, *, max_rounds: int = 64) -> DataFrame:
    """(fp, root) for each node of ``edges`` (a, b): root is the smallest node of its component."""
    current = space.save(edges.select("a", "b"), "edges-0")
    for k in range(1, max_rounds + 1):
        larger = space.save(_large_star(current, space), "larger")
        current = space.save(_small_star(larger, space), f"edges-{k}")
        space.drop(f"edges-{k - 1}")
        if _is_stars(current):
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = current.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(roots)
