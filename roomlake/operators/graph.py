"""Routes, reachability and joins over portal graphs.

A graph is a table of edges (src, dst) in both directions with a key of the plan
it belongs to. Searches go out in rounds of joins until nothing new is reached, or
to a given depth; each round keeps one best row a (plan, start, node), so it never
grows beyond the pairs that can be reached. Rounds are written to the shared
folder, so that each is computed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomlake.storage import Workspace


def both_ways(edges: DataFrame, keys: Sequence[str], a: str = "src", b: str = "dst") -> DataFrame:
    rest = [c for c in edges.columns if c not in (*keys, a, b)]
    there = edges.select(*keys, F.col(a).alias("src"), F.col(b).alias("dst"), *rest)
    return there.unionByName(edges.select(*keys, F.col(b).alias("src"), F.col(a).alias("dst"), *rest))


def reachable(edges: DataFrame, starts: DataFrame, keys: Sequence[str], *, rounds: int | None = None) -> DataFrame:
    """keys, start, node, hops: what can be reached from each start, itself included. ``rounds``: the most edges, if that is bounded."""
    space = Workspace(edges.sparkSession, "reach")
    front = space.save(starts.select(*keys, F.col("start"), F.col("start").alias("node"), F.lit(0).alias("hops")), "front-0")
    step = space.save(edges.select(*keys, F.col("src").alias("node"), F.col("dst")), "edges")
    seen, k = front, 0
    while k != rounds:
        k += 1
        moved = front.join(step, [*keys, "node"]).select(*keys, "start", F.col("dst").alias("node")).distinct()
        front = space.save(moved.join(seen, [*keys, "start", "node"], "left_anti").withColumn("hops", F.lit(k)), f"front-{k}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def best_routes(edges: DataFrame, starts: DataFrame, keys: Sequence[str], *, cost: Column, rounds: int | None = None) -> DataFrame:
    """keys, start, node, cost, path: the cheapest path of each pair; of equal ones the first in the order of its nodes.

    Bellman-Ford in rounds, of which each goes on from what the last one improved, until
    nothing improves. Costs are rounded to nine digits, so that equal costs are equal.
    """
    space = Workspace(edges.sparkSession, "routes")
    pair = [*keys, "start", "node"]
    first = starts.select(*keys, "start", F.col("start").alias("node"), F.struct(F.lit(0.0).alias("cost"), F.array("start").alias("path")).alias("b"))
    best = front = space.save(first, "best-0")
    step = space.save(edges.select(*keys, F.col("src").alias("node"), F.col("dst"), cost.alias("step")), "edges")
    k = 0
    while k != rounds:
        k += 1
        moved = front.join(step, [*keys, "node"]).where(~F.array_contains("b.path", F.col("dst")))
        longer = moved.select(*keys, "start", F.col("dst").alias("node"), F.struct(F.round(F.col("b.cost") + F.col("step"), 9).alias("cost"), F.concat("b.path", F.array("dst")).alias("path")).alias("b"))
        offered = longer.groupBy(*pair).agg(F.min("b").alias("new"))
        merged = best.join(offered, pair, "full")
        better = F.col("new").isNotNull() & (F.col("b").isNull() | (F.col("new") < F.col("b")))
        both = space.save(merged.select(*pair, F.when(better, F.col("new")).otherwise(F.col("b")).alias("b"), better.alias("improved")), f"best-{k}")
        best, front = both.drop("improved"), both.where("improved").drop("improved")
        if front.isEmpty():
            break
        space.drop(f"best-{k - 1}")
    return best.select(*pair, F.col("b.cost").alias("cost"), F.col("b.path").alias("path"))


def hop_routes(edges: DataFrame, starts: DataFrame, keys: Sequence[str], *, rounds: int | None = None) -> DataFrame:
    """Routes of the fewest edges: keys, start, node, hops, path."""
    found = best_routes(edges, starts, keys, cost=F.lit(1.0), rounds=rounds)
    return found.select(*keys, "start", "node", F.col("cost").cast("int").alias("hops"), "path")


def portal_cost(width: Column) -> Column:
    """What passing a portal costs: little more through a narrow one; without a width it is 0.8 m wide."""
    return 1 + 0.05 / F.greatest(F.coalesce(width, F.lit(0.8)), F.lit(0.1))


def connected(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], *, rounds: int | None = None) -> DataFrame:
    """keys, n_nodes, connected: whether a plan's first node reaches all its nodes. A plan without nodes has no row."""
    first = nodes.groupBy(*keys).agg(F.min("node").alias("start"), F.countDistinct("node").alias("n_nodes"))
    got = reachable(edges, first, keys, rounds=rounds).groupBy(*keys).agg(F.countDistinct("node").alias("reached"))
    return first.join(got, list(keys)).select(*keys, "n_nodes", (F.col("reached") == F.col("n_nodes")).alias("connected"))


def connections(portals: DataFrame, rooms: DataFrame, exits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A room's connections: portals to other rooms and exits outdoors, numbered with the exits first.

    ``portals``: keys, room, target, kind. ``rooms``: keys, room, type. ``exits``: keys, room, kind.
    """
    inner = portals.join(rooms.select(*keys, F.col("room").alias("target"), F.col("type").alias("target_type")), [*keys, "target"]).select(*keys, "room", "target", "target_type", "kind", F.lit(False).alias("outdoor"))
    outer = exits.select(*keys, "room", F.lit(None).cast(inner.schema["target"].dataType).alias("target"), F.lit("outdoor").alias("target_type"), "kind", F.lit(True).alias("outdoor"))
    order = Window.partitionBy(*keys, "room").orderBy(F.desc("outdoor"), "target_type", F.col("target").asc_nulls_last(), "kind")
    return inner.unionByName(outer).withColumn("place", F.row_number().over(order))


def only_selected(rows: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    return rows.join(selected.select(key).distinct(), key, "left_semi")


def not_yet_computed(jobs: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The jobs whose key no stored result has."""
    return jobs.join(stored.select(key), key, "left_anti")


def subtract_intervals(rows: DataFrame, keys: Sequence[str], *, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """keys, gap_start, gap_end: the parts of [low, high] that no interval covers, by one sorted pass."""
    clipped = rows.select(*keys, F.greatest(F.col(start), low).alias("s"), F.least(F.col(end), high).alias("e"), low.alias("lo"), high.alias("hi")).where("s <= e")
    w = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("lo"))
    marked = clipped.withColumn("gap_start", reach)
    between = marked.where("s > gap_start").select(*keys, "gap_start", F.col("s").alias("gap_end"))
    last = clipped.groupBy(*keys).agg(F.max("e").alias("gap_start"), F.max("hi").alias("gap_end")).where("gap_end > gap_start")
    return between.unionByName(last.select(*keys, "gap_start", "gap_end"))
