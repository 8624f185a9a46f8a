"""Localisation on grids and the direct sound field, relationally.

A candidate grid meets the measurements of its own plan only; losses are sums
over that join, so they are aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomlake.functions import geometry as g


def _distance() -> Column:
    return F.hypot(F.col("node_x") - F.col("x"), F.col("node_y") - F.col("y"))


def doa_loss(grid: DataFrame, measured: DataFrame, keys: Sequence[str], *, point: str) -> DataFrame:
    """keys, point, loss. ``measured``: keys, node_x, node_y, bearing (degrees), confidence, and hops to the grid's room.

    The allowed error grows and the weight falls with the rooms that the sound came through.
    """
    bearing = g.azimuth(F.col("x") - F.col("node_x"), F.col("y") - F.col("node_y"))
    sigma = 4.0 + 5.0 * F.col("hops")
    weight = F.greatest(F.lit(0.05), F.col("confidence")) * F.pow(F.lit(0.72), F.col("hops"))
    joined = grid.join(measured, list(keys)).withColumn("_w", weight).withColumn("_h", g.huber(g.angular_error(bearing, F.col("bearing")) / sigma))
    return joined.groupBy(*keys, point).agg((F.sum(F.col("_w") * F.col("_h")) / F.greatest(F.sum("_w"), F.lit(1e-9))).alias("loss"))


def tdoa_loss(grid: DataFrame, measured: DataFrame, keys: Sequence[str], *, point: str, speed: float = g.SPEED) -> DataFrame:
    """keys, point, loss. ``measured``: keys, node_x, node_y, arrival (seconds), confidence, hops.

    Arrivals and predictions are compared without their means. As the mean is
    known only with all nodes, a window over the few nodes of a point gives it.
    """
    weight = F.greatest(F.lit(0.05), F.col("confidence")) * F.pow(F.lit(0.78), F.col("hops"))
    joined = grid.join(measured, list(keys)).withColumn("_p", _distance() / speed).withColumn("_w", weight)
    w = Window.partitionBy(*keys, point)
    residual = (F.col("arrival") - F.avg("arrival").over(w)) - (F.col("_p") - F.avg("_p").over(w))
    scored = joined.withColumn("_h", g.huber(residual * 1e6 / 120.0))
    return scored.groupBy(*keys, point).agg((F.sum(F.col("_w") * F.col("_h")) / F.greatest(F.sum("_w"), F.lit(1e-9))).alias("loss"))


def hybrid_loss(doa: DataFrame, tdoa: DataFrame, keys: Sequence[str], *, point: str) -> DataFrame:
    """A fifth of one loss and four fifths of the other, each over the range from its least to its upper quartile."""
    both = doa.withColumnRenamed("loss", "_d").join(tdoa.withColumnRenamed("loss", "_t"), [*keys, point])
    ranges = both.groupBy(*keys).agg(*[f.alias(n) for c in "dt" for n, f in ((f"_{c}0", F.min(f"_{c}")), (f"_{c}1", F.percentile(f"_{c}", 0.75)))])
    scaled = lambda c: (F.col(f"_{c}") - F.col(f"_{c}0")) / F.greatest(F.col(f"_{c}1") - F.col(f"_{c}0"), F.lit(1e-6))
    return both.join(ranges, list(keys)).select(*keys, point, (0.2 * scaled("d") + 0.8 * scaled("t")).alias("loss"))


def grid_estimate(losses: DataFrame, keys: Sequence[str], *, point: str, room: str, best: int = 5) -> DataFrame:
    """keys, room, x, y: the room of the least loss, and there the mean of the ``best`` points, weighted by exp(-2 (loss - least))."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.round("loss", 9), point)
    top = losses.withColumn("_room", F.first(room).over(order)).withColumn("_least", F.min("loss").over(w)).where(F.col(room) == F.col("_room"))
    five = top.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= best).withColumn("_w", F.exp(-2 * (F.col("loss") - F.col("_least"))))
    mean = lambda c: (F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c)
    return five.groupBy(*keys, room).agg(mean("x"), mean("y"))


def direct_field(pairs: DataFrame, *, least_distance: float = 0.3) -> DataFrame:
    """``pairs`` (sx, sy, sz, rx, ry, rz, yaw, dipole, occlusion, transmission array) with distance, delay and gain by band."""
    dx, dy, dz = (F.col(f"r{a}") - F.col(f"s{a}") for a in "xyz")
    out = pairs.withColumn("distance", F.sqrt(dx * dx + dy * dy + dz * dz)).withColumn("delay", F.col("distance") / g.SPEED)
    cosine = (dx * F.cos(F.radians("yaw")) + dy * F.sin(F.radians("yaw"))) / F.greatest(F.col("distance"), F.lit(1e-9))
    through = F.transform("transmission", lambda t: F.col("occlusion") + (1 - F.col("occlusion")) * t)
    out = out.withColumn("_dir", g.directivity_gain(cosine, F.col("dipole"), F.lit(1.0)))
    return out.withColumn("gains", F.transform(g.band_product(g.propagation(F.col("distance"), least_distance), through), lambda x: x * F.col("_dir"))).drop("_dir")


def occlusion(pairs: DataFrame, walls: DataFrame, keys: Sequence[str], *, pair: str) -> DataFrame:
    """keys, pair, blocked: how many wall segments (ax, ay, bx, by) of its plan a straight path crosses."""
    side = lambda px, py, qx, qy, x, y: (qx - px) * (y - py) - (qy - py) * (x - px)
    s, r, a, b = (("sx", "sy"), ("rx", "ry"), ("ax", "ay"), ("bx", "by"))
    of = lambda p, q, z: side(*[F.col(c) for c in (*p, *q, *z)])
    hit = (of(a, b, s) * of(a, b, r) < 0) & (of(s, r, a) * of(s, r, b) < 0)
    return pairs.join(walls, list(keys)).groupBy(*keys, pair).agg(F.count_if(hit).alias("blocked"))
