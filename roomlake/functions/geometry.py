"""Angles, polygons and band maths as column expressions.

Points are structs (x, y); polygons arrays of points without a closing one. A
band array holds a value for each octave from 125 Hz to 4 kHz.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the model: octave bands (Hz), amplitude loss in air (1/m) for each, and the speed of sound (m/s).
BANDS = ("125", "250", "500", "1000", "2000", "4000")
AIR_LOSS = (0.0001, 0.0003, 0.0006, 0.0012, 0.0025, 0.006)
SPEED = 343.0


def pmod(a: Column, m: float) -> Column:
    """A remainder that is never negative."""
    return F.pmod(a.cast("double"), F.lit(float(m)))


def angular_error(estimate: Column, truth: Column) -> Column:
    """The angle between two directions in degrees, 0 to 180."""
    return F.abs(pmod(estimate - truth + 180, 360) - 180)


def azimuth(dx: Column, dy: Column) -> Column:
    return pmod(F.degrees(F.atan2(dy, dx)), 360)


def fold_to_half_plane(world: Column, orientation: Column) -> Column:
    """What a line of sensors can tell of a direction: the angle to its axis."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(F.radians(pmod(world - orientation, 360)))))))


def huber(x: Column, delta: float = 1.5) -> Column:
    return F.when(F.abs(x) <= delta, 0.5 * x * x).otherwise(delta * (F.abs(x) - 0.5 * delta))


def _edges(polygon: Column, f) -> Column:
    """``f`` of both ends of each edge."""
    following = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, following, f)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def polygon_area(polygon: Column) -> Column:
    """Signed: positive for corners in counter-clockwise order."""
    return _total(_edges(polygon, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def polygon_perimeter(polygon: Column) -> Column:
    return _total(_edges(polygon, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))


def polygon_bounds(polygon: Column) -> Column:
    ends = {f"{n}_{c}": f(F.transform(polygon, lambda p: p[c])) for n, f in (("min", F.array_min), ("max", F.array_max)) for c in "xy"}  # noqa: B023
    return F.struct(*[e.alias(n) for n, e in ends.items()])


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    """From a point to the nearest one of a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / square))).otherwise(0.0)
    return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)


def boundary_distance(x: Column, y: Column, polygon: Column) -> Column:
    return F.array_min(_edges(polygon, lambda a, b: segment_distance(x, y, a, b)))


def inside(x: Column, y: Column, polygon: Column, tolerance: float = 1e-8) -> Column:
    """Whether a point lies in the polygon or on its boundary: an odd number of edges cross the ray to the right."""
    crosses = _edges(polygon, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]))
    odd = F.size(F.filter(crosses, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1
    return odd | (boundary_distance(x, y, polygon) <= tolerance)


def polyline_length(points: Column) -> Column:
    return _total(F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))


def is_rectangle(polygon: Column) -> Column:
    """Four corners, which are those of the bounds (to six digits)."""
    b = polygon_bounds(polygon)
    key = lambda x, y: F.struct(F.round(x, 6), F.round(y, 6))
    corners = F.array(*[key(b[f"{i}_x"], b[f"{j}_y"]) for i in ("min", "max") for j in ("min", "max")])
    return (F.size(polygon) == 4) & (F.array_sort(F.transform(polygon, lambda p: F.struct(F.round(p["x"], 6).alias("col1"), F.round(p["y"], 6).alias("col2")))) == F.array_sort(corners))


def ease(t: Column) -> Column:
    """A quintic step from 0 to 1 without a jerk at either end."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return c * c * c * (c * (c * 6 - 15) + 10)


def bands(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def propagation(distance: Column, least: float, loss: Sequence[float] = AIR_LOSS) -> Column:
    """Gain in each band over a distance: spreading, and loss in air."""
    return F.transform(bands(loss), lambda a: 1 / F.greatest(distance, F.lit(least)) * F.exp(-a * F.greatest(distance, F.lit(0.0))))


def band_mean(values: Column) -> Column:
    """Over all bands; missing ones count as 0."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / len(BANDS)


def band_product(*arrays: Column) -> Column:
    """Element by element; missing values count as 1."""
    out = arrays[0]
    for other in arrays[1:]:
        out = F.zip_with(out, other, lambda x, y: F.coalesce(x, F.lit(1.0)) * F.coalesce(y, F.lit(1.0)))
    return out


def reflection(absorption: Column) -> Column:
    """Pressure reflected of what meets a surface, by band."""
    return F.transform(absorption, lambda a: F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def transmission(loss_db: Column) -> Column:
    """Pressure let through, by band; 30 dB where no loss is known."""
    return F.transform(loss_db, lambda d: F.pow(F.lit(10.0), -F.coalesce(d, F.lit(30.0)) / 20))


def sabine(volume: Column, absorption_area: Column) -> Column:
    """Reverberation time of a volume from its absorbing area."""
    return 0.161 * volume / F.greatest(absorption_area, F.lit(1e-9))


def directivity_gain(cosine: Column, weight: Column, power: Column) -> Column:
    return F.pow(F.abs(1 - weight + weight * cosine), power)


def circular_array(count: Column, radius: Column, orientation: Column) -> Column:
    """Offsets of sensors on a circle."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct((radius * F.cos(F.radians(orientation + 360.0 * k / count))).alias("x"), (radius * F.sin(F.radians(orientation + 360.0 * k / count))).alias("y")))


def linear_array(count: Column, spacing: Column, orientation: Column) -> Column:
    """Offsets of sensors on a line, centred."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(((k - (count - 1) / 2) * spacing * F.cos(F.radians(orientation))).alias("x"), ((k - (count - 1) / 2) * spacing * F.sin(F.radians(orientation))).alias("y")))
