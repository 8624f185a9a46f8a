"""Tracks, gains and arrivals: sums and scalars over sampled signals, as expressions and partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlake.functions.geometry import SPEED
from roomlake.operators.decay import FLOOR


def mix_tracks(samples: DataFrame, keys: Sequence[str], *, channels: str, peak: float | None = None) -> DataFrame:
    """keys, channel, pos, x: the sum of the tracks (keys, track, channel, pos, x), scaled down if it exceeds ``peak``.

    A track of one channel is heard on all ``channels`` (a column, equal in a group).
    Samples of a position are added in each task before they are shuffled.
    """
    mono = samples.groupBy(*keys, "track").agg((F.max("channel") == 0).alias("_mono"))
    spread = F.when(F.col("_mono"), F.sequence(F.lit(0), F.col(channels).cast("int") - 1)).otherwise(F.array(F.col("channel").cast("int")))
    each = samples.join(mono, [*keys, "track"]).select(*keys, F.explode(spread).alias("channel"), "pos", "x")
    mixed = each.groupBy(*keys, "channel", "pos").agg(F.sum("x").alias("x"))
    if peak is None:
        return mixed
    loudest = mixed.groupBy(*keys).agg(F.max(F.abs("x")).alias("_peak"))
    return mixed.join(loudest, list(keys)).withColumn("x", F.when(F.col("_peak") > peak, F.col("x") * (peak / F.col("_peak"))).otherwise(F.col("x"))).drop("_peak")


def common_gains(samples: DataFrame, keys: Sequence[str], *, start: int, interferer_snr: float, background_snr: float, sensor_snr: float) -> DataFrame:
    """keys, interferer, background, sensor: gains that all channels of a case share.

    ``samples``: keys, component ("target", "interferer", "background"), channel, pos, x.
    Powers are means over all channels from position ``start`` on; a silent component gets a gain of 1.
    """
    part = lambda name: F.avg(F.when(F.col("component") == name, F.col("x") * F.col("x")))
    power = samples.where(F.col("pos") >= start).groupBy(*keys).agg(part("target").alias("t"), part("interferer").alias("i"), part("background").alias("b"))
    gain = lambda c, snr: F.when(F.col(c) > FLOOR, F.sqrt(F.col("t") / F.col(c) / 10 ** (snr / 10))).otherwise(1.0)
    return power.select(*keys, gain("i", interferer_snr).alias("interferer"), gain("b", background_snr).alias("background"), (F.sqrt("t") / 10 ** (sensor_snr / 20)).alias("sensor"))


def with_gains(samples: DataFrame, gains: DataFrame, keys: Sequence[str], *, noise: Column) -> DataFrame:
    """keys, channel, pos, target, noise, mixture: components under common gains, with a sensor's ``noise`` (of unit spread)."""
    part = lambda name: F.coalesce(F.sum(F.when(F.col("component") == name, F.col("x"))), F.lit(0.0)).alias(name)
    wide = samples.groupBy(*keys, "channel", "pos").agg(part("target"), part("interferer"), part("background"))
    gain = gains.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("interferer", "background", "sensor")])
    met = wide.join(gain, list(keys)).withColumn("noise", F.col("interferer") * F.col("_interferer") + F.col("background") * F.col("_background") + noise * F.col("_sensor"))
    return met.select(*keys, "channel", "pos", "target", "noise", (F.col("target") + F.col("noise")).alias("mixture"))


def stack_components(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Channels of several deployments as one: those of each part are numbered on from those before it (keys, channel, ...)."""
    out, before = None, None
    for part in parts:
        count = part.groupBy(*keys).agg((F.max("channel") + 1).alias("_n"))
        moved = part if before is None else part.join(before, list(keys), "left").withColumn("channel", F.col("channel") + F.coalesce("_n", F.lit(0))).drop("_n")
        before = count if before is None else before.unionByName(count).groupBy(*keys).agg(F.sum("_n").alias("_n"))
        out = moved if out is None else out.unionByName(moved)
    return out


def take_channels(samples: DataFrame, chosen: Sequence[int]) -> DataFrame:
    """The chosen channels, numbered in the order given."""
    place = F.array_position(F.array(*[F.lit(int(c)) for c in chosen]), F.col("channel").cast("int"))
    return samples.withColumn("_p", place).where("_p > 0").withColumn("channel", (F.col("_p") - 1).cast("int")).drop("_p")


def arrivals_from_source(source: Column, microphones: Column, speed: float = SPEED) -> Column:
    """Seconds from a point (struct x, y, z) to each of an array of points."""
    return F.transform(microphones, lambda m: F.sqrt(sum(((m[c] - source[c]) * (m[c] - source[c]) for c in "xyz"), F.lit(0.0))) / speed)


def arrivals_from_azimuth(degrees: Column, microphones: Column, speed: float = SPEED) -> Column:
    """Relative arrivals of a plane wave from a bearing; the first is 0."""
    late = F.transform(microphones, lambda m: -(m["x"] * F.cos(F.radians(degrees)) + m["y"] * F.sin(F.radians(degrees))) / speed)
    return F.transform(late, lambda t: t - F.array_min(late))


def receiver_channels(receiver: Column, offsets: Column) -> Column:
    """Where an array's sensors are: a receiver (struct x, y, z) and offsets (x, y); a single one without offsets."""
    points = F.transform(offsets, lambda o: F.struct((receiver["x"] + o["x"]).alias("x"), (receiver["y"] + o["y"]).alias("y"), receiver["z"].alias("z")))
    return F.when(F.coalesce(F.size(offsets), F.lit(0)) > 0, points).otherwise(F.array(F.struct(receiver["x"].alias("x"), receiver["y"].alias("y"), receiver["z"].alias("z"))))


def forward(yaw: Column, pitch: Column) -> Column:
    """The unit vector of an orientation in degrees; the pitch ends at the vertical."""
    up = F.radians(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), pitch)))
    return F.struct((F.cos(up) * F.cos(F.radians(yaw))).alias("x"), (F.cos(up) * F.sin(F.radians(yaw))).alias("y"), F.sin(up).alias("z"))


#: Patterns of a source, with the weight and the power of the dipole.
PATTERNS = {"omni": (0.0, 1.0), "cardioid": (0.5, 1.0), "dipole": (1.0, 1.0), "focused": (0.5, 4.0)}


def directivity(pattern: Column, weight: Column, power: Column) -> Column:
    """pattern, weight and power of a source: those given, else the pattern's, else a cardioid's; an error outside of their ranges."""
    name = F.coalesce(F.translate(F.lower(pattern), "-", "_"), F.lit("omni"))
    of = lambda k: F.try_element_at(F.create_map(*[x for n, row in PATTERNS.items() for x in (F.lit(n), F.lit(row[k]))]), name)
    w, p = (F.coalesce(given, of(k), F.lit(PATTERNS["cardioid"][k])) for k, given in enumerate((weight, power)))
    unknown = ~name.isin(*PATTERNS, "weighted_dipole", "directivity")
    check = F.when(unknown, "unknown source directivity").when(~w.between(0.0, 1.0) | F.isnan(w), "dipole weight must be between 0 and 1").when((p < 0) | F.isnan(p), "dipole power must not be negative")
    kept = F.when(check.isNotNull(), F.raise_error(check).cast("string")).when(of(0).isNotNull(), name).otherwise("custom")
    return F.struct(kept.alias("pattern"), w.alias("weight"), p.alias("power"))


def fitted_corners(corners: Column, width: Column, depth: Column, pad: float = 0.0) -> Column:
    """Corners (x, y) moved and scaled to a width and a depth, with a padding as a part of these."""
    lo, hi = ({c: f(F.transform(corners, lambda p: p[c])) for c in "xy"} for f in (F.array_min, F.array_max))  # noqa: B023
    place = lambda p, c, size: size * pad + (p[c] - lo[c]) / F.greatest(hi[c] - lo[c], F.lit(1e-6)) * F.greatest(size * (1 - 2 * pad), F.lit(0.1))
    return F.transform(corners, lambda p: F.struct(place(p, "x", width).alias("x"), place(p, "y", depth).alias("y")))
