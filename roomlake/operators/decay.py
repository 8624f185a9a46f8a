"""Energy decay curves, reverberation times and other measures of sampled signals.

A signal is a row a sample (key, position, value) or an array column. Sums over
the rest of a curve are reverse window frames; fits are closed-form aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-12


def samples(rows: DataFrame, keys: Sequence[str], array: str) -> DataFrame:
    """The keys, pos (from 0) and x of each element."""
    return rows.select(*keys, F.posexplode(array).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def decay_curve(bins: DataFrame, keys: Sequence[str], *, at: str, energy: str, floor: float = FLOOR) -> DataFrame:
    """``bins`` with edc (energy from here on), total and db (edc over the total, in decibels)."""
    order = Window.partitionBy(*keys).orderBy(at)
    edc = F.sum(energy).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    curve = bins.withColumn("edc", edc).withColumn("total", F.sum(energy).over(Window.partitionBy(*keys)))
    part = F.greatest(F.col("edc") / F.when(F.col("total") > 0, F.col("total")), F.lit(floor))
    return curve.withColumn("db", 10 * F.log10(part))


def schroeder_rt60(bins: DataFrame, keys: Sequence[str], *, at: str, energy: str, bin_seconds: float, start_db: float = -5.0, end_db: float = -25.0, least_energy: float = FLOOR) -> DataFrame:
    """The time of 60 dB decay from a line through the curve between two levels; 0 where none fits."""
    curve = decay_curve(bins, keys, at=at, energy=energy)
    inside = (F.col("db") <= start_db) & (F.col("db") >= end_db)
    y, x = F.when(inside, F.col("db")), F.when(inside, F.col(at) * bin_seconds)
    fits = curve.groupBy(*keys).agg(F.max("total").alias("total"), F.count(y).alias("n"), F.regr_slope(y, x).alias("slope"))
    usable = (F.col("total") >= least_energy) & (F.col("n") >= 2) & (F.col("slope") < -1e-9)
    return fits.select(*keys, F.col("n").alias("points"), F.when(usable, -60 / F.col("slope")).otherwise(0.0).alias("rt60"))


def two_slopes(bins: DataFrame, keys: Sequence[str], *, at: str, energy: str, bin_seconds: float, start_db: float = -5.0, end_db: float = -35.0, least_points: int = 5, least_span: float = 7.0) -> DataFrame:
    """One line or two through the curve, whichever the Bayesian criterion prefers.

    Prefix and suffix sums give the fit on either side of every split in one
    window pass, with no split enumerated against the points.
    """
    curve = decay_curve(bins, keys, at=at, energy=energy).where((F.col("db") <= start_db) & (F.col("db") >= end_db))
    pts = curve.select(*keys, (F.col(at) * bin_seconds).alias("x"), F.col("db").alias("y"))
    w = Window.partitionBy(*keys).orderBy("x")
    sides = {"l": w.rowsBetween(Window.unboundedPreceding, Window.currentRow), "r": w.rowsBetween(1, Window.unboundedFollowing), "a": Window.partitionBy(*keys)}
    terms = {"n": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
    for s, frame in sides.items():
        for t, e in terms.items():
            pts = pts.withColumn(f"{s}_{t}", F.coalesce(F.sum(e).over(frame), F.lit(0.0)))
        for t, f in (("hi", F.max), ("lo", F.min)):
            pts = pts.withColumn(f"{s}_{t}", f("y").over(frame))

    def fit(s):
        n, x, y, xx, xy, yy = (F.col(f"{s}_{t}") for t in terms)
        sxx, sxy, syy = xx - x * x / n, xy - x * y / n, yy - y * y / n
        slope = F.when((n >= 2) & (sxx > 0), sxy / sxx)
        sse = F.greatest(syy - slope * sxy, F.lit(1e-12))
        return slope, sse, F.when(syy > 0, 1 - sse / syy)

    for s in sides:
        slope, sse, r2 = (F.when(F.col(f"{s}_n") >= 2, e) for e in fit(s))
        pts = pts.withColumn(f"{s}_slope", slope).withColumn(f"{s}_sse", sse).withColumn(f"{s}_r2", r2)
    enough = F.lit(True)
    for s in "lr":
        enough = enough & (F.col(f"{s}_n") >= least_points) & (F.col(f"{s}_hi") - F.col(f"{s}_lo") >= least_span) & (F.col(f"{s}_slope") < -1e-9)
    both = F.col("l_sse") + F.col("r_sse")
    n = F.col("a_n")
    gain = n * F.log(F.col("a_sse") / n) + 2 * F.log(n) - (n * F.log(both / n) + 5 * F.log(n))
    ratio = F.greatest(F.col("l_slope") / F.col("r_slope"), F.col("r_slope") / F.col("l_slope"))
    good = enough & (n >= 2 * least_points) & (F.col("a_hi") - F.col("a_lo") >= 2 * least_span) & (gain >= 10) & (ratio >= 1.35) & (F.col("l_r2") >= 0.95) & (F.col("r_r2") >= 0.95)
    best = F.max_by(F.struct("l_slope", "r_slope", F.col("x").alias("knee")), F.when(good, F.struct(gain.alias("g"), -F.col("x")))).alias("best")
    out = pts.groupBy(*keys).agg(F.count("*").alias("points"), F.first("a_slope").alias("slope"), best)
    early = lambda s: F.when(s < -1e-9, -60 / s)
    return out.select(*keys, "points", F.when(F.col("best").isNotNull(), "double").otherwise("single").alias("shape"), early(F.col("slope")).alias("rt60"), early(F.col("best.l_slope")).alias("rt60_early"), early(F.col("best.r_slope")).alias("rt60_late"), F.col("best.knee").alias("knee"))


def arrivals(signal: DataFrame, keys: Sequence[str], *, ratio: float = 0.025, fs: float = 1.0) -> DataFrame:
    """The first time at which a signal reaches a part of its peak; null for a silent one."""
    peak = signal.groupBy(*keys).agg(F.max(F.abs("x")).alias("peak"))
    first = signal.join(peak, list(keys)).where((F.col("peak") > 0) & (F.abs("x") >= ratio * F.col("peak"))).groupBy(*keys).agg((F.min("pos") / fs).alias("arrival"))
    return peak.join(first, list(keys), "left").select(*keys, "peak", "arrival")


def peak_preview(signal: DataFrame, keys: Sequence[str], stride: int) -> DataFrame:
    """Of each ``stride`` samples that of the largest magnitude, the first of equal ones."""
    block = F.floor(F.col("pos") / stride).cast("int").alias("block")
    return signal.groupBy(*keys, block).agg(F.max_by("x", F.struct(F.abs("x"), -F.col("pos"))).alias("x"))


def clarity(signal: DataFrame, keys: Sequence[str], *, direct: str, early: Sequence[int], window: int) -> DataFrame:
    """peak, energy, and in decibels the ratio of early to late energy (c_<samples>) and of direct to other energy (drr).

    ``direct``: column of the direct sound's position. A ratio is null where a side has no energy.
    """
    e = F.col("x") * F.col("x")
    since = F.col("pos") - F.col(direct)

    def ratio(inside, outside):
        a, b = F.coalesce(F.sum(F.when(inside, e)), F.lit(0.0)), F.coalesce(F.sum(F.when(outside, e)), F.lit(0.0))
        return F.when((a > 1e-18) & (b > 1e-18), 10 * F.log10(a / b))

    near = F.abs(since) <= window
    each = [ratio((since >= 0) & (since < n), since >= n).alias(f"c_{n}") for n in early]
    return signal.groupBy(*keys).agg(F.max(F.abs("x")).alias("peak"), F.sum(e).alias("energy"), F.sqrt(F.avg(e)).alias("rms"), *each, ratio(near, ~near).alias("drr"))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def power(a: Column) -> Column:
    """Mean square of an array."""
    return array_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))) / F.size(a)


def snr_db(signal: Column, noise: Column) -> Column:
    return 10 * F.log10(F.greatest(power(signal), F.lit(1e-20)) / F.greatest(power(noise), F.lit(1e-20)))


def si_sdr_db(estimate: Column, reference: Column) -> Column:
    """Scale-invariant ratio of signal to distortion, after removing both means."""
    centred = lambda a: F.transform(a, lambda x: x.cast("double") - array_sum(F.transform(a, lambda y: y.cast("double"))) / F.size(a))
    dot = lambda a, b: array_sum(F.zip_with(a, b, lambda x, y: x * y))
    e, r = centred(estimate), centred(reference)
    scale = dot(e, r) / F.greatest(dot(r, r), F.lit(1e-20))
    target = scale * scale * dot(r, r)
    noise = dot(e, e) - 2 * scale * dot(e, r) + target
    return 10 * F.log10(F.greatest(target, F.lit(1e-20)) / F.greatest(noise, F.lit(1e-20)))


def gain_to_snr(foreground: Column, background: Column, snr: float) -> Column:
    """What the background is multiplied by so that the foreground stands ``snr`` decibels above it."""
    return F.sqrt(power(foreground) / F.greatest(power(background), F.lit(1e-20)) / (10 ** (snr / 10)))


def mix_at_snr(foreground: Column, background: Column, snr: float) -> Column:
    gain = gain_to_snr(foreground, background, snr)
    return F.zip_with(foreground, background, lambda a, b: a.cast("double") + b.cast("double") * gain)


def convolve(signal: DataFrame, keys: Sequence[str], kernel: Sequence[float]) -> DataFrame:
    """Full convolution with a short kernel: every sample is scattered once for each tap, and taps meet in a partial sum."""
    taps = F.array(*[F.struct(F.lit(k).alias("d"), F.lit(float(g)).alias("g")) for k, g in enumerate(kernel)])
    spread = signal.select(*keys, "pos", "x", F.explode(taps).alias("t"))
    return spread.groupBy(*keys, (F.col("pos") + F.col("t.d")).alias("pos")).agg(F.sum(F.col("x") * F.col("t.g")).alias("x"))


def resample_linear(array: Column, ratio: float) -> Column:
    """``round(size * ratio)`` samples by linear interpolation; beyond the last sample its value holds."""
    n = F.greatest(F.lit(1), F.round(F.size(array) * ratio).cast("int"))

    def at(k):
        place = k / F.lit(float(ratio))
        low = F.least(F.floor(place).cast("int"), F.size(array) - 1)
        high = F.least(low + 1, F.size(array) - 1)
        part = F.least(place - low, F.lit(1.0))
        return F.element_at(array, low + 1).cast("double") * (1 - part) + F.element_at(array, high + 1).cast("double") * part

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def scatter_impulses(taps: DataFrame, keys: Sequence[str], *, delay: str, gain: str, fs: float) -> DataFrame:
    """An impulse response as rows: gains of the taps that fall on one sample, added."""
    return taps.groupBy(*keys, F.round(F.col(delay) * fs).cast("long").alias("pos")).agg(F.sum(gain).alias("x"))


def steps(rows: DataFrame, keys: Sequence[str], *, order: Sequence[str], value: str) -> DataFrame:
    """Largest step between neighbours and range of a value along its order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    moved = rows.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w)))
    return moved.groupBy(*keys).agg(F.count("*").alias("frames"), F.max("_d").alias("max_step"), (F.max(value) - F.min(value)).alias("span"))


def strictly_increasing(rows: DataFrame, keys: Sequence[str], *, order: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    d = rows.withColumn("_up", F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(True)))
    return d.groupBy(*keys).agg(F.count("*").alias("frames"), F.bool_and("_up").alias("increasing"))


def rebin(signal: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Energy of each ``width`` samples: bin, energy."""
    return signal.groupBy(*keys, F.floor(F.col("pos") / width).alias("bin")).agg(F.sum(F.col("x") * F.col("x")).alias("energy"))
