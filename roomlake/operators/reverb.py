"""Which reverberation time a late tail takes, from fits of decay curves: rows of (job, band)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bands that make the low and the middle broad band.
LOW_BANDS, MID_BANDS = ("125", "250", "500"), ("1000", "2000", "4000")
#: Fixed values of the bounce budget: the decay that is to be traced (dB), steps, and what large or reflective systems of rooms get more.
FLOOR_DB, STEP, LEAST_RAYS, LEAST_BOUNCES, LEAST_CROSS = -25.0, 16, 32768, 64, 96
REFLECTIVE, HALF_REFLECTIVE = 0.90, 0.82


def _positive(c: Column) -> Column:
    return F.when(~F.isnan(c) & (c > 0) & (c < float("inf")), c)


def late_targets(fits: DataFrame) -> DataFrame:
    """``fits`` with target and source: the late slope of two, else the usual time, else the slope of one over a wide range.

    ``fits``: shape ("double", "single"), rt60 (wide range), rt60_late, standard.
    """
    late = F.when(F.col("shape") == "double", _positive(F.col("rt60_late")))
    usual = _positive(F.col("standard"))
    wide = F.when(F.col("shape") == "single", _positive(F.col("rt60")))
    source = F.when(late.isNotNull(), "fitted_late_slope").when(usual.isNull() & wide.isNotNull(), "fitted_wide_range_single_slope").otherwise("steam_single_slope")
    return fits.withColumn("target", F.coalesce(late, usual, wide, F.lit(0.0))).withColumn("source", source)


def with_prior(targets: DataFrame, prior: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``targets`` (keys, target, source) under what coupled rooms decay with (keys, coupled), where that is known; ``traced`` keeps the former value."""
    met = targets.join(prior, list(keys), "left")
    known = _positive(F.col("coupled"))
    return met.withColumn("traced", F.when(known.isNotNull(), F.round("target", 4))).withColumn("target", F.coalesce(known, "target")).withColumn("source", F.when(known.isNotNull(), "coupled_room_energy_matrix").otherwise(F.col("source"))).drop("coupled")


def broad_bands(times: DataFrame, keys: Sequence[str], *, band: str, value: str) -> DataFrame:
    """low and mid: means of the positive times of their bands; 0 without any."""
    mean = lambda names: F.round(F.coalesce(F.avg(F.when(F.col(band).isin(*names), _positive(F.col(value)))), F.lit(0.0)), 4)
    return times.groupBy(*keys).agg(mean(LOW_BANDS).alias("low"), mean(MID_BANDS).alias("mid"))


def space_context(multi_room: Column, source_room: Column, receiver_room: Column, shape: Column) -> Column:
    """What a decay was measured in, and whether two slopes are those of coupled spaces."""
    inside = F.when(F.coalesce(source_room, F.lit("")) != F.coalesce(receiver_room, F.lit("")), "cross_room").otherwise("same_room")
    return F.struct(F.when(~F.coalesce(multi_room, F.lit(False)), "single_space_geometry").otherwise(inside).alias("space"), F.when(F.coalesce(multi_room, F.lit(False)) & (shape == "double"), "coupled_space_decay").alias("model"))


def line_fit(points: DataFrame, keys: Sequence[str], *, x: str, y: str) -> DataFrame:
    """slope, intercept, sse and r2 of a falling line through each group's points; null where there is none. One pass of sums."""
    r = points.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("syy"))
    falls = (F.col("n") >= 2) & (F.col("slope") < -1e-9)
    return r.select(*keys, "n", *[F.when(falls, F.col(c)).alias(c) for c in ("slope", "intercept")], F.when(falls, (1 - F.col("r2")) * F.col("syy")).alias("sse"), F.when(falls, F.col("r2")).alias("r2"))


def segments(points: DataFrame, keys: Sequence[str], *, x: str, y: str) -> DataFrame:
    """Each segment's fit with its ends: equivalent rt60, slope, r2, and the first and last time and level."""
    fit = line_fit(points, keys, x=x, y=y)
    ends = points.groupBy(*keys).agg(F.min(x).alias("start_time"), F.max(x).alias("end_time"), F.min_by(y, x).alias("start_level"), F.max_by(y, x).alias("end_level"))
    out = ends.join(fit, list(keys)).where("slope is not null")
    return out.select(*keys, F.round(-60 / F.col("slope"), 4).alias("rt60"), F.round("slope", 4).alias("slope"), F.round("r2", 4).alias("r2"), *[F.round(c, 4).alias(c) for c in ("start_time", "end_time", "start_level", "end_level")])


def bounce_budget(jobs: DataFrame, *, most: int = 128, most_cross: int = 128) -> DataFrame:
    """``jobs`` with effective (bounces to trace) and reason, from how much energy survives a bounce.

    ``jobs``: rays, bounces, survival (the band that survives best), multi_room, cross_room, portals.
    """
    asked, survival = F.col("bounces"), F.col("survival")
    needed = STEP * F.ceil(F.greatest(F.lit(1), F.ceil(F.log(F.lit(10 ** (FLOOR_DB / 10))) / F.log(survival))) / STEP)
    single = F.least(F.greatest(asked, F.lit(most)), F.greatest(asked, needed))
    extra = F.when((F.col("portals") > 1) | (survival >= REFLECTIVE), 2 * STEP).when(survival >= HALF_REFLECTIVE, STEP).otherwise(0)
    cross = F.least(F.lit(max(most_cross, LEAST_CROSS)), F.lit(LEAST_CROSS) + extra)
    small = (F.col("rays") < LEAST_RAYS) | (asked < LEAST_BOUNCES)
    reason = (
        F.when(small, "explicit_or_preview_budget")
        .when(~F.col("multi_room") & ~((survival > 0) & (survival < 1)), "no_decay_estimate")
        .when(~F.col("multi_room") & (single <= asked), "requested_budget_sufficient")
        .when(~F.col("multi_room"), "geometry_tail_convergence")
        .when(~F.col("cross_room"), "same_room_floorplan")
        .when(asked >= cross, "requested_budget_sufficient")
        .otherwise("cross_room_tail_convergence")
    )
    jobs = jobs.withColumn("reason", reason)
    effective = F.when(F.col("reason") == "geometry_tail_convergence", single).when(F.col("reason") == "cross_room_tail_convergence", cross).otherwise(asked)
    return jobs.withColumn("effective", effective.cast("int"))
