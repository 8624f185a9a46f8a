"""Reverberation targets, fits and budgets over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomlake.operators import reverb
from roomlake.plans.metrics import rounded
from roomlake.plans.registry import query

FITS_SQL = "f AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'double' ELSE 'single' END AS shape, (p_size % 5) * 0.2::DOUBLE AS rt60, (p_partkey % 4) * 0.3::DOUBLE AS rt60_late, (p_partkey % 3) * 0.25::DOUBLE AS standard FROM part)"


def _fits(read):
    n, k = F.col("p_size"), F.col("p_partkey")
    return read("part").select(k, F.when(n % 3 == 0, "double").otherwise("single").alias("shape"), (n % 5 * 0.2).alias("rt60"), (k % 4 * 0.3).alias("rt60_late"), (k % 3 * 0.25).alias("standard"))


TARGETS_SQL = f"""{FITS_SQL}, t AS (SELECT p_partkey, CASE WHEN shape = 'double' AND rt60_late > 0 THEN rt60_late WHEN standard > 0 THEN standard WHEN shape = 'single' AND rt60 > 0 THEN rt60 ELSE 0 END AS target,
CASE WHEN shape = 'double' AND rt60_late > 0 THEN 'fitted_late_slope' WHEN standard <= 0 AND shape = 'single' AND rt60 > 0 THEN 'fitted_wide_range_single_slope' ELSE 'steam_single_slope' END AS source FROM f)"""


@query(f"WITH {TARGETS_SQL} SELECT p_partkey, round(target, 6) AS target, source FROM t")
def late_reverb_targets(read):
    return rounded(reverb.late_targets(_fits(read)).select("p_partkey", "target", "source"))


@query(f"""WITH {TARGETS_SQL}, c AS (SELECT p_partkey, (p_size % 4) * 0.4::DOUBLE AS coupled FROM part WHERE p_partkey % 5 <> 0)
SELECT p_partkey, round(CASE WHEN coupled > 0 THEN coupled ELSE target END, 6) AS target, CASE WHEN coupled > 0 THEN 'coupled_room_energy_matrix' ELSE source END AS source, coalesce(CASE WHEN coupled > 0 THEN round(target, 4) END, -1) AS traced FROM t LEFT JOIN c USING (p_partkey)""")
def coupled_reverb_prior(read):
    prior = read("part").where("p_partkey % 5 <> 0").select("p_partkey", (F.col("p_size") % 4 * 0.4).alias("coupled"))
    return rounded(reverb.with_prior(reverb.late_targets(_fits(read)).select("p_partkey", "target", "source"), prior, ["p_partkey"]).fillna(-1, ["traced"]))


@query("""WITH t AS (SELECT l_orderkey, CASE l_linenumber % 6 WHEN 0 THEN '125' WHEN 1 THEN '250' WHEN 2 THEN '500' WHEN 3 THEN '1000' WHEN 4 THEN '2000' ELSE '4000' END AS band, l_discount::DOUBLE * 10 AS v FROM lineitem)
SELECT l_orderkey, round(coalesce(avg(v) FILTER (WHERE v > 0 AND band IN ('125', '250', '500')), 0), 4) AS low, round(coalesce(avg(v) FILTER (WHERE v > 0 AND band IN ('1000', '2000', '4000')), 0), 4) AS mid FROM t GROUP BY l_orderkey""")
def broad_band_times(read):
    bands = F.array(*[F.lit(b) for b in (*reverb.LOW_BANDS, *reverb.MID_BANDS)])
    rows = read("lineitem").select("l_orderkey", F.element_at(bands, (F.col("l_linenumber") % 6 + 1).cast("int")).alias("band"), (F.col("l_discount").cast("double") * 10).alias("v"))
    return reverb.broad_bands(rows, ["l_orderkey"], band="band", value="v")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'single_space_geometry' WHEN s_nationkey % 4 <> s_suppkey % 4 THEN 'cross_room' ELSE 'same_room' END AS space, coalesce(CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0 THEN 'coupled_space_decay' END, '') AS model FROM supplier""")
def decay_context(read):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    context = reverb.space_context(k % 3 != 0, (n % 4).cast("string"), (k % 4).cast("string"), F.when(k % 2 == 0, "double").otherwise("single"))
    return read("supplier").select("s_suppkey", context.alias("c")).select("s_suppkey", "c.space", F.coalesce("c.model", F.lit("")).alias("model"))


POINTS_SQL = "p AS (SELECT user_id, event_type, epoch_us(ts) / 86400000000.0 - 19700 AS x, -value::DOUBLE - (epoch_us(ts) / 86400000000.0 - 19700) AS y FROM events)"


def _points(read):
    x = F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000.0 - 19700
    return read("events").select("user_id", "event_type", x.alias("x"), (-F.col("value").cast("double") - x).alias("y"))


@query(f"""WITH {POINTS_SQL}, r AS (SELECT event_type, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy FROM p GROUP BY event_type)
SELECT event_type, n, round(CASE WHEN slope < -1e-9 THEN slope END, 5) AS slope, round(CASE WHEN slope < -1e-9 THEN intercept END, 3) AS intercept, round(CASE WHEN slope < -1e-9 THEN r2 END, 6) AS r2, round(CASE WHEN slope < -1e-9 THEN (1 - r2) * syy / n END, 3) AS mse FROM r""")
def decay_line_fit(read):
    fit = reverb.line_fit(_points(read), ["event_type"], x="x", y="y")
    return fit.select("event_type", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), F.round(F.col("sse") / F.col("n"), 3).alias("mse"))


@query(f"""WITH {POINTS_SQL}, s AS (SELECT event_type, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, min(x) AS start_time, max(x) AS end_time, arg_min(y, x) AS start_level, arg_max(y, x) AS end_level FROM (SELECT *, row_number() OVER (PARTITION BY event_type, x ORDER BY y) AS r FROM p) WHERE r = 1 GROUP BY event_type)
SELECT event_type, round(-60 / slope, 4) AS rt60, round(slope, 4) AS slope, round(r2, 4) AS r2, round(start_time, 4) AS start_time, round(end_time, 4) AS end_time, round(start_level, 4) AS start_level, round(end_level, 4) AS end_level FROM s WHERE slope < -1e-9""")
def decay_segments(read):
    return reverb.segments(_points(read).groupBy("event_type", "x").agg(F.min("y").alias("y")), ["event_type"], x="x", y="y")


@query("""WITH j AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 8192 ELSE 65536 END AS rays, 48 + (s_suppkey % 4) * 32 AS bounces, 0.7 + (s_nationkey % 10) * 0.033::DOUBLE AS survival, s_suppkey % 2 = 0 AS multi, s_suppkey % 3 = 0 AS crossing, s_nationkey % 3 AS portals FROM supplier),
n AS (SELECT *, 16 * ceil(greatest(1, ceil(ln(10 ** -2.5) / ln(survival))) / 16) AS needed, least(128, 96 + CASE WHEN portals > 1 OR survival >= 0.9 THEN 32 WHEN survival >= 0.82 THEN 16 ELSE 0 END) AS cross_ FROM j), m AS (SELECT *, least(greatest(bounces, 128), greatest(bounces, needed)) AS single FROM n),
r AS (SELECT *, CASE WHEN rays < 32768 OR bounces < 64 THEN 'explicit_or_preview_budget' WHEN NOT multi AND NOT (survival > 0 AND survival < 1) THEN 'no_decay_estimate' WHEN NOT multi AND single <= bounces THEN 'requested_budget_sufficient' WHEN NOT multi THEN 'geometry_tail_convergence' WHEN NOT crossing THEN 'same_room_floorplan' WHEN bounces >= cross_ THEN 'requested_budget_sufficient' ELSE 'cross_room_tail_convergence' END AS reason FROM m)
SELECT s_suppkey, reason, CASE reason WHEN 'geometry_tail_convergence' THEN single WHEN 'cross_room_tail_convergence' THEN cross_ ELSE bounces END::INT AS effective FROM r""")
def bounce_budget(read):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    jobs = read("supplier").select(k, F.when(k % 4 == 0, 8192).otherwise(65536).alias("rays"), (48 + k % 4 * 32).cast("int").alias("bounces"), (0.7 + n % 10 * 0.033).alias("survival"), (k % 2 == 0).alias("multi_room"), (k % 3 == 0).alias("cross_room"), (n % 3).alias("portals"))
    return reverb.bounce_budget(jobs).select("s_suppkey", "reason", "effective")
