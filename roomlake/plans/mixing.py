"""Tracks, gains, arrivals and orientations over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomlake.operators import arrays, mixing
from roomlake.plans.metrics import rounded
from roomlake.plans.registry import query
from roomlake.plans.signals import PAIRS, UNNEST, _pairs, _samples


@query(f"""WITH {UNNEST}, t AS (SELECT vec_id // 4 AS case_id, vec_id % 4 AS n, pos, x FROM x WHERE vec_id % 4 <> 1 AND (vec_id % 4 <> 3 OR pos < 32)), c AS (SELECT DISTINCT case_id, n FROM t),
e AS (SELECT case_id, k AS channel, pos, x FROM t, range(0, 2) r(k) WHERE n = 0 OR (n = 2 AND (k = 0 OR NOT EXISTS (SELECT 1 FROM c WHERE c.case_id = t.case_id AND c.n = 3))) OR n = 3 AND k = 1),
m AS (SELECT case_id, channel, pos, sum(x) AS x FROM e WHERE true GROUP BY ALL), p AS (SELECT *, max(abs(x)) OVER (PARTITION BY case_id) AS peak FROM m)
SELECT case_id, channel::INT AS channel, pos::INT AS pos, round(CASE WHEN peak > 0.3 THEN x * 0.3 / peak ELSE x END, 6) + 0.0 AS x FROM p""")
def mix_tracks(read):
    """Of four vectors the first is a track of one channel, the last two are one of two, of which the second is short."""
    n = F.col("vec_id") % 4
    rows = _samples(read).where((n != 1) & ((n != 3) | (F.col("pos") < 32)))
    rows = rows.select(F.expr("vec_id div 4").alias("case_id"), F.when(n == 0, 0).otherwise(1).alias("track"), F.when(n == 3, 1).otherwise(0).alias("channel"), "pos", "x", F.lit(2).alias("channels"))
    return rounded(mixing.mix_tracks(rows.withColumn("channels", F.lit(2)), ["case_id", "channels"], channels="channels", peak=0.3).drop("channels").withColumn("x", F.col("x") + 0.0)).withColumn("x", F.col("x") + 0.0)


COMPONENTS_SQL = f"{UNNEST}, s AS (SELECT vec_id // 3 AS case_id, CASE vec_id % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'interferer' ELSE 'background' END AS component, pos, x FROM x)"
GAINS_SQL = f"""{COMPONENTS_SQL}, w AS (SELECT case_id, avg(x * x) FILTER (WHERE component = 'target') AS t, avg(x * x) FILTER (WHERE component = 'interferer') AS i, avg(x * x) FILTER (WHERE component = 'background') AS b FROM s WHERE pos >= 9 GROUP BY case_id),
g AS (SELECT case_id, CASE WHEN i > 1e-12 THEN sqrt(t / i / 10 ** 0.5) ELSE 1 END AS interferer, CASE WHEN b > 1e-12 THEN sqrt(t / b / 10) ELSE 1 END AS background, sqrt(t) / 10 ** 1.5 AS sensor FROM w)"""


def _components(read):
    n = F.col("vec_id") % 3
    return _samples(read).select(F.expr("vec_id div 3").alias("case_id"), F.when(n == 0, "target").when(n == 1, "interferer").otherwise("background").alias("component"), F.lit(0).alias("channel"), "pos", "x")


def _gains(read):
    return mixing.common_gains(_components(read), ["case_id"], start=9, interferer_snr=5.0, background_snr=10.0, sensor_snr=30.0)


@query(f"WITH {GAINS_SQL} SELECT case_id, round(interferer, 6) AS interferer, round(background, 6) AS background, round(sensor, 6) AS sensor FROM g")
def common_gains(read):
    return rounded(_gains(read))


@query(f"""WITH {GAINS_SQL}, wide AS (SELECT case_id, pos, coalesce(sum(x) FILTER (WHERE component = 'target'), 0) AS t, coalesce(sum(x) FILTER (WHERE component = 'interferer'), 0) AS i, coalesce(sum(x) FILTER (WHERE component = 'background'), 0) AS b FROM s GROUP BY ALL)
SELECT case_id, round(sum((t + i * interferer + b * background + (pos % 5 - 2) * sensor) ** 2), 6) AS mixture, round(sum((i * interferer + b * background + (pos % 5 - 2) * sensor) ** 2), 6) AS noise FROM wide JOIN g USING (case_id) GROUP BY case_id""")
def mixed_components(read):
    mixed = mixing.with_gains(_components(read), _gains(read), ["case_id"], noise=(F.col("pos") % 5 - 2).cast("double"))
    power = lambda c: F.sum(F.col(c) * F.col(c)).alias(c)
    return rounded(mixed.groupBy("case_id").agg(power("mixture"), power("noise")))


@query(f"""WITH {PAIRS}, l AS (SELECT pair, k, abs(list_sum(list_transform(generate_series(greatest(0, k) + 1, 64 + least(0, k)), lambda i: a[i] * b[i - k]))) AS r FROM p, range(-5, 6) t(k)),
m AS (SELECT pair, arg_max(k, r) AS k FROM l GROUP BY pair), c AS (SELECT pair, k, a[greatest(k, 0) + 1 : 64 + least(k, 0)] AS e, b[greatest(-k, 0) + 1 : 64 - greatest(k, 0)] AS r FROM m JOIN p USING (pair)),
z AS (SELECT pair, k, list_transform(e, lambda x: x - list_avg(e)) AS e, list_transform(r, lambda x: x - list_avg(r)) AS r FROM c), s AS (SELECT pair, k, list_inner_product(e, r) AS er, list_inner_product(r, r) AS rr, list_inner_product(e, e) AS ee FROM z)
SELECT pair, k::INT AS shift, round(10 * log10(greatest(er * er / rr, 1e-20) / greatest(ee - er * er / rr, 1e-20)), 5) AS si_sdr FROM s""")
def aligned_si_sdr(read):
    found = _pairs(read).select("pair", arrays.aligned(F.col("a").cast("array<double>"), F.col("b").cast("array<double>"), 5).alias("f"))
    return rounded(found.select("pair", "f.*"), 5)


MICS = ((0.0, 0.0, 1.0), (0.2, 0.1, 1.1), (-0.1, 0.3, 0.9))
MICS_SQL = "m AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for k, (x, y, z) in enumerate(MICS)) + ") t(channel, x, y, z))"


def _microphones():
    return F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(row, "xyz")]) for row in MICS])


def _source():
    k = F.col("s_suppkey")
    return F.struct((k % 10).cast("double").alias("x"), (k % 7).cast("double").alias("y"), F.lit(1.5).alias("z"))


@query(f"WITH {MICS_SQL} SELECT s_suppkey, channel::INT AS channel, round(sqrt((x - s_suppkey % 10) ** 2 + (y - s_suppkey % 7) ** 2 + (z - 1.5) ** 2) / 343 * 1e6, 6) AS arrival_us FROM supplier, m")
def source_arrivals(read):
    rows = read("supplier").select("s_suppkey", F.posexplode(mixing.arrivals_from_source(_source(), _microphones())).alias("channel", "t"))
    return rounded(rows.select("s_suppkey", "channel", (F.col("t") * 1e6).alias("arrival_us")))


@query(f"""WITH {MICS_SQL}, a AS (SELECT s_suppkey, channel, -(x * cos(radians(s_suppkey * 13 % 360)) + y * sin(radians(s_suppkey * 13 % 360))) / 343 AS t FROM supplier, m)
SELECT s_suppkey, channel::INT AS channel, round((t - min(t) OVER (PARTITION BY s_suppkey)) * 1e6, 6) AS arrival_us FROM a""")
def bearing_arrivals(read):
    rows = read("supplier").select("s_suppkey", F.posexplode(mixing.arrivals_from_azimuth((F.col("s_suppkey") * 13 % 360).cast("double"), _microphones())).alias("channel", "t"))
    return rounded(rows.select("s_suppkey", "channel", (F.col("t") * 1e6).alias("arrival_us")))


@query(f"WITH {MICS_SQL} SELECT s_suppkey, channel::INT AS channel, round(s_suppkey % 10 + x, 6) AS x, round(s_suppkey % 7 + y, 6) AS y FROM supplier, m WHERE s_suppkey % 3 <> 0 OR channel = 0")
def receiver_channels(read):
    offsets = F.when(F.col("s_suppkey") % 3 != 0, F.transform(_microphones(), lambda m: F.struct(m["x"].alias("x"), m["y"].alias("y"))))
    rows = read("supplier").select("s_suppkey", F.posexplode(mixing.receiver_channels(_source(), offsets)).alias("channel", "p"))
    return rounded(rows.select("s_suppkey", "channel", "p.x", "p.y"))


@query("""WITH a AS (SELECT s_suppkey, radians(s_suppkey * 7 % 360) AS yaw, radians(greatest(-90, least(90, s_suppkey % 200 - 100))) AS up, (['omni', 'cardioid', 'dipole', 'focused', 'directivity'])[s_suppkey % 5 + 1] AS pattern FROM supplier)
SELECT s_suppkey, round(cos(up) * cos(yaw), 6) + 0.0 AS x, round(cos(up) * sin(yaw), 6) + 0.0 AS y, round(sin(up), 6) AS z, CASE pattern WHEN 'directivity' THEN 'custom' ELSE pattern END AS pattern,
CASE pattern WHEN 'omni' THEN 0.0 WHEN 'dipole' THEN 1.0 ELSE 0.5 END::DOUBLE AS weight, CASE pattern WHEN 'focused' THEN 4.0 ELSE 1.0 END::DOUBLE AS power FROM a""")
def source_orientation(read):
    k = F.col("s_suppkey")
    pattern = F.element_at(F.array(*[F.lit(x) for x in ("Omni", "cardioid", "dipole", "focused", "directivity")]), (k % 5 + 1).cast("int"))
    none = F.lit(None).cast("double")
    rows = read("supplier").select(k, mixing.forward((k * 7 % 360).cast("double"), (k % 200 - 100).cast("double")).alias("f"), mixing.directivity(pattern, none, none).alias("d"))
    return rows.select("s_suppkey", (F.round("f.x", 6) + 0.0).alias("x"), (F.round("f.y", 6) + 0.0).alias("y"), F.round("f.z", 6).alias("z"), "d.pattern", "d.weight", "d.power")


@query("""WITH c AS (SELECT s_suppkey, k, (s_suppkey % 5 + k * k)::DOUBLE AS x, (k * 3 % 4 - s_suppkey % 3)::DOUBLE AS y FROM supplier, range(0, 4) t(k)), b AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY s_suppkey))
SELECT s_suppkey, k::INT AS k, round(0.1 + (x - x0) / greatest(x1 - x0, 1e-6) * 4.8, 6) AS x, round(0.08 + (y - y0) / greatest(y1 - y0, 1e-6) * 3.84, 6) AS y FROM b""")
def fitted_corners(read):
    n = F.col("s_suppkey")
    corners = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((n % 5 + k * k).cast("double").alias("x"), (k * 3 % 4 - n % 3).cast("double").alias("y")))
    rows = read("supplier").select(n, F.posexplode(mixing.fitted_corners(corners, F.lit(5.0), F.lit(4.0), 0.02)).alias("k", "p"))
    return rounded(rows.select("s_suppkey", "k", "p.x", "p.y"))
