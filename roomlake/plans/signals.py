"""Decay curves and signal measures over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomlake.operators import decay
from roomlake.plans.metrics import rounded
from roomlake.plans.registry import query

#: Events of a user as energy in bins of a day, counted from the user's first event.
BINS_SQL = """bins AS (SELECT user_id, (epoch_us(ts) // 86400000000) - min(epoch_us(ts) // 86400000000) OVER (PARTITION BY user_id) AS bin, abs(value) AS e FROM events),
b AS (SELECT user_id, bin, sum(e) AS energy FROM bins GROUP BY ALL),
c AS (SELECT *, sum(energy) OVER (PARTITION BY user_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS edc, sum(energy) OVER (PARTITION BY user_id) AS total FROM b),
d AS (SELECT *, 10 * log10(greatest(edc / nullif(total, 0), 1e-12)) AS db FROM c)"""


def _bins(read):
    from pyspark.sql import Window

    day = F.expr("unix_micros(cast(ts as timestamp)) div 86400000000")
    binned = read("events").select("user_id", (day - F.min(day).over(Window.partitionBy("user_id"))).alias("bin"), F.abs("value").alias("e"))
    return binned.groupBy("user_id", "bin").agg(F.sum("e").alias("energy"))


@query(f"WITH {BINS_SQL} SELECT user_id, bin, round(edc, 6) AS edc, round(db, 6) + 0.0 AS db FROM d")
def edc_decay(read):
    return rounded(decay.decay_curve(_bins(read), ["user_id"], at="bin", energy="energy").select("user_id", "bin", "edc", "db")).withColumn("db", F.col("db") + 0.0)


@query(f"""WITH {BINS_SQL}, f AS (SELECT user_id, max(total) AS total, count(*) FILTER (WHERE db BETWEEN -25 AND -5) AS n, regr_slope(db, bin * 0.1) FILTER (WHERE db BETWEEN -25 AND -5) AS slope FROM d GROUP BY user_id)
SELECT user_id, n AS points, round(CASE WHEN total >= 1e-12 AND n >= 2 AND slope < -1e-9 THEN -60 / slope ELSE 0 END, 6) AS rt60 FROM f""")
def schroeder_rt60(read):
    return rounded(decay.schroeder_rt60(_bins(read), ["user_id"], at="bin", energy="energy", bin_seconds=0.1))


def _two_slopes_sql() -> str:
    """Sums before, after and over all of each point, the three lines from them, and the best of the splits that are good enough."""
    terms = {"n": "1.0", "x": "x", "y": "y", "xx": "x * x", "xy": "x * y", "yy": "y * y"}
    frames = {"l": "ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "r": "ORDER BY x ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING", "a": ""}
    sums = [f"{f} OVER (PARTITION BY user_id {w}) AS {s}_{n}" for s, w in frames.items() for n, f in (*((t, f"sum({e})") for t, e in terms.items()), ("hi", "max(y)"), ("lo", "min(y)"))]
    fits = []
    for s in frames:
        sxx, sxy, syy = (f"({s}_{a}{b} - {s}_{a} * {s}_{b} / {s}_n)" for a, b in ("xx", "xy", "yy"))
        slope = f"CASE WHEN {s}_n >= 2 AND {sxx} > 0 THEN {sxy} / {sxx} END"
        sse = f"greatest({syy} - ({slope}) * {sxy}, 1e-12)"
        fits += [f"{slope} AS {s}_slope", f"CASE WHEN {s}_n >= 2 THEN {sse} END AS {s}_sse", f"CASE WHEN {s}_n >= 2 AND {syy} > 0 THEN 1 - {sse} / {syy} END AS {s}_r2"]
    gain = "a_n * ln(a_sse / a_n) + 2 * ln(a_n) - (a_n * ln((l_sse + r_sse) / a_n) + 5 * ln(a_n))"
    enough = " AND ".join(f"{s}_n >= 3 AND {s}_hi - {s}_lo >= 3 AND {s}_slope < -1e-9 AND {s}_r2 >= 0.95" for s in "lr")
    good = f"{enough} AND a_n >= 6 AND a_hi - a_lo >= 6 AND {gain} >= 10 AND greatest(l_slope / r_slope, r_slope / l_slope) >= 1.35"
    return f"""WITH {BINS_SQL}, p AS (SELECT user_id, bin * 0.1 AS x, db AS y FROM d WHERE db BETWEEN -35 AND -5), s AS (SELECT *, {", ".join(sums)} FROM p), f AS (SELECT *, {", ".join(fits)} FROM s),
z AS (SELECT user_id, count(*) AS points, any_value(a_slope) AS slope, arg_max({{'l': l_slope, 'r': r_slope, 'x': x}}, ({gain}, -x)) FILTER (WHERE {good}) AS best FROM f GROUP BY user_id)
SELECT user_id, points, CASE WHEN best IS NOT NULL THEN 'double' ELSE 'single' END AS shape, round(CASE WHEN slope < -1e-9 THEN -60 / slope END, 6) AS rt60, round(-60 / best.l, 6) AS rt60_early, round(-60 / best.r, 6) AS rt60_late, round(best.x::DOUBLE, 6) AS knee FROM z"""


@query(_two_slopes_sql())
def decay_two_segment(read):
    return rounded(decay.two_slopes(_bins(read), ["user_id"], at="bin", energy="energy", bin_seconds=0.1, least_points=3, least_span=3.0))


UNNEST = "x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _samples(read):
    return decay.samples(read("embeddings"), ["vec_id"], "embedding")


@query(f"""WITH {UNNEST}, p AS (SELECT *, max(abs(x)) OVER (PARTITION BY vec_id) AS peak FROM x)
SELECT vec_id, round(max(peak), 6) AS peak, round(min(pos) FILTER (WHERE abs(x) >= 0.5 * peak) / 16000.0, 9) AS arrival FROM p GROUP BY vec_id""")
def arrival_detection(read):
    return decay.arrivals(_samples(read), ["vec_id"], ratio=0.5, fs=16000.0).select("vec_id", F.round("peak", 6).alias("peak"), F.round("arrival", 9).alias("arrival"))


@query(f"WITH {UNNEST} SELECT vec_id, (pos // 8)::INT AS block, round(arg_max(x, (abs(x), -pos)), 6) AS x FROM x GROUP BY vec_id, block")
def peak_preview(read):
    return rounded(decay.peak_preview(_samples(read), ["vec_id"], 8))


@query(f"""WITH {UNNEST}, d AS (SELECT vec_id, pos, x * x AS e, pos - 4 AS since, x FROM x)
SELECT vec_id, round(max(abs(x)), 6) AS peak, round(sum(e), 6) AS energy, round(sqrt(avg(e)), 6) AS rms,
round(10 * log10(sum(e) FILTER (WHERE since BETWEEN 0 AND 7) / sum(e) FILTER (WHERE since >= 8)), 6) AS c_8,
round(10 * log10(sum(e) FILTER (WHERE since BETWEEN 0 AND 15) / sum(e) FILTER (WHERE since >= 16)), 6) AS c_16,
round(10 * log10(sum(e) FILTER (WHERE abs(since) <= 2) / sum(e) FILTER (WHERE abs(since) > 2)), 6) AS drr FROM d GROUP BY vec_id""")
def rir_metrics(read):
    return rounded(decay.clarity(_samples(read).withColumn("direct", F.lit(4)), ["vec_id"], direct="direct", early=(8, 16), window=2))


PAIRS = "p AS (SELECT a.vec_id // 2 AS pair, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id AND a.vec_id % 2 = 0)"


def _pairs(read):
    rows = read("embeddings").groupBy(F.expr("vec_id div 2").alias("pair")).agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("embedding"))).alias("a"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("embedding"))).alias("b"))
    return rows.where("a is not null and b is not null")


@query(f"""WITH {PAIRS} SELECT pair, round(10 * log10(greatest(list_inner_product(a, a) / len(a), 1e-20) / greatest(list_inner_product(b, b) / len(b), 1e-20)), 6) AS snr_db FROM p""")
def snr_db(read):
    return rounded(_pairs(read).select("pair", decay.snr_db(F.col("a"), F.col("b")).alias("snr_db")))


@query(f"""WITH {PAIRS}, c AS (SELECT pair, list_transform(a, lambda x: x - list_avg(a)) AS e, list_transform(b, lambda x: x - list_avg(b)) AS r FROM p),
s AS (SELECT pair, list_inner_product(e, r) AS er, list_inner_product(r, r) AS rr, list_inner_product(e, e) AS ee FROM c)
SELECT pair, round(10 * log10(greatest(er * er / rr, 1e-20) / greatest(ee - er * er / rr, 1e-20)), 5) AS si_sdr_db FROM s""")
def si_sdr_db(read):
    return rounded(_pairs(read).select("pair", decay.si_sdr_db(F.col("a"), F.col("b")).alias("si_sdr_db")), 5)


@query(f"""WITH {PAIRS}, g AS (SELECT *, sqrt((list_inner_product(a, a) / len(a)) / (list_inner_product(b, b) / len(b)) / 10) AS gain FROM p)
SELECT pair, round(gain, 6) AS gain, round(list_sum(list_transform(generate_series(1, len(a)), lambda i: (a[i] + b[i] * gain) ** 2)), 6) AS mixed_energy FROM g""")
def mix_at_snr(read):
    mixed = decay.mix_at_snr(F.col("a"), F.col("b"), 10.0)
    return rounded(_pairs(read).select("pair", decay.gain_to_snr(F.col("a"), F.col("b"), 10.0).alias("gain"), (decay.power(mixed) * F.size(mixed)).alias("mixed_energy")))


@query(f"WITH {UNNEST}, k AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, -0.5), (3, 0.25)) t(d, g)) SELECT vec_id, (pos + d)::INT AS pos, round(sum(x * g), 6) AS x FROM x, k  GROUP BY ALL")
def convolution(read):
    return rounded(decay.convolve(_samples(read), ["vec_id"], (1.0, -0.5, 0.0, 0.25)).withColumn("x", F.col("x") + 0.0))


@query("""WITH k AS (SELECT vec_id, embedding::DOUBLE[] AS a, unnest(range(0, 96)) AS k FROM embeddings), l AS (SELECT *, least(floor(k / 1.5)::INT, 63) AS low, k / 1.5 AS place FROM k)
SELECT vec_id, k::INT AS pos, round(a[low + 1] * (1 - least(place - low, 1)) + a[least(low + 1, 63) + 1] * least(place - low, 1), 6) AS x FROM l""")
def resample_linear(read):
    out = read("embeddings").select("vec_id", F.posexplode(decay.resample_linear(F.col("embedding"), 1.5)).alias("pos", "x"))
    return rounded(out)


@query("SELECT user_id, round(value)::BIGINT AS pos, round(sum(1 / (1 + value)), 6) AS x FROM (SELECT user_id, abs(value) AS value FROM events) GROUP BY ALL")
def impulse_scatter(read):
    taps = read("events").select("user_id", F.abs("value").alias("delay")).withColumn("gain", 1 / (1 + F.col("delay")))
    return rounded(decay.scatter_impulses(taps, ["user_id"], delay="delay", gain="gain", fs=1.0))


@query("""SELECT user_id, count(*) AS frames, round(max(d), 6) AS max_step, round(max(value) - min(value), 6) AS span FROM (
SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events) GROUP BY user_id""")
def adjacent_continuity(read):
    return rounded(decay.steps(read("events"), ["user_id"], order=["ts", "event_id"], value="value"))


@query("""SELECT conv_id, count(*) AS frames, bool_and(coalesce(n > p, true)) AS increasing FROM (SELECT conv_id, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY conv_id""")
def phase_monotonic(read):
    return decay.strictly_increasing(read("conversations").withColumn("n", F.length("text")), ["conv_id"], order=["turn"], value="n")
