"""Strata, draws and arg-extremes over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomlake.operators import sampling, selection
from roomlake.plans.metrics import rounded
from roomlake.plans.registry import query

HASH = "(((({key}) % 2147483647 + {seed}) * 2654435761) % 2147483647)"


def strata_sql(rows: str, n: int, seed: int) -> str:
    return f"""SELECT * EXCLUDE (place, c, r) FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, stratum ORDER BY {HASH.format(key="c_custkey", seed=seed)}, c_custkey) AS r FROM (
SELECT *, floor(((place + 1) * least({n}, c) - 1) / c)::INT AS stratum FROM (
SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_nationkey) AS c FROM ({rows})))) WHERE r = 1"""


CUSTOMERS = "SELECT c_nationkey, c_custkey, c_acctbal FROM customer"


@query(strata_sql(CUSTOMERS, 5, 17))
def stratified_area_sample(read):
    rows = read("customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return sampling.equal_count_sample(rows, ["c_nationkey"], area="c_acctbal", index="c_custkey", n=5, seed=17)


@query(f"""WITH v AS ({strata_sql(CUSTOMERS, 3, 118)}), c AS ({strata_sql(CUSTOMERS + " WHERE c_custkey NOT IN (SELECT c_custkey FROM v)", 4, 119)}),
b AS (SELECT *, 'validation' AS split FROM v UNION ALL SELECT *, 'calibration' FROM c),
t AS (SELECT c_nationkey, quantile_cont(c_acctbal, 1/3) AS q33, quantile_cont(c_acctbal, 2/3) AS q67 FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, c_custkey, c_acctbal, split, stratum, CASE WHEN c_acctbal <= q33 THEN 'small' WHEN c_acctbal <= q67 THEN 'medium' ELSE 'large' END AS area_bin FROM b JOIN t USING (c_nationkey)""")
def stratified_split_disjoint(read):
    rows = read("customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return sampling.stratified_split(rows, "c_nationkey", area="c_acctbal", index="c_custkey", calibration=4, validation=3, seed=17)


@query("""SELECT s_nationkey, n, CASE WHEN n >= 8 THEN 5 ELSE greatest(1, least(5, n // 3)) END::INT AS calibration,
CASE WHEN n >= 8 THEN 3 ELSE least(3, n - greatest(1, least(5, n // 3))) END::INT AS validation FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey)""")
def adaptive_sample_counts(read):
    counted = read("supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    c, v = sampling.adaptive_counts(F.col("n"), calibration=5, validation=3)
    return counted.select("s_nationkey", "n", c.cast("int").alias("calibration"), v.cast("int").alias("validation"))


@query("""WITH t AS (SELECT p_size, quantile_cont(p_retailprice, 1/3) AS q33, quantile_cont(p_retailprice, 2/3) AS q67 FROM part GROUP BY p_size)
SELECT p_partkey, CASE WHEN p_retailprice <= q33 THEN 'small' WHEN p_retailprice <= q67 THEN 'medium' ELSE 'large' END AS relative_bin,
CASE WHEN p_retailprice < 1000 THEN '<1000' WHEN p_retailprice < 1300 THEN '1000-1300' WHEN p_retailprice < 1600 THEN '1300-1600' ELSE '1600+' END AS absolute_bin FROM part JOIN t USING (p_size)""")
def area_bins(read):
    part = read("part").select("p_partkey", "p_size", "p_retailprice")
    price = F.col("p_retailprice")
    joined = part.join(sampling.tertiles(part, ["p_size"], "p_retailprice"), "p_size")
    return joined.select("p_partkey", sampling.relative_bin(price, F.col("q33"), F.col("q67")).alias("relative_bin"), sampling.absolute_bin(price, (1000.0, 1300.0, 1600.0)).alias("absolute_bin"))


LEVELS = ("low", "medium", "high", "top")


def level():
    return F.when(F.col("p_retailprice") < 1100, "low").when(F.col("p_retailprice") < 1400, "medium").when(F.col("p_retailprice") < 1650, "high").otherwise("top")


LEVEL_SQL = "CASE WHEN p_retailprice < 1100 THEN 'low' WHEN p_retailprice < 1400 THEN 'medium' WHEN p_retailprice < 1650 THEN 'high' ELSE 'top' END"


@query(f"""WITH stock AS (SELECT p_brand || '/' || p_size AS family, {LEVEL_SQL} AS level, p_partkey FROM part),
drawn AS (SELECT family, level AS got, p_partkey AS drawn FROM (SELECT *, row_number() OVER (PARTITION BY family, level ORDER BY round(-ln(({HASH.format(key="p_partkey", seed=5)} + 1) / 2147483648.0), 9), p_partkey) AS r FROM stock) WHERE r = 1),
asked AS (SELECT family, level AS asked FROM (SELECT DISTINCT family FROM stock), (VALUES ('low'), ('medium'), ('high'), ('top')) t(level)),
pos AS (SELECT * FROM (VALUES ('low', 1), ('medium', 2), ('high', 3), ('top', 4)) t(name, k))
SELECT family, asked, got, drawn, CASE WHEN got <> asked THEN asked END AS fallback_from FROM (
SELECT family, asked, got, drawn, row_number() OVER (PARTITION BY family, asked ORDER BY abs(g.k - a.k), g.k) AS r FROM asked JOIN drawn USING (family) JOIN pos g ON g.name = got JOIN pos a ON a.name = asked) WHERE r = 1""")
def eligible_with_fallback(read):
    stock = read("part").select(F.concat_ws("/", "p_brand", "p_size").alias("family"), level().alias("level"), "p_partkey")
    wanted = stock.select("family").distinct().withColumn("level", F.explode(F.array(*[F.lit(x) for x in LEVELS])))
    return sampling.draw_with_fallback(wanted, stock, family="family", level="level", levels=LEVELS, index="p_partkey", seed=5)


@query(f"""SELECT p_partkey, CASE {LEVEL_SQL} WHEN 'low' THEN 'low,medium,high,top' WHEN 'medium' THEN 'medium,low,high,top' WHEN 'high' THEN 'high,medium,top,low' ELSE 'top,high,medium,low' END AS nearest FROM part""")
def nearest_class_order(read):
    return read("part").select("p_partkey", F.array_join(sampling.class_distance_order(LEVELS, level()), ",").alias("nearest"))


@query(f"""SELECT p_type, string_agg(DISTINCT {LEVEL_SQL}, ',' ORDER BY {LEVEL_SQL}) AS classes, arg_max(p_brand, (p_retailprice, -p_partkey)) AS default_family FROM part GROUP BY p_type""")
def catalog_available_classes(read):
    default = F.max_by("p_brand", F.struct("p_retailprice", -F.col("p_partkey")))
    return read("part").withColumn("level", level()).groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("level")), ",").alias("classes"), default.alias("default_family"))


@query("""SELECT s_suppkey, s_nationkey FROM (SELECT *, max(s_acctbal > 8000) OVER (PARTITION BY s_nationkey) AS any_one FROM supplier) WHERE s_acctbal > 8000 OR NOT any_one""")
def preferred_or_all(read):
    return selection.preferred_or_all(read("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], F.col("s_acctbal") > 8000).select("s_suppkey", "s_nationkey")


@query(f"""SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(-ln(({HASH.format(key="p_partkey", seed=3)} + 1) / 2147483648.0) / (1.0 / p_size), 9), p_partkey) AS r FROM part) WHERE r = 1""")
def weighted_draw(read):
    return sampling.weighted_draw(read("part"), ["p_brand"], weight=1 / F.col("p_size"), index="p_partkey", seed=3).select("p_brand", "p_partkey", "p_size")


@query("""WITH a AS (SELECT s_suppkey, (s_suppkey * 1664525 + 1013904223) % 4294967296 AS x1 FROM supplier), b AS (SELECT *, (x1 * 1664525 + 1013904223) % 4294967296 AS x2 FROM a),
c AS (SELECT *, (x2 * 1664525 + 1013904223) % 4294967296 AS x3 FROM b) SELECT s_suppkey, x1, x2, x3, (x3 * 1664525 + 1013904223) % 4294967296 AS x4 FROM c""")
def lcg_sequence(read):
    states = read("supplier").select("s_suppkey", sampling.lcg_sequence(F.col("s_suppkey"), 4).alias("x"))
    return states.select("s_suppkey", *[F.col("x")[k].alias(f"x{k + 1}") for k in range(4)])


@query("""WITH q AS (SELECT event_id, user_id, epoch_us(ts) AS asked_at FROM events WHERE event_type = 'view'), e AS (SELECT user_id, epoch_us(ts) AS event_at FROM events WHERE event_type = 'click'),
r AS (SELECT event_id, q.user_id, q.asked_at, (SELECT max(e.event_at) FROM e WHERE e.user_id = q.user_id AND e.event_at <= q.asked_at) AS previous, (SELECT min(e.event_at) FROM e WHERE e.user_id = q.user_id AND e.event_at >= q.asked_at) AS following FROM q)
SELECT event_id, user_id, asked_at, coalesce(previous, -1) AS previous, coalesce(following, -1) AS following, coalesce(CASE WHEN following IS NULL OR asked_at - previous <= following - asked_at THEN previous ELSE following END, -1) AS nearest FROM r""")
def asof_resolve_index(read):
    events = read("events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("asked_at"))
    asked = events.where("event_type = 'view'").drop("event_type")
    return selection.asof(asked, events.where("event_type = 'click'").select("user_id", F.col("asked_at").alias("event_at")), key="user_id", at="asked_at", event_at="event_at").withColumnRenamed("next", "following").fillna(-1, ["previous", "following", "nearest"])


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, -o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1""")
def argmin_preference(read):
    order = [selection.preference(F.col("o_orderpriority"), ("1-URGENT", "2-HIGH", "3-MEDIUM")), -F.col("o_totalprice"), F.col("o_orderkey")]
    return selection.arg_least(read("orders"), ["o_custkey"], order, ["o_orderkey", "o_orderpriority"])


@query("""SELECT l_linenumber, l_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice DESC, l_orderkey) AS rank FROM lineitem)
WHERE rank <= CASE l_linenumber WHEN 1 THEN 48 WHEN 2 THEN 32 WHEN 3 THEN 12 ELSE 0 END""")
def topk_quota_per_order(read):
    top = selection.top_by_quota(read("lineitem"), "l_linenumber", {1: 48, 2: 32, 3: 12}, [F.desc("l_extendedprice"), F.col("l_orderkey")])
    return top.select("l_linenumber", "l_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, round(list_inner_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, base_id) AS rank FROM s) WHERE rank <= 4),
w AS (SELECT *, 1 / greatest(acos(greatest(-1, least(1, cosine))), 1e-6) AS w FROM t)
SELECT query_id, base_id, round(cosine, 6) AS cosine, rank, round(w / sum(w) OVER (PARTITION BY query_id), 6) AS weight FROM w""")
def nearest_neighbors_k4(read):
    base = read("embeddings")
    top = selection.nearest_by_angle(base.where("vec_id % 20 = 0"), base, query_id="vec_id", base_id="vec_id", vector="embedding", k=4)
    return rounded(top.withColumn("rank", F.col("rank").cast("long")))


@query("""WITH u AS (SELECT label, embedding[i]::DOUBLE AS x, i FROM embeddings, range(1, 65) t(i) WHERE i <= len(embedding)),
n AS (SELECT label AS node_id, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i) GROUP BY label),
d AS (SELECT e.label, vec_id, min(round(sqrt(list_sum(list_transform(generate_series(1, len(embedding)), lambda i: (embedding[i]::DOUBLE - v[i]) ** 2))), 9)) AS clearance FROM embeddings e, n GROUP BY e.label, vec_id)
SELECT label, vec_id, round(clearance, 6) AS clearance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY clearance DESC, vec_id) AS r FROM d) WHERE r = 1""")
def maximin_point(read):
    base = read("embeddings")
    nodes = selection.centroids(base, ["label"], "embedding").select(F.col("embedding").alias("node"))
    return rounded(selection.maximin(base, nodes, group="label", point_id="vec_id", vector="embedding", node_vector="node"))
