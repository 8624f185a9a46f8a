"""Grouped metrics over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomlake.operators import agg
from roomlake.plans.registry import query


def flags():
    """Whether a row counts as right, and as local; columns need a running session, so they are made on demand."""
    return {"correct": F.col("l_discount") <= 0.05, "local": F.col("l_linestatus") == "F"}


def rounded(df, digits: int = 6):
    """Doubles to a fixed number of digits, so that the order of summation doesn't show."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


GROUP_METRICS = """
count(DISTINCT l_orderkey) AS plans, count(*) AS cases, round(median(l_quantity), 6) AS median_error, round(quantile_cont(l_quantity, 0.9), 6) AS p90_error,
round(avg((l_discount <= 0.05)::INT), 6) AS accuracy, count(*) FILTER (WHERE NOT l_linestatus = 'F') AS cross_cases,
round(median(l_quantity) FILTER (WHERE NOT l_linestatus = 'F'), 6) AS cross_median,
round(avg((l_discount <= 0.05)::INT) FILTER (WHERE NOT l_linestatus = 'F'), 6) AS cross_accuracy"""


@query(f"SELECT l_returnflag, {GROUP_METRICS} FROM lineitem GROUP BY l_returnflag")
def group_metrics(read):
    rows = read("lineitem")
    return rounded(agg.group_metrics(rows, ["l_returnflag"], plan="l_orderkey", error="l_quantity", **flags()))


@query(f"""SELECT l_shipmode_key, {GROUP_METRICS}, min(l_linenumber) AS node_min, max(l_linenumber) AS node_max,
CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS single_status
FROM (SELECT *, l_suppkey % 7 AS l_shipmode_key FROM lineitem) GROUP BY l_shipmode_key""")
def group_metrics_minmax(read):
    rows = read("lineitem").withColumn("l_shipmode_key", F.col("l_suppkey") % 7)
    extra = [F.min("l_linenumber").alias("node_min"), F.max("l_linenumber").alias("node_max"), agg.single_or_null("l_linestatus").alias("single_status")]
    return rounded(agg.group_metrics(rows, ["l_shipmode_key"], plan="l_orderkey", error="l_quantity", **flags(), extra=extra))


@query("""SELECT p_size, count(*) AS plans, count(*) FILTER (WHERE p_type LIKE '%STEEL%') AS connected, count(*) FILTER (WHERE p_brand <> 'Brand#11') AS valid,
count(*) FILTER (WHERE p_type LIKE '%STEEL%' AND p_brand <> 'Brand#11') AS eligible, round(avg((p_type LIKE '%STEEL%' AND p_brand <> 'Brand#11')::INT), 6) AS eligible_rate,
round(min(p_retailprice), 6) AS area_min, round(quantile_cont(p_retailprice, 0.1), 6) AS area_p10, round(median(p_retailprice), 6) AS area_median,
round(quantile_cont(p_retailprice, 0.9), 6) AS area_p90, round(max(p_retailprice), 6) AS area_max FROM part GROUP BY p_size""")
def population_summary(read):
    return rounded(agg.population_summary(read("part"), "p_size", area="p_retailprice", connected=F.col("p_type").like("%STEEL%"), valid=F.col("p_brand") != "Brand#11"))


@query("""SELECT o_orderpriority, count(*) AS cases, round(avg((o_totalprice > 150000)::INT), 6) AS flag_share, round(avg(l_quantity), 6) AS mean_l_quantity,
round(median(l_quantity), 6) AS median_l_quantity, round(avg(tax), 6) AS mean_tax, round(median(tax), 6) AS median_tax
FROM (SELECT o_orderpriority, o_totalprice, l_quantity, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS tax
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""")
def metric_aggregate_nullskip(read):
    lines = read("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_quantity", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")).alias("tax"))
    rows = read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rounded(agg.metric_means(rows, ["o_orderpriority"], ["l_quantity", "tax"], F.col("o_totalprice") > 150000))


@query("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS grouping, count(*) AS cases, round(avg((o_orderstatus = 'F')::INT), 6) AS accuracy,
round(avg(o_totalprice), 6) AS mean_error, round(median(o_totalprice), 6) AS median_error, round(quantile_cont(o_totalprice, 0.9), 6) AS p90_error
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def group_all_and_by(read):
    return rounded(agg.metrics_all_and_by(read("orders"), "o_orderpriority", error="o_totalprice", correct=F.col("o_orderstatus") == "F"))


@query("""SELECT c_nationkey, count(*) AS cases, round(avg((c_acctbal > 0)::INT), 6) AS positive_share, round(avg(c_acctbal), 6) AS mean_c_acctbal, round(quantile_cont(c_acctbal, 0.1), 6) AS p10_c_acctbal
FROM customer GROUP BY c_nationkey""")
def positive_share_p10(read):
    return rounded(agg.positive_share(read("customer"), ["c_nationkey"], ["c_acctbal"], "c_acctbal"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, sum(value) AS value FROM events GROUP BY ALL),
b AS (SELECT user_id, day, value AS b FROM d WHERE event_type = 'click')
SELECT event_type, count(*) AS pairs, round(avg(value - b), 5) AS delta_value, round(avg((value - b > 0)::INT), 5) AS win_value
FROM d JOIN b USING (user_id, day) WHERE event_type <> 'click' GROUP BY event_type""")
def paired_comparison(read):
    daily = read("events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.sum("value").alias("value"))
    return rounded(agg.paired_comparison(daily, ["user_id", "day"], strategy="event_type", baseline="click", metrics=["value"]), 5)


@query("""WITH s AS (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS s, count(l_quantity) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_suppkey) - 1 AS rank, count(*) OVER (PARTITION BY l_returnflag) AS clusters FROM s),
d AS (SELECT l_returnflag, replicate, ((replicate::BIGINT * 1000003 + rank) * 2654435761 % 2147483647) % clusters AS pick FROM r, range(1, 201) t(replicate)),
m AS (SELECT d.l_returnflag, d.replicate, sum(r.s) / sum(r.n) AS m FROM d JOIN r ON d.l_returnflag = r.l_returnflag AND d.pick = r.rank GROUP BY ALL)
SELECT l_returnflag, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m GROUP BY l_returnflag""")
def cluster_bootstrap_ci(read):
    return rounded(agg.bootstrap_cluster_ci(read("lineitem"), ["l_returnflag"], cluster="l_suppkey", value="l_quantity", iterations=200))


CONFIGURATIONS = """SELECT p_brand, p_size, round(median(p_retailprice) / 1300, 4) AS median_error, round(quantile_cont(p_retailprice, 0.9) / 900, 4) AS p90_error,
round(1 - (p_size % 10) / 40.0, 4) AS accuracy FROM part GROUP BY p_brand, p_size"""


def _configurations(read):
    return read("part").groupBy("p_brand", "p_size").agg(F.round(F.median("p_retailprice") / 1300, 4).alias("median_error"), F.round(F.percentile("p_retailprice", 0.9) / 900, 4).alias("p90_error")).withColumn(
        "accuracy", F.round(1 - (F.col("p_size") % 10) / F.lit(40.0), 4)
    )


@query(f"""SELECT p_brand, p_size, median_error, p90_error, accuracy, adequate, round(penalty, 6) AS penalty FROM (
SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY adequate DESC, CASE WHEN adequate THEN p_size END NULLS FIRST, penalty, p_size) AS r FROM (
SELECT *, median_error <= 1 AND p90_error <= 2 AND accuracy >= 0.85 AS adequate, median_error + 0.5 * p90_error + 2 * (1 - accuracy) AS penalty FROM ({CONFIGURATIONS}))) WHERE r = 1""")
def recommend_min_adequate(read):
    return rounded(agg.recommend(_configurations(read), ["p_brand"], count="p_size"))


@query(f"""SELECT p_brand, p_size, median_error, p90_error, accuracy, round(penalty, 6) AS penalty, tier FROM (
SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, CASE WHEN tier < 3 THEN p_size END NULLS FIRST, penalty, p_size) AS r FROM (
SELECT *, median_error + 0.5 * p90_error + 2 * (1 - accuracy) AS penalty,
CASE WHEN median_error <= 1 AND p90_error <= 2 AND accuracy >= 0.85 THEN CASE WHEN p90_error <= 1.5 THEN 1 ELSE 2 END ELSE 3 END::INT AS tier FROM ({CONFIGURATIONS}) WHERE p_size >= 3)) WHERE r = 1""")
def recommend_three_tier(read):
    return rounded(agg.recommend_tiers(_configurations(read), ["p_brand"], count="p_size", least=F.lit(3), confident=F.col("p90_error") <= 1.5))


@query("""SELECT counter, name, count(*) AS n FROM (
SELECT 'lang' AS counter, lang AS name FROM documents UNION ALL SELECT 'issue', unnest(list_filter([CASE WHEN n_chars < 400 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN contains(text, '|') THEN 'bars' END], lambda x: x IS NOT NULL)) FROM documents
) GROUP BY counter, name""")
def dataset_stats_counters(read):
    issues = F.array_compact(F.array(F.when(F.col("n_chars") < 400, "short"), F.when(F.col("n_chars") > 5000, "long"), F.when(F.col("text").contains("|"), "bars")))
    return agg.counters(read("documents"), {"lang": F.array("lang"), "issue": issues})


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def source_group_counts(read):
    return read("documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"))
