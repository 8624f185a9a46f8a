"""Grouped metrics of study rows.

All are partial aggregates; exact percentiles come from counts of values that are
divided into ranges (:mod:`roomlake.operators.ranking`). Nulls are skipped as SQL does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomlake.operators.ranking import join_on, percentiles, with_place
from roomlake.storage import Workspace

#: What a configuration must reach: median and 90th percentile of the error, share of right rooms.
MEDIAN_AT_MOST, P90_AT_MOST, ACCURACY_AT_LEAST = 1.0, 2.0, 0.85
#: Draws of a bootstrap that one task makes, on average.
DRAWS_A_TASK = 2_000_000


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def group_metrics(rows: DataFrame, keys: Sequence[str], *, plan: str, error: str, correct: Column, local: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """plans, cases, median and p90 of ``error``, accuracy, and the same over rows that aren't ``local`` (null if none)."""
    cross, e = ~local, F.col(error)
    apart = F.when(cross, e)
    summed = rows.groupBy(*keys).agg(
        F.countDistinct(plan).alias("plans"),
        F.count("*").alias("cases"),
        share(correct).alias("accuracy"),
        F.count_if(cross).alias("cross_cases"),
        F.avg(F.when(cross, correct.cast("double"))).alias("cross_accuracy"),
        *extra,
    )
    found = percentiles(rows, keys, {"median_error": (e, 0.5), "p90_error": (e, 0.9), "cross_median": (apart, 0.5)})
    others = [c for c in summed.columns if c not in (*keys, "plans", "cases", "accuracy", "cross_cases", "cross_accuracy")]
    return join_on(summed, found, keys, "left").select(*keys, "plans", "cases", "median_error", "p90_error", "accuracy", "cross_cases", "cross_median", "cross_accuracy", *others)


def single_or_null(column: str) -> Column:
    """The value that all rows of a group share, else null."""
    return F.when(F.min(column) == F.max(column), F.min(column))


def population_summary(profiles: DataFrame, key: str, *, area: str, connected: Column, valid: Column) -> DataFrame:
    both, a = connected & valid, F.col(area)
    summed = profiles.groupBy(key).agg(F.count("*").alias("plans"), F.count_if(connected).alias("connected"), F.count_if(valid).alias("valid"), F.count_if(both).alias("eligible"), share(both).alias("eligible_rate"), F.min(area).alias("area_min"), F.max(area).alias("area_max"))
    found = percentiles(profiles, [key], {"area_p10": (a, 0.1), "area_median": (a, 0.5), "area_p90": (a, 0.9)})
    return join_on(summed, found, [key], "left").select(key, "plans", "connected", "valid", "eligible", "eligible_rate", "area_min", "area_p10", "area_median", "area_p90", "area_max")


def metric_means(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], flag: Column) -> DataFrame:
    """cases, share of ``flag``, mean and median of each metric over the rows that have it."""
    means = rows.groupBy(*keys).agg(F.count("*").alias("cases"), share(flag).alias("flag_share"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])
    return join_on(means, percentiles(rows, keys, {f"median_{m}": (F.col(m), 0.5) for m in metrics}), keys, "left")


def metrics_all_and_by(rows: DataFrame, key: str, *, error: str, correct: Column) -> DataFrame:
    """One pass over the rows for the whole and for each value of ``key``; the whole is named "all"."""
    kept = rows.select(F.col(key).alias("k"), F.col(error).alias("e"), correct.cast("double").alias("c"))
    none = F.lit(None).cast(kept.schema["k"].dataType)
    both = kept.select(F.inline(F.array(F.struct(F.lit(True).alias("whole"), none.alias("of")), F.struct(F.lit(False).alias("whole"), F.col("k").alias("of")))), "e", "c")
    summed = both.groupBy("whole", "of").agg(F.count("*").alias("cases"), F.avg("c").alias("accuracy"), F.avg("e").alias("mean_error"))
    e = F.col("e")
    found = join_on(summed, percentiles(both, ["whole", "of"], {"median_error": (e, 0.5), "p90_error": (e, 0.9)}), ["whole", "of"], "left")
    return found.select(F.when(F.col("whole"), "all").otherwise(F.col("of").cast("string")).alias("grouping"), "cases", "accuracy", "mean_error", "median_error", "p90_error")


def positive_share(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], improved: str) -> DataFrame:
    """cases, share of rows with a positive ``improved``, mean and 10th percentile of each metric."""
    means = rows.groupBy(*keys).agg(F.count("*").alias("cases"), share(F.col(improved) > 0).alias("positive_share"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])
    return join_on(means, percentiles(rows, keys, {f"p10_{m}": (F.col(m), 0.1) for m in metrics}), keys, "left")


def paired_comparison(rows: DataFrame, keys: Sequence[str], *, strategy: str, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Each strategy against the baseline's row of equal keys: pairs, mean difference and win rate of each metric."""
    base = rows.where(F.col(strategy) == baseline).select(*keys, *[F.col(m).alias(f"b_{m}") for m in metrics])
    joined = rows.where(F.col(strategy) != baseline).join(base, list(keys))
    each = []
    for m in metrics:
        d = F.col(m) - F.col(f"b_{m}")
        each += [F.avg(d).alias(f"delta_{m}"), F.avg((d > 0).cast("double")).alias(f"win_{m}")]
    return joined.groupBy(strategy).agg(F.count("*").alias("pairs"), *each)


def bootstrap_cluster_ci(rows: DataFrame, group: Sequence[str], *, cluster: str, value: str, iterations: int, multiplier: int = 2654435761, modulus: int = 2147483647, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """95 % interval of the mean of ``value`` when clusters (whole numbers) are drawn with replacement.

    Clusters are summed before they are resampled, so a replicate costs a row a
    cluster; draws are made where they are looked up, in a number of tasks that is said
    outright, and only the sums of clusters may be sent to all tasks. Groups of a null
    key give nothing. Draw d of a replicate takes the cluster of rank (hash of replicate
    and d) modulo the number of clusters; the hash is arithmetic, so any engine
    gives the same draws.
    """
    named = rows.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group], F.lit(True)))
    sums = named.groupBy(*group, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    ranked = with_place(sums, group, value=cluster, index=cluster, place="rank", count="clusters")
    ranked = Workspace(rows.sparkSession, "bootstrap").save(ranked, "clusters")
    dealt = ranked.select(*group, "clusters", F.col("rank").alias("draw")).repartition(1 + ranked.count() * iterations // DRAWS_A_TASK)
    draws = dealt.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    seed = F.col("replicate").cast("long") * 1000003 + F.col("draw").cast("long")
    draws = draws.withColumn("rank", F.pmod(F.pmod(seed * multiplier, F.lit(modulus).cast("long")), F.col("clusters")).cast("int"))
    # every draw has its cluster; of a left join Spark never sends the left side, whose size it takes for that of its clusters
    means = draws.join(ranked.select(*group, "rank", "s", "n"), [*group, "rank"], "left").groupBy(*group, "replicate").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.groupBy(*group).agg(F.percentile("m", low).alias("ci_low"), F.percentile("m", high).alias("ci_high"))


def adequate(median: str = "median_error", p90: str = "p90_error", accuracy: str = "accuracy") -> Column:
    return (F.col(median) <= MEDIAN_AT_MOST) & (F.col(p90) <= P90_AT_MOST) & (F.col(accuracy) >= ACCURACY_AT_LEAST)


def penalty(median: str = "median_error", p90: str = "p90_error", accuracy: str = "accuracy") -> Column:
    return F.col(median) + 0.5 * F.col(p90) + 2 * (1 - F.col(accuracy))


def recommend(metrics: DataFrame, keys: Sequence[str], *, count: str) -> DataFrame:
    """For each key the smallest adequate configuration, or that of the smallest penalty; ties by count."""
    order = Window.partitionBy(*keys).orderBy(F.desc("adequate"), F.when(F.col("adequate"), F.col(count)), "penalty", count)
    return metrics.withColumn("adequate", adequate()).withColumn("penalty", penalty()).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def recommend_tiers(metrics: DataFrame, keys: Sequence[str], *, count: str, least: Column, confident: Column) -> DataFrame:
    """As :func:`recommend`, preferring configurations whose whole interval is adequate (tier 1) to those whose point is (2)."""
    tier = F.when(confident & adequate(), 1).when(adequate(), 2).otherwise(3)
    order = Window.partitionBy(*keys).orderBy("tier", F.when(F.col("tier") < 3, F.col(count)), "penalty", count)
    return metrics.where(F.col(count) >= least).withColumn("penalty", penalty()).withColumn("tier", tier).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def counters(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """counter, name, n: how often each element of the array columns ``groups`` occurs."""

    def named(counter: str, array: Column) -> Column:
        return F.transform(array, lambda x: F.struct(F.lit(counter).alias("counter"), x.alias("name")))

    pairs = F.flatten(F.array(*[named(k, array) for k, array in groups.items()]))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.counter", "p.name").agg(F.count("*").alias("n"))
