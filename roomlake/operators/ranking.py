"""Exact places and percentiles within groups, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which each group's values are divided (a power of two); a group of a third of all rows is sorted by so many tasks.
RANGES = 64


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by ``keys``, of which nulls are equal; the columns of ``left``, then the others of ``right``."""
    named = right.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *[F.col(c) for c in right.columns if c not in keys])
    on = F.lit(True)
    for n, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    joined = left.join(named, on, how) if keys else left.crossJoin(named)  # without keys it is one row
    return joined.drop(*[f"_k{n}" for n in range(len(keys))])


def ranged(rows: DataFrame, keys: Sequence[str], value: str, *, ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``_range``: the number of the group's approximate quantiles below the value, by halving; -1 for null."""
    steps = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, steps, 1000).alias("_cuts"))
    halves = F.array(*[F.lit(ranges >> k) for k in range(1, ranges.bit_length())])
    below = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.element_at("_cuts", at + half) < F.col(value), at + half).otherwise(at))
    return join_on(rows, cuts, keys).withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(below)).drop("_cuts")


def with_place(rows: DataFrame, keys: Sequence[str], *, value: str, index: str, place: str = "_at", count: str = "_c", ranges: int = RANGES) -> DataFrame:
    """``rows`` with the place (from 0) of each in its group by (value, index), and the group's size.

    Approximate quantiles, merged from partial sketches, divide a group into ranges
    of value. Rows are numbered within a range, and a range goes on where those
    before it end; the ranges of a group are a small table. Nulls come first.
    """
    divided = ranged(rows, keys, value, ranges=ranges)
    sizes = divided.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*keys, "_range", before.alias("_before"), F.sum("_n").over(w).alias(count))
    local = divided.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(value, index)) - 1)
    return join_on(local, offsets, [*keys, "_range"]).withColumn(place, F.col("_local") + F.col("_before")).drop("_local", "_before", "_range")


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once; null if one is."""
    zero = F.lit(0.0)
    called = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), *[F.coalesce(x, zero) for x in (a, b, c)]).cast("double")
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), called)


def percentiles(rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """``keys`` and for each name the exact percentile (a part of 1) of a column's values, between two of them by proportion; null without values.

    The proportion is rounded as DuckDB does: of two equal values it may miss them by the last bit, which decides on which side of it they are.
    Equal values of a group are counted before they are shuffled. The counts are
    divided into ranges and summed up in each, so that a group of very many
    different values is no task of its own.
    """
    names = list(wanted)
    which = {n: next(k for k, m in enumerate(names) if wanted[m][0] is wanted[n][0]) for n in names}  # names of one column share its counts
    parts = F.array(*[F.struct(F.lit(k).alias("w"), wanted[names[k]][0].cast("double").alias("v")) for k in sorted(set(which.values()))])
    each = rows.select(*keys, F.inline(F.filter(parts, lambda x: x["v"].isNotNull())))
    counts = each.groupBy(*keys, "w", "v").agg(F.count("*").alias("n"))  # its shuffle is reused wherever it stands below
    group = [*keys, "w"]
    divided = ranged(counts, group, "v")
    sizes = divided.groupBy(*group, "_range").agg(F.sum("n").alias("_n"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*group, "_range", before.alias("_before"), F.sum("_n").over(w).alias("_all"))
    last = F.sum("n").over(Window.partitionBy(*group, "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = join_on(divided.withColumn("_last", last), offsets, [*group, "_range"]).withColumn("_last", F.col("_last") + F.col("_before"))
    has = lambda at: (F.col("_last") > at) & (F.col("_last") - F.col("n") <= at)
    found = []
    for k, name in enumerate(names):
        here, at = F.col("w") == which[name], (F.col("_all") - 1) * F.lit(float(wanted[name][1]))
        found += [F.max(F.when(here & has(F.floor(at)), F.col("v"))).alias(f"_lo{k}"), F.max(F.when(here & has(F.ceil(at)), F.col("v"))).alias(f"_hi{k}"), F.max(F.when(here, at)).alias(f"_at{k}")]
    picked = placed.groupBy(*keys).agg(*found)
    lo, hi, at = (lambda k, x=x: F.col(f"_{x}{k}") for x in ("lo", "hi", "at"))
    past = lambda k: at(k) - F.floor(at(k))
    between = lambda k: F.when(F.floor(at(k)) == F.ceil(at(k)), lo(k)).otherwise(fused(lo(k), 1 - past(k), hi(k) * past(k)))
    return picked.select(*keys, *[between(k).alias(n) for k, n in enumerate(names)])
