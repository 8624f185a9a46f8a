"""Deterministic samples, strata and draws.

Draws use arithmetic hashes of stable keys, never the order of partitions, so
the same rows are drawn wherever and however often the query runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomlake.operators import ranking

KNUTH, PRIME = 2654435761, 2147483647


def arithmetic_hash(key: Column, seed: int = 0) -> Column:
    """A whole number below 2**31 - 1, by multiplication only."""
    return F.pmod((F.pmod(key.cast("long"), F.lit(PRIME).cast("long")) + F.lit(seed).cast("long")) * KNUTH, F.lit(PRIME).cast("long"))


def equal_count_sample(rows: DataFrame, keys: Sequence[str], *, area: str, index: str, n: int, seed: int) -> DataFrame:
    """One row of each of ``n`` strata of equal count, by (area, index); stratum i has the places floor(i c / n) up to floor((i + 1) c / n).

    Groups of fewer than ``n`` rows give all.
    """
    placed = ranking.with_place(rows, keys, value=area, index=index)
    strata = F.least(F.lit(n), F.col("_c"))
    # the stratum of place p is the largest i with floor(i c / n) <= p
    placed = placed.withColumn("stratum", F.floor(((F.col("_at") + 1) * strata - 1) / F.col("_c")).cast("int"))
    pick = Window.partitionBy(*keys, "stratum").orderBy(arithmetic_hash(F.col(index), seed), index)
    return placed.withColumn("_r", F.row_number().over(pick)).where("_r = 1").drop("_r", "_at", "_c")


def tertiles(rows: DataFrame, keys: Sequence[str], area: str) -> DataFrame:
    a = F.col(area)
    return ranking.percentiles(rows, keys, {"q33": (a, 1 / 3), "q67": (a, 2 / 3)})


def relative_bin(area: Column, q33: Column, q67: Column) -> Column:
    return F.when(area <= q33, "small").when(area <= q67, "medium").otherwise("large")


def absolute_bin(area: Column, edges: Sequence[float] = (60.0, 100.0, 150.0)) -> Column:
    """ "<60", "60-100", ... and "150+"; a bin contains its lower edge."""
    out = F.when(area < edges[0], f"<{edges[0]:g}")
    for low, high in zip(edges, edges[1:]):
        out = out.when(area < high, f"{low:g}-{high:g}")
    return F.when(area.isNotNull(), out.otherwise(f"{edges[-1]:g}+"))


def stratified_split(rows: DataFrame, key: str, *, area: str, index: str, calibration: int, validation: int, seed: int) -> DataFrame:
    """Validation is sampled first and calibration from the rest; both disjoint, with the bin of the key's tertiles."""
    second = equal_count_sample(rows, [key], area=area, index=index, n=validation, seed=seed + 101).withColumn("split", F.lit("validation"))
    rest = rows.join(second.select(index), index, "left_anti")
    first = equal_count_sample(rest, [key], area=area, index=index, n=calibration, seed=seed + 102).withColumn("split", F.lit("calibration"))
    both = first.unionByName(second).join(tertiles(rows, [key], area), key)
    return both.withColumn("area_bin", relative_bin(F.col(area), F.col("q33"), F.col("q67"))).select(key, index, area, "split", "stratum", "area_bin")


def adaptive_counts(population: Column, *, calibration: int, validation: int) -> tuple[Column, Column]:
    """Sizes of the two samples: as asked where the population allows, else a third and what is left."""
    full = population >= calibration + validation
    small = F.greatest(F.lit(1), F.least(F.lit(calibration), F.floor(population / 3).cast("int")))
    c = F.when(full, calibration).otherwise(small)
    return c, F.when(full, validation).otherwise(F.least(F.lit(validation), population.cast("int") - c))


def weighted_draw(rows: DataFrame, keys: Sequence[str], *, weight: Column, index: str, seed: int) -> DataFrame:
    """One row of each group, with a probability in proportion to ``weight``: the smallest -ln(u) / weight wins."""
    u = (arithmetic_hash(F.col(index), seed) + 1) / F.lit(float(PRIME + 1))
    w = Window.partitionBy(*keys).orderBy("_cost", index)
    return rows.withColumn("_cost", F.round(-F.log(u) / weight, 9)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_cost", "_r")


def lcg_sequence(seed: Column, n: int, *, a: int = 1664525, c: int = 1013904223, m: int = 4294967296) -> Column:
    """The first ``n`` states of a linear congruential generator."""
    start = F.array(F.pmod(seed.cast("long") * a + c, F.lit(m).cast("long")))
    return F.aggregate(F.sequence(F.lit(2), F.lit(n)), start, lambda s, _: F.concat(s, F.array(F.pmod(F.element_at(s, -1) * a + c, F.lit(m).cast("long"))))) if n > 1 else start


def class_distance_order(classes: Sequence[str], asked: Column) -> Column:
    """The ordered classes by their distance from ``asked``; of equal ones the lower first."""
    order = F.array(*[F.lit(c) for c in classes])
    at = F.array_position(order, asked)
    ranked = F.array_sort(F.transform(order, lambda c, k: F.struct(F.abs(k + 1 - at).alias("d"), k.alias("k"), c.alias("c"))))
    return F.transform(ranked, lambda s: s["c"])


def draw_with_fallback(wanted: DataFrame, stock: DataFrame, *, family: str, level: str, levels: Sequence[str], index: str, seed: int) -> DataFrame:
    """For each wanted (family, level) a row of the stock: of that level, else of the nearest level the family has.

    The stock is reduced to one drawn row a family and level before it meets the
    wishes; ``fallback_from`` names the level asked for where another was taken.
    """
    drawn = weighted_draw(stock, [family, level], weight=F.lit(1.0), index=index, seed=seed).select(family, F.col(level).alias("got"), F.col(index).alias("drawn"))
    order = F.array(*[F.lit(x) for x in levels])
    place = lambda c: F.array_position(order, c)
    best = F.min(F.struct(F.abs(place(F.col("got")) - place(F.col("asked"))).alias("d"), place(F.col("got")).alias("k"), "got", "drawn"))
    found = wanted.select(family, F.col(level).alias("asked")).distinct().join(drawn, family, "left").groupBy(family, "asked").agg(best.alias("b"))
    return found.select(family, "asked", F.col("b.got").alias("got"), F.col("b.drawn").alias("drawn"), F.when(F.col("b.got") != F.col("asked"), F.col("asked")).alias("fallback_from"))
