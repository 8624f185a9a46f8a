"""Profiles of plans: each room once, what is wrong with it, and whether the plan can be used.

Plans and rooms are rows. Only the greedy choice among near-equal rooms depends on
an order; a plan's rooms are one group there, and plans run side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomlake.functions import shapes
from roomlake.operators.ranking import join_on

#: Room types in the order of preference, with their least and largest area (m2) and least width (m).
LIMITS = {"living": (6.0, 120.0, 1.5), "bedroom": (4.0, 60.0, 1.2), "kitchen": (2.0, 40.0, 0.8), "bathroom": (1.0, 25.0, 0.5), "storage": (0.5, 30.0, 0.4), "balcony": (0.5, 40.0, 0.3)}
#: Corners and aspect of a room, rooms of a plan, and the area (m2) that rooms may share.
MOST_CORNERS, MOST_ASPECT, MOST_ROOMS, MOST_SHARED = 64, 10.0, 14, 0.05
#: The part of their union from which two rooms are one, and connections that lead outdoors.
SAME_FROM, EXTERIOR = 0.95, ("outdoor_entry", "outdoor_facade", "outdoor_balcony")
#: The least thickness (m) of a surface.
LEAST_SURFACE = 0.015


def _limit(kind: Column, k: int) -> Column:
    return F.try_element_at(F.create_map(*[x for name, row in LIMITS.items() for x in (F.lit(name), F.lit(row[k]))]), kind)


def type_rank(kind: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in LIMITS]), kind)
    return F.when(at > 0, at - 1).otherwise(len(LIMITS)).cast("int")


def room_issues(kind: Column, area: Column, width: Column, depth: Column, corners: Column, holes: Column) -> Column:
    """What is implausible about a room, in metres; an empty array for a sound one."""
    narrow, wide = F.least(width, depth), F.greatest(width, depth)
    return F.array_compact(
        F.array(
            F.when(~area.between(_limit(kind, 0), _limit(kind, 1)), "implausible_area"),
            F.when(narrow < _limit(kind, 2), "too_narrow"),
            F.when(corners > MOST_CORNERS, "too_many_vertices"),
            F.when(holes > 0, "interior_holes"),
            F.when(wide / F.greatest(narrow, F.lit(1e-9)) > MOST_ASPECT, "extreme_aspect_ratio"),
        )
    )


def deduplicate_rooms(rooms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rooms`` (keys, room, type, area, corners) with ``survivor``: the room of its type, before it in order, that covers the same ground, or itself."""
    head = ", ".join(f"`{k}` {rooms.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_rank", "area", "room"], ascending=[True, False, True])
        kept: list[tuple[str, str, np.ndarray, float]] = []
        survivors = []
        for r in pdf.itertuples(index=False):
            corners = np.array([list(c) for c in r.corners], float)
            size = abs(shapes.signed_area(corners))
            for name, kind, other, other_size in kept:
                shared = shapes.overlap(corners, other) if kind == r.type else 0.0
                if shared > 0 and shared / max(size + other_size - shared, 1e-9) >= SAME_FROM:
                    survivors.append(name)
                    break
            else:
                kept.append((r.room, r.type, corners, size))
                survivors.append(r.room)
        return pdf.assign(survivor=survivors)[[*keys, "room", "survivor"]]

    found = rooms.withColumn("_rank", type_rank(F.col("type"))).groupBy(*keys).applyInPandas(run, f"{head}, room string, survivor string")
    return join_on(rooms, found, [*keys, "room"])


def plan_profiles(plans: DataFrame, rooms: DataFrame, key: str) -> DataFrame:
    """Eligibility of each plan and why not, with counts of its rooms.

    ``plans``: key, has_graph, stairs, inner_parts, overlapping, scale_source.
    ``rooms``: key, room, type, survivor, issues. A plan without a graph counts no rooms.
    """
    own = F.col("room") == F.col("survivor")
    sound = own & (F.size("issues") == 0)
    counted = rooms.where(F.col("type").isin(*LIMITS)).groupBy(key).agg(
        F.count("*").alias("raw"),
        F.count_if(own).alias("distinct"),
        F.count_if(sound).alias("sound"),
        F.bool_or(sound & (F.col("type") == "living")).alias("living"),
        F.array_sort(F.collect_list(F.when(sound, F.col("room")))).alias("rooms"),
    )
    issues = rooms.where(F.col("type").isin(*LIMITS) & own).select(key, F.explode("issues").alias("issue")).groupBy(key, "issue").agg(F.count("*").alias("n"))
    issues = issues.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue", "n")))).alias("issue_counts"))
    all_ = plans.join(counted, key, "left").join(issues, key, "left")
    has = F.coalesce("has_graph", F.lit(False))
    n = lambda c: F.when(has, F.coalesce(c, F.lit(0))).otherwise(0)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("stairs"), "stair_or_multilevel"),
            F.when(F.col("inner_parts") > 1, "disconnected_inner_geometry"),
            F.when(F.col("sound") > MOST_ROOMS, "too_many_rooms"),
            F.when(~F.coalesce("living", F.lit(False)), "no_valid_living_room"),
            F.when(F.col("overlapping"), "overlapping_rooms"),
        )
    )
    reasons = F.when(has, reasons).otherwise(F.array(F.lit("invalid_graph")))
    none = F.array().cast("array<string>")
    return all_.select(
        key, (F.size(reasons) == 0).alias("eligible"), reasons.alias("filter_reasons"), "scale_source", F.when(has, F.coalesce("rooms", none)).otherwise(none).alias("valid_rooms"),
        n("raw").alias("raw_rooms"), n("distinct").alias("distinct_rooms"), n(F.col("raw") - F.col("distinct")).alias("duplicate_rooms"), n(F.col("distinct") - F.col("sound")).alias("invalid_rooms"),
        F.when(has, F.coalesce("issue_counts", F.create_map().cast("map<string,bigint>"))).otherwise(F.create_map().cast("map<string,bigint>")).alias("issue_counts"),
    )


def exterior_exposures(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, room, feature, place, type, connection: what of each room lies outdoors. ``features``: keys, place, feature, type, connection, room_ids."""
    return features.where(F.col("connection").isin(*EXTERIOR)).select(*keys, F.explode("room_ids").alias("room"), "feature", "place", "type", "connection")


def connector_connection(scored: DataFrame, keys: Sequence[str], *, proximity: Column) -> DataFrame:
    """Where each door or window leads: to the room that it touches most, or outdoors.

    ``scored``: keys, kind, room, room_type, distance, score (length of contact); a row with a null room for what touches none.
    """
    near = (F.col("distance") <= proximity) & (F.col("score") > 0)
    best = F.max_by("room_type", F.when(near, F.struct("score", F.col("room"))))
    found = scored.groupBy(*keys, "kind").agg(best.alias("best"))
    outdoors = F.when(F.col("kind") == "window", "outdoor_facade").otherwise("outdoor_or_unmatched")
    return found.select(*keys, "kind", F.when(F.col("best") == "balcony", "outdoor_balcony").when(F.col("best").isNotNull(), "interior_room").otherwise(outdoors).alias("connection"))


def best_pairs(candidates: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, first, second: of the rooms that a door touches (keys, place, room, length) the pair that is linked, and of these the longest; of equal ones the first.

    ``edges``: keys without the door, a, b in both directions. A door touches a few rooms.
    """
    above = [k for k in keys if k in edges.columns]
    one, two = (candidates.select(*keys, *[F.col(c).alias(f"{c}_{n}") for c in ("place", "room", "length")]) for n in (1, 2))
    pairs = one.join(two, list(keys)).where("place_1 < place_2")
    linked = edges.select(*above, F.col("a").alias("room_1"), F.col("b").alias("room_2"), F.lit(1).alias("linked")).distinct()
    scored = pairs.join(linked, [*above, "room_1", "room_2"], "left")
    order = F.struct(F.coalesce("linked", F.lit(0)).alias("l"), (F.col("length_1") + F.col("length_2")).alias("n"), -F.col("place_1"), -F.col("place_2"))
    return scored.groupBy(*keys).agg(F.max_by(F.struct("room_1", "room_2"), order).alias("b")).select(*keys, F.col("b.room_1").alias("first"), F.col("b.room_2").alias("second"))


def unpaired(candidates: DataFrame, paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, first, second, place: pairs (keys, place, first, second) that no door joins, each once, whichever way round, at its first place."""
    both = lambda df: F.array_sort(F.array("first", "second"))
    seen = paired.select(*keys, both(paired).alias("_pair")).distinct()
    rows = candidates.where("first <> second").withColumn("_pair", both(candidates)).join(seen, [*keys, "_pair"], "left_anti")
    return rows.groupBy(*keys, "_pair").agg(F.min(F.struct("place", "first", "second")).alias("f")).select(*keys, "f.first", "f.second", "f.place")


def features_at_height(features: Column, height: Column) -> Column:
    """Features or portals under another ceiling: sills and heights end there."""
    sill = lambda f: F.least(F.greatest(F.lit(0.0), F.coalesce(f["sill_height_m"], F.lit(0.0))), height)
    tall = lambda f: F.least(F.coalesce(f["height_m"], height), F.greatest(F.lit(0.0), height - sill(f)))
    return F.transform(features, lambda f: f.withField("height_m", F.round(tall(f), 6)).withField("sill_height_m", F.round(sill(f), 6)))


def surfaces_at_height(surfaces: Column, base: Column, height: Column) -> Column:
    """Surfaces under another ceiling: what ended at the old one ends at the new; what becomes too thin goes."""
    moved = lambda z: F.least(F.greatest(F.lit(0.0), F.when(F.abs(z - base) < 1e-6, height).otherwise(z)), height)
    low, high = (lambda s: moved(F.coalesce(s["z_min"], F.lit(0.0)))), (lambda s: moved(F.coalesce(s["z_max"], base)))
    fitted = F.transform(F.filter(surfaces, lambda s: high(s) - low(s) >= LEAST_SURFACE), lambda s: s.withField("z_low", F.round(low(s), 6)).withField("z_high", F.round(high(s), 6)))
    return F.transform(fitted, lambda s: s.withField("z_min", s["z_low"]).withField("z_max", s["z_high"]).dropFields("z_low", "z_high"))


def room_of_point(points: DataFrame, rooms: DataFrame, keys: Sequence[str], point: str, inside, margin) -> DataFrame:
    """keys, point, room: the room that holds a point, and of several that whose walls are farthest; null for none.

    ``inside`` and ``margin``: columns of a point's x, y and a room's corners. Rooms
    of one plan meet its points only.
    """
    met = points.join(rooms.select(*keys, F.col("room").alias("_room"), "corners"), list(keys), "left").withColumn("_in", inside)
    best = F.max_by("_room", F.when(F.col("_in"), F.struct(margin.alias("m"), F.col("_room"))))
    return met.groupBy(*keys, point).agg(best.alias("room"))


def first_room_of_point(points: DataFrame, rooms: DataFrame, keys: Sequence[str], point: str, inside) -> DataFrame:
    """keys, point, room: the first room (by place) that holds a point; null for none."""
    met = points.join(rooms.select(*keys, F.col("room").alias("_room"), F.col("place").alias("_place"), "corners"), list(keys), "left").withColumn("_in", inside)
    return met.groupBy(*keys, point).agg(F.min_by("_room", F.when(F.col("_in"), F.col("_place"))).alias("room"))


def snapped(points: DataFrame, portals: DataFrame, keys: Sequence[str], point: str) -> DataFrame:
    """``points`` (keys, point, x, y, room) with the nearest portal point (keys, px, py) for those in no room, if the plan has any."""
    outside = points.where("room is null").join(portals, list(keys)).groupBy(*keys, point).agg(F.min(F.struct(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")).alias("d"), "px", "py")).alias("p"))
    out = points.join(outside, [*keys, point], "left")
    return out.select(*keys, point, F.coalesce("p.px", "x").alias("x"), F.coalesce("p.py", "y").alias("y"), "room")


def object_absorption(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surface, centre by surface, and absorbing area by band of each object, from its boxes (keys, x, y, width, depth, height, absorption)."""
    size = [F.greatest(F.col(c), F.lit(0.0)) for c in ("width", "depth", "height")]
    area = 2 * (size[0] * size[1] + size[0] * size[2] + size[1] * size[2])
    summed = boxes.withColumn("_a", area).groupBy(*keys).agg(F.sum("_a").alias("surface"), F.sum(F.col("_a") * F.col("x")).alias("_x"), F.sum(F.col("_a") * F.col("y")).alias("_y"), F.first("absorption").alias("_alpha")).where("surface > 1e-12")
    return summed.select(*keys, "surface", (F.col("_x") / F.col("surface")).alias("x"), (F.col("_y") / F.col("surface")).alias("y"), F.transform("_alpha", lambda a: a * F.col("surface")).alias("absorbing"))


def last_kept(points: DataFrame, keys: Sequence[str], *, order: str, columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Points along their order without those that lie within ``tolerance`` of the last one kept. A line is one row's work."""
    line = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *[F.col(c).cast("double").alias(f"p{k}") for k, c in enumerate(columns)]))).alias("line"))
    far = lambda a, b: F.sqrt(sum(((a[f"p{k}"] - b[f"p{k}"]) * (a[f"p{k}"] - b[f"p{k}"]) for k in range(len(columns))), F.lit(0.0))) > tolerance
    kept = F.aggregate(F.slice("line", F.lit(2), F.size("line")), F.slice("line", 1, 1), lambda acc, p: F.when(far(F.element_at(acc, -1), p), F.concat(acc, F.array(p))).otherwise(acc))
    return line.select(*keys, F.inline(kept)).select(*keys, F.col("o").alias(order), *[F.col(f"p{k}").alias(c) for k, c in enumerate(columns)])
