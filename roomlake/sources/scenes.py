"""Scene records: typed, normalised to tables, and stored.

A scene is a floor plan with rooms, portals, features and surfaces. Stored as
Parquet it is ordered by its dense index, so that a lookup by index reads the
row groups around it only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomlake.sources import sqlite

POINT = "struct<x:double,y:double>"
ROOM = "struct<id:string,type:string,area_m2:double,corners:array<array<double>>>"
PORTAL = "struct<id:string,type:string,room_ids:array<string>,room_points:map<string,array<double>>,center:array<double>,width_m:double,sill_height_m:double,height_m:double,open:boolean>"
FEATURE = "struct<id:string,type:string,segments:array<array<array<double>>>,sill_height_m:double,height_m:double,connection:string,open:boolean,room_ids:array<string>>"
SURFACE = "struct<a:array<double>,b:array<double>,type:string,z_min:double,z_max:double,name:string,room_id:string>"
SCENE = (
    "struct<source_index:bigint,sample_id:string,unit_type:string,net_area_m2:double,gross_area_m2:double,meters_per_unit:double,scale_source:string,wall_depth_m:double,height_m:double,"
    f"size:array<double>,corners:array<array<double>>,rooms:array<{ROOM}>,portals:array<{PORTAL}>,features:array<{FEATURE}>,surfaces:array<{SURFACE}>>"
)


def read_packed(spark: SparkSession, path: str, *, idx: tuple[int, int] | None = None) -> DataFrame:
    """idx and the typed scene of a packed file (table scenes: idx, source_idx, compressed JSON).

    With a first and a last ``idx`` only these rows leave the file.
    """
    return sqlite.read_table(spark, path, "scenes", between=None if idx is None else ("idx", *idx)).select("idx", F.from_json(sqlite.inflate(F.col("payload")), SCENE).alias("scene")).select("idx", "scene.*")


def store(scenes: DataFrame, path: str) -> None:
    """Write scenes under a dense index in the order of source_index.

    Ranges of source_index are numbered within, and each goes on where those before
    it end; the driver has a count a range.
    """
    ranged = scenes.drop("idx").withColumn("_part", F.floor(F.col("source_index") / 1_000_000))
    from pyspark.sql import Window

    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("source_index")) - 1
    numbered = ranged.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn("idx", F.col("_place") + F.col("_before"))
    numbered.drop("_part", "_place", "_before").repartitionByRange("idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(path)


def record(scenes: DataFrame, idx: int) -> DataFrame:
    return scenes.where(F.col("idx") == idx)


def rooms(scenes: DataFrame) -> DataFrame:
    return scenes.select("idx", F.posexplode("rooms").alias("place", "r")).select("idx", "place", "r.*")


def portals(scenes: DataFrame, *, open_by_default: bool) -> DataFrame:
    """Portals of two rooms. Without a flag a portal is closed to routes of the catalogue, and open to studies."""
    p = scenes.select("idx", F.posexplode("portals").alias("place", "p")).select("idx", "place", "p.*")
    return p.withColumn("open", F.coalesce("open", F.lit(open_by_default)))


def edges(scenes: DataFrame, *, open_by_default: bool, known_rooms_only: bool) -> DataFrame:
    """idx, src, dst, portal, width of open portals between two rooms, in both directions."""
    p = portals(scenes, open_by_default=open_by_default).where("open and size(room_ids) = 2")
    if known_rooms_only:
        known = scenes.select("idx", F.transform("rooms", lambda r: r["id"]).alias("_known"))
        p = p.join(known, "idx").where(F.forall("room_ids", lambda r: F.array_contains(F.col("_known"), r))).drop("_known")
    one = p.select("idx", F.col("room_ids")[0].alias("src"), F.col("room_ids")[1].alias("dst"), F.col("id").alias("portal"), F.col("width_m").alias("width"), "place")
    return one.unionByName(one.select("idx", F.col("dst").alias("src"), F.col("src").alias("dst"), "portal", "width", "place"))


def stats(scenes: DataFrame) -> DataFrame:
    return scenes.agg(F.count("*").alias("records"), F.count_if(F.size("rooms") > 0).alias("with_rooms"), F.sum(F.size("rooms")).alias("rooms"), F.sum(F.size("portals")).alias("portals"))


#: Plausible depths of a wall and lengths of a plan (m), shares of the gross area that are net, the net share and the depth that a scale is inferred from, and the scale of nothing known.
WALLS, SPANS, NET_SHARES, NET_OF_GROSS, WALL_DEPTH, FALLBACK_SCALE = (0.08, 0.40), (3.0, 80.0), (0.2, 1.15), 0.75, 0.2, 0.05


def metric_scale(net_area, gross_area, drawn_area, wall_depth, span):
    """Metres a unit and where that comes from: net area, else gross area, else the walls' depth, else a constant.

    A scale from an area must give walls and the longer side of the drawing a
    plausible length; a net area must be a plausible part of the gross area.
    """
    drawn, wall = F.when(drawn_area > 1e-9, drawn_area), F.greatest(F.coalesce(wall_depth, F.lit(0.0)), F.lit(0.0))
    fits = lambda s: F.coalesce((wall * s).between(*WALLS) & (span * s).between(*SPANS), F.lit(False))
    share = net_area / F.when(gross_area > 0, gross_area)
    net = F.when(F.coalesce(share.between(*NET_SHARES), F.lit(False)), F.sqrt(net_area / drawn))
    gross = F.sqrt(F.when(gross_area > 0, gross_area) * NET_OF_GROSS / drawn)
    by_wall = F.lit(WALL_DEPTH) / F.when(wall > 0, wall)
    value = F.when(fits(net), net).when(fits(gross), gross).when(by_wall.isNotNull(), by_wall).otherwise(FALLBACK_SCALE)
    source = F.when(fits(net), "net_area").when(fits(gross), "gross_area_proxy").when(by_wall.isNotNull(), "wall_depth_fallback").otherwise("constant_fallback")
    return F.struct(value.alias("meters_per_unit"), source.alias("scale_source"))


#: Fields that a plan's record keeps whatever is done with it.
STATIC = ("source_index", "sample_id", "unit_type", "net_area_m2", "gross_area_m2", "meters_per_unit", "scale_source", "wall_depth_m", "height_m", "size", "corners", "rooms", "portals", "features", "surfaces")


def static_record(scenes: DataFrame, source_index=None) -> DataFrame:
    """The static part of scenes, under another source index if one is given."""
    own = scenes if source_index is None else scenes.withColumn("source_index", source_index)
    return own.select(*STATIC)


def eligible_scenes(scenes: DataFrame, profiles: DataFrame, *, index: str = "idx") -> tuple[DataFrame, DataFrame]:
    """The scenes whose profile allows them, and why the others are refused (index, filter_reasons)."""
    met = scenes.join(profiles.select(index, "eligible", "filter_reasons"), index)
    return met.where("eligible").drop("eligible", "filter_reasons"), met.where("not eligible").select(index, "filter_reasons")


def at_height(surfaces, height):
    """Surfaces of another ceiling height; what becomes thinner than 15 mm goes."""
    fitted = F.transform(surfaces, lambda s: s.withField("z_max", F.least(s["z_max"], height)).withField("z_min", F.greatest(F.lit(0.0), s["z_min"])))
    return F.filter(fitted, lambda s: s["z_max"] - s["z_min"] >= 0.015)
