"""Plan profiles over the standard tables: orders stand in for plans and their lines for rooms, doors and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomlake.functions import geometry as g
from roomlake.functions import text as t
from roomlake.operators import profiles
from roomlake.plans.metrics import rounded
from roomlake.plans.registry import query

TYPES = ("living", "bedroom", "kitchen", "bathroom", "storage", "balcony")
TYPE_SQL = "CASE l_partkey % 6 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TYPES)) + " END"
LIMIT_SQL = "lim AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in profiles.LIMITS.items()) + ") t(type, low, high, narrow))"
ROOMS_SQL = f"""{LIMIT_SQL}, r0 AS (SELECT l_orderkey AS idx, l_linenumber::VARCHAR AS room, {TYPE_SQL} AS type, CASE WHEN l_suppkey % 5 = 0 THEN '1' ELSE l_linenumber::VARCHAR END AS survivor,
l_quantity::DOUBLE * 1.5 AS area, sqrt(l_quantity::DOUBLE) / (1 + l_linenumber % 3) AS width, sqrt(l_quantity::DOUBLE) * (1 + l_linenumber % 3) AS depth, l_partkey % 70 AS corners, (l_suppkey % 17 = 0)::INT AS holes FROM lineitem),
rooms AS (SELECT r0.*, list_filter([CASE WHEN area < low OR area > high THEN 'implausible_area' END, CASE WHEN least(width, depth) < narrow THEN 'too_narrow' END, CASE WHEN corners > 64 THEN 'too_many_vertices' END,
CASE WHEN holes > 0 THEN 'interior_holes' END, CASE WHEN greatest(width, depth) / greatest(least(width, depth), 1e-9) > 10 THEN 'extreme_aspect_ratio' END], lambda x: x IS NOT NULL) AS issues FROM r0 JOIN lim USING (type))"""


def _rooms(read):
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.col("l_partkey") % 6 + 1).cast("int"))
    rows = read("lineitem").select(
        F.col("l_orderkey").alias("idx"), n.cast("string").alias("room"), kind.alias("type"), F.when(F.col("l_suppkey") % 5 == 0, "1").otherwise(n.cast("string")).alias("survivor"),
        (q * 1.5).alias("area"), (F.sqrt(q) / (1 + n % 3)).alias("width"), (F.sqrt(q) * (1 + n % 3)).alias("depth"), (F.col("l_partkey") % 70).alias("corners"), (F.col("l_suppkey") % 17 == 0).cast("int").alias("holes"),
    )
    return rows.withColumn("issues", profiles.room_issues(*[F.col(c) for c in ("type", "area", "width", "depth", "corners", "holes")]))


@query(f"WITH {ROOMS_SQL} SELECT idx, room, array_to_string(issues, ',') AS issues FROM rooms")
def room_quality_issues(read):
    return _rooms(read).select("idx", "room", F.array_join("issues", ",").alias("issues"))


@query(f"""WITH {ROOMS_SQL}, c AS (SELECT idx, count(*) AS raw, count(*) FILTER (WHERE room = survivor) AS dist, count(*) FILTER (WHERE room = survivor AND len(issues) = 0) AS sound,
bool_or(room = survivor AND len(issues) = 0 AND type = 'living') AS living, string_agg(room, ',' ORDER BY room) FILTER (WHERE room = survivor AND len(issues) = 0) AS valid FROM rooms GROUP BY idx),
i AS (SELECT idx, string_agg(issue || '=' || n, ',' ORDER BY issue) AS issue_counts FROM (SELECT idx, issue, count(*) AS n FROM (SELECT idx, unnest(issues) AS issue FROM rooms WHERE room = survivor) GROUP BY ALL) GROUP BY idx),
p AS (SELECT o_orderkey AS idx, o_orderkey % 11 <> 0 AS g, o_orderpriority = '1-URGENT' AS stairs, 1 + (o_orderkey % 7 = 0)::INT AS parts, o_orderkey % 13 = 0 AS overlapping FROM orders),
e AS (SELECT p.*, c.* EXCLUDE (idx), issue_counts, CASE WHEN g THEN list_filter([CASE WHEN stairs THEN 'stair_or_multilevel' END, CASE WHEN parts > 1 THEN 'disconnected_inner_geometry' END, CASE WHEN sound > 14 THEN 'too_many_rooms' END,
CASE WHEN NOT coalesce(living, false) THEN 'no_valid_living_room' END, CASE WHEN overlapping THEN 'overlapping_rooms' END], lambda x: x IS NOT NULL) ELSE ['invalid_graph'] END AS reasons FROM p LEFT JOIN c USING (idx) LEFT JOIN i USING (idx))
SELECT idx, len(reasons) = 0 AS eligible, array_to_string(reasons, ',') AS reasons, CASE WHEN g THEN coalesce(valid, '') ELSE '' END AS valid_rooms, CASE WHEN g THEN coalesce(raw, 0) ELSE 0 END AS raw_rooms,
CASE WHEN g THEN coalesce(dist, 0) ELSE 0 END AS distinct_rooms, CASE WHEN g THEN coalesce(raw - dist, 0) ELSE 0 END AS duplicate_rooms, CASE WHEN g THEN coalesce(dist - sound, 0) ELSE 0 END AS invalid_rooms,
CASE WHEN g THEN coalesce(issue_counts, '') ELSE '' END AS issue_counts FROM e""")
def plan_profiles(read):
    k = F.col("o_orderkey")
    plans = read("orders").select(k.alias("idx"), (k % 11 != 0).alias("has_graph"), (F.col("o_orderpriority") == "1-URGENT").alias("stairs"), (1 + (k % 7 == 0).cast("int")).alias("inner_parts"), (k % 13 == 0).alias("overlapping"), F.lit("net_area").alias("scale_source"))
    found = profiles.plan_profiles(plans, _rooms(read), "idx")
    issues = F.array_join(F.transform(F.array_sort(F.map_entries("issue_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select("idx", "eligible", F.array_join("filter_reasons", ",").alias("reasons"), F.array_join("valid_rooms", ",").alias("valid_rooms"), *[F.col(c).cast("long").alias(c) for c in ("raw_rooms", "distinct_rooms", "duplicate_rooms", "invalid_rooms")], issues.alias("issue_counts"))


def _place():
    return (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("place")


CONNECTION_SQL = "CASE l_suppkey % 5 WHEN 0 THEN 'outdoor_entry' WHEN 1 THEN 'outdoor_facade' WHEN 2 THEN 'outdoor_balcony' ELSE 'interior_room' END"


def _connection():
    k = F.col("l_suppkey") % 5
    return F.when(k == 0, "outdoor_entry").when(k == 1, "outdoor_facade").when(k == 2, "outdoor_balcony").otherwise("interior_room")


@query(f"""SELECT idx, unnest([a, b]) AS room, feature, place, type, connection FROM (SELECT l_orderkey AS idx, (l_partkey % 4)::VARCHAR AS a, (l_partkey % 4 + 1)::VARCHAR AS b, l_returnflag || l_linestatus AS feature, l_linenumber AS place,
CASE WHEN l_returnflag = 'A' THEN 'door' ELSE 'window' END AS type, {CONNECTION_SQL} AS connection FROM lineitem) WHERE connection LIKE 'outdoor%'""")
def exterior_exposures(read):
    room = F.col("l_partkey") % 4
    rows = read("lineitem").select(
        F.col("l_orderkey").alias("idx"), F.array(room.cast("string"), (room + 1).cast("string")).alias("room_ids"), F.concat("l_returnflag", "l_linestatus").alias("feature"), F.col("l_linenumber").alias("place"),
        F.when(F.col("l_returnflag") == "A", "door").otherwise("window").alias("type"), _connection().alias("connection"),
    )
    return profiles.exterior_exposures(rows, ["idx"])


@query("""WITH c AS (SELECT l_orderkey AS idx, l_linenumber % 2 AS door, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS place, l_partkey % 5 AS room, l_quantity::DOUBLE AS length FROM lineitem),
e AS (SELECT DISTINCT a, b FROM (SELECT r_regionkey AS a, (r_regionkey + 1) % 5 AS b FROM region UNION ALL SELECT (r_regionkey + 1) % 5, r_regionkey FROM region)),
p AS (SELECT x.idx, x.door, x.room AS first, y.room AS second, row_number() OVER (PARTITION BY x.idx, x.door ORDER BY (e.a IS NOT NULL) DESC, x.length + y.length DESC, x.place, y.place) AS r
FROM c x JOIN c y ON x.idx = y.idx AND x.door = y.door AND x.place < y.place LEFT JOIN e ON e.a = x.room AND e.b = y.room) SELECT idx, door, first, second FROM p WHERE r = 1""")
def best_portal_pair(read):
    rows = read("lineitem").select(F.col("l_orderkey").alias("idx"), (F.col("l_linenumber") % 2).alias("door"), _place(), (F.col("l_partkey") % 5).alias("room"), F.col("l_quantity").cast("double").alias("length"))
    a, b = F.col("r_regionkey"), (F.col("r_regionkey") + 1) % 5
    edges = read("region").select(F.inline(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))))
    return profiles.best_pairs(rows, edges, ["idx", "door"])


@query("""WITH c AS (SELECT l_orderkey AS idx, l_linenumber AS n, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS place, l_partkey % 5 AS first, l_suppkey % 5 AS second FROM lineitem), d AS (SELECT DISTINCT idx, least(first, second) AS a, greatest(first, second) AS b FROM c WHERE n = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY idx, least(first, second), greatest(first, second) ORDER BY place) AS r FROM c WHERE first <> second)
SELECT p.idx, first, second, place FROM p LEFT JOIN d ON d.idx = p.idx AND d.a = least(first, second) AND d.b = greatest(first, second) WHERE r = 1 AND d.idx IS NULL""")
def interior_openings(read):
    rows = read("lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("n"), _place(), (F.col("l_partkey") % 5).alias("first"), (F.col("l_suppkey") % 5).alias("second"))
    return profiles.unpaired(rows.drop("n"), rows.where("n = 1"), ["idx"])


@query("""WITH s AS (SELECT l_orderkey AS idx, CASE WHEN l_linestatus = 'F' THEN 'window' ELSE 'door' END AS kind, l_partkey AS room, CASE WHEN l_partkey % 3 = 0 THEN 'balcony' ELSE 'living' END AS room_type, l_discount::DOUBLE * 10 AS distance, (l_quantity - 20)::DOUBLE AS score FROM lineitem),
b AS (SELECT idx, kind, arg_max(room_type, (score, room)) FILTER (WHERE distance <= 0.5 AND score > 0) AS best FROM s GROUP BY ALL)
SELECT idx, kind, CASE WHEN best = 'balcony' THEN 'outdoor_balcony' WHEN best IS NOT NULL THEN 'interior_room' WHEN kind = 'window' THEN 'outdoor_facade' ELSE 'outdoor_or_unmatched' END AS connection FROM b""")
def connector_connection(read):
    rows = read("lineitem").select(F.col("l_orderkey").alias("idx"), F.when(F.col("l_linestatus") == "F", "window").otherwise("door").alias("kind"), F.col("l_partkey").alias("room"), F.when(F.col("l_partkey") % 3 == 0, "balcony").otherwise("living").alias("room_type"), (F.col("l_discount").cast("double") * 10).alias("distance"), (F.col("l_quantity") - 20).cast("double").alias("score"))
    return profiles.connector_connection(rows, ["idx"], proximity=F.lit(0.5))


HEIGHTS_SQL = """h AS (SELECT p_partkey, (2.0 + p_size % 5 * 0.3)::DOUBLE AS height, (p_size % 10 * 0.4 - 0.4)::DOUBLE AS sill, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 0.9 + p_size % 6 * 0.5 END::DOUBLE AS tall, (p_size % 4 * 0.7)::DOUBLE AS z_min, (2.8 - p_size % 3 * 0.9)::DOUBLE AS z_max FROM part)"""


def _heights(read):
    n = F.col("p_size")
    feature = F.struct((n % 10 * 0.4 - 0.4).alias("sill_height_m"), F.when(n % 7 != 0, 0.9 + n % 6 * 0.5).alias("height_m"))
    surface = F.struct((n % 4 * 0.7).alias("z_min"), (2.8 - n % 3 * 0.9).alias("z_max"))
    return read("part").select("p_partkey", (2.0 + n % 5 * 0.3).alias("height"), F.array(feature).alias("features"), F.array(surface).alias("surfaces"))


@query(f"WITH {HEIGHTS_SQL}, s AS (SELECT *, least(greatest(0, sill), height) AS low FROM h) SELECT p_partkey, round(low, 6) AS sill, round(least(coalesce(tall, height), greatest(0, height - low)), 6) AS tall FROM s")
def features_at_height(read):
    fitted = _heights(read).select("p_partkey", profiles.features_at_height(F.col("features"), F.col("height"))[0].alias("f"))
    return rounded(fitted.select("p_partkey", F.col("f.sill_height_m").alias("sill"), F.col("f.height_m").alias("tall")))


@query(f"""WITH {HEIGHTS_SQL}, m AS (SELECT p_partkey, least(greatest(0, CASE WHEN abs(z_min - 2.8) < 1e-6 THEN height ELSE z_min END), height) AS low, least(greatest(0, CASE WHEN abs(z_max - 2.8) < 1e-6 THEN height ELSE z_max END), height) AS high FROM h)
SELECT p_partkey, round(low, 6) AS z_min, round(high, 6) AS z_max FROM m WHERE high - low >= 0.015""")
def surfaces_at_height(read):
    return rounded(_heights(read).select("p_partkey", F.inline(profiles.surfaces_at_height(F.col("surfaces"), F.lit(2.8), F.col("height")))))


POINTS_SQL = """rooms AS (SELECT plan, room, place, x0, y0, x0 + 5 AS x1, y0 + 4 AS y1 FROM (SELECT r_regionkey AS plan, k AS place, 'room' || k AS room, (k % 2 * 4.5)::DOUBLE AS x0, (k // 2 * 3.5)::DOUBLE AS y0 FROM region, range(0, 4) t(k))),
points AS (SELECT s_nationkey % 5 AS plan, s_suppkey AS point, (s_suppkey * 7 % 110) / 10.0 + 0.03 AS x, (s_suppkey * 13 % 90) / 10.0 + 0.04 AS y FROM supplier),
met AS (SELECT p.*, room, place, x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AS inside, least(x - x0, x1 - x, y - y0, y1 - y) AS margin FROM points p JOIN rooms r ON r.plan = p.plan)"""


def _points(read):
    k = F.col("s_suppkey")
    points = read("supplier").select((F.col("s_nationkey") % 5).alias("plan"), k.alias("point"), (k * 7 % 110 / F.lit(10.0) + 0.03).alias("x"), (k * 13 % 90 / F.lit(10.0) + 0.04).alias("y"))
    rooms = read("region").select(F.col("r_regionkey").alias("plan"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"))
    x, y = F.col("place") % 2 * 4.5, F.floor(F.col("place") / 2) * 3.5
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    rooms = rooms.select("plan", "place", F.concat(F.lit("room"), F.col("place").cast("string")).alias("room"), F.array(point(x, y), point(x + 5, y), point(x + 5, y + 4), point(x, y + 4)).alias("corners"))
    return points, rooms


def _inside():
    return g.inside(F.col("x"), F.col("y"), F.col("corners"))


@query(f"WITH {POINTS_SQL} SELECT plan, point, coalesce(arg_max(room, (margin, room)) FILTER (WHERE inside), 'none') AS room FROM met GROUP BY ALL")
def room_of_motion_point(read):
    points, rooms = _points(read)
    margin = F.round(g.boundary_distance(F.col("x"), F.col("y"), F.col("corners")), 9)
    return profiles.room_of_point(points, rooms, ["plan"], "point", _inside(), margin).fillna("none", ["room"])


@query(f"WITH {POINTS_SQL} SELECT plan, point, coalesce(arg_min(room, place) FILTER (WHERE inside), 'none') AS room FROM met GROUP BY ALL")
def first_room_of_point(read):
    points, rooms = _points(read)
    return profiles.first_room_of_point(points, rooms, ["plan"], "point", _inside()).fillna("none", ["room"])


@query(f"""WITH {POINTS_SQL}, o AS (SELECT plan, point, x, y, bool_or(inside) AS held FROM met GROUP BY ALL), n AS (SELECT * FROM (VALUES (4.75, 2.0), (9.5, 5.5), (2.0, 7.4)) t(px, py)),
s AS (SELECT plan, point, arg_min([px, py], (sqrt((x - px) ** 2 + (y - py) ** 2), px)) AS p FROM o, n WHERE NOT held GROUP BY ALL)
SELECT plan, point, round(coalesce(p[1], x), 6) AS x, round(coalesce(p[2], y), 6) AS y FROM o LEFT JOIN s USING (plan, point)""")
def snapped_positions(read):
    points, rooms = _points(read)
    held = points.join(profiles.first_room_of_point(points, rooms, ["plan"], "point", _inside()), ["plan", "point"])
    at = lambda a, b: F.struct(F.lit(a).alias("px"), F.lit(b).alias("py"))
    portals = points.select("plan").distinct().select("plan", F.inline(F.array(at(4.75, 2.0), at(9.5, 5.5), at(2.0, 7.4))))
    return rounded(profiles.snapped(held, portals, ["plan"], "point").drop("room"))


@query("""WITH b AS (SELECT l_orderkey AS idx, (l_partkey % 10)::DOUBLE AS x, (l_suppkey % 10)::DOUBLE AS y, l_quantity::DOUBLE / 20 AS w, l_discount::DOUBLE * 10 AS d, l_tax::DOUBLE * 20 AS h FROM lineitem), a AS (SELECT *, 2 * (w * d + w * h + d * h) AS a FROM b)
SELECT idx, round(sum(a), 6) AS surface, round(sum(a * x) / sum(a), 6) AS x, round(sum(a * y) / sum(a), 6) AS y, round(sum(a) * 0.3, 6) AS absorbing FROM a GROUP BY idx HAVING sum(a) > 1e-12""")
def object_absorption(read):
    rows = read("lineitem").select(F.col("l_orderkey").alias("idx"), (F.col("l_partkey") % 10).cast("double").alias("x"), (F.col("l_suppkey") % 10).cast("double").alias("y"), (F.col("l_quantity").cast("double") / 20).alias("width"), (F.col("l_discount").cast("double") * 10).alias("depth"), (F.col("l_tax").cast("double") * 20).alias("height"), F.array(F.lit(0.3)).alias("absorption"))
    return rounded(profiles.object_absorption(rows, ["idx"]).withColumn("absorbing", F.col("absorbing")[0]))


@query("""WITH RECURSIVE p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id, floor(value / 20) AS x FROM events),
w AS (SELECT user_id, k, event_id, x, true AS kept, x AS last FROM p WHERE k = 1 UNION ALL SELECT p.user_id, p.k, p.event_id, p.x, abs(p.x - w.last) > 1e-6, CASE WHEN abs(p.x - w.last) > 1e-6 THEN p.x ELSE w.last END FROM w JOIN p ON p.user_id = w.user_id AND p.k = w.k + 1)
SELECT user_id, event_id, x FROM w WHERE kept""")
def points_apart(read):
    return profiles.last_kept(read("events").select("user_id", "event_id", F.floor(F.col("value") / 20).cast("double").alias("x")), ["user_id"], order="event_id", columns=["x"])


@query("""SELECT p_partkey, (p_size % 9 + 3)::DOUBLE AS width, (p_partkey % 7 + 3)::DOUBLE AS depth, (2.0 + (p_size % 4) * 0.5)::DOUBLE AS height, least(8, p_size % 12)::INT AS bedrooms, CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE 3 END AS words, 1 + least(8, p_size % 12) + 1 + 1 AS rooms FROM part""")
def plan_text_fields(read):
    n, k = F.col("p_size"), F.col("p_partkey")
    said = F.concat((n % 9 + 3).cast("string"), F.when(k % 3 == 0, " m by ").when(k % 3 == 1, "×").otherwise("米 乘 "), (k % 7 + 3).cast("string"), F.lit(" m, Height "), F.format_string("%.1f", 2.0 + n % 4 * 0.5), F.lit(" m, "), (n % 12).cast("string"), F.lit(" bedrooms"))
    rows = read("part").select(k, said.alias("t"))
    size = t.dimensions(F.col("t"))
    word = F.when(k % 2 == 0, "十二").otherwise("three")
    return rows.select("p_partkey", size["width"].alias("width"), size["depth"].alias("depth"), t.height(F.col("t")).alias("height"), t.room_count(F.col("t"), "bedroom").alias("bedrooms"), t.parse_count(word).alias("words"), F.size(t.room_program(F.col("t"))).alias("rooms"))
