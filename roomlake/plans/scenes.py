"""Graphs, geometry, acoustics and localisation over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomlake.functions import geometry as g
from roomlake.functions import text as t
from roomlake.operators import graph, localize
from roomlake.plans.metrics import rounded
from roomlake.plans.registry import query

EDGES_SQL = """e0 AS (SELECT s_nationkey % 5 AS plan, s_suppkey % 20 AS a, (s_suppkey * 3 + 1) % 20 AS b, 0.5 + s_suppkey % 4 * 0.25 AS width FROM supplier),
e1 AS (SELECT plan, a, b, width FROM e0 WHERE a <> b), edges AS (SELECT plan, src, dst, min(width) AS width FROM (SELECT plan, a AS src, b AS dst, width FROM e1 UNION ALL SELECT plan, b, a, width FROM e1) GROUP BY ALL)"""


def _edges(read):
    one = read("supplier").select((F.col("s_nationkey") % 5).alias("plan"), (F.col("s_suppkey") % 20).alias("a"), ((F.col("s_suppkey") * 3 + 1) % 20).alias("b"), (0.5 + F.col("s_suppkey") % 4 * F.lit(0.25)).alias("width"))
    return graph.both_ways(one.where("a <> b"), ["plan"], "a", "b").groupBy("plan", "src", "dst").agg(F.min("width").alias("width"))


def _starts(edges):
    return edges.groupBy("plan").agg(F.min("src").alias("start"))


WALK = """walk AS (SELECT plan, min(src) AS start, min(src) AS node, 0 AS hops, [min(src)] AS path, 0.0::DOUBLE AS cost FROM edges GROUP BY plan
UNION ALL SELECT w.plan, w.start, e.dst, w.hops + 1, list_append(w.path, e.dst), round(w.cost + {cost}, 9) FROM walk w JOIN edges e ON e.plan = w.plan AND e.src = w.node WHERE NOT list_contains(w.path, e.dst))"""


@query(f"WITH RECURSIVE {EDGES_SQL}, {WALK.format(cost='1')} SELECT plan, start, node, min(hops)::INT AS hops FROM walk GROUP BY ALL")
def reachable_closure(read):
    edges = _edges(read)
    return graph.reachable(edges, _starts(edges), ["plan"])


@query(f"WITH RECURSIVE {EDGES_SQL}, {WALK.format(cost='1')} SELECT plan, start, node, min(hops)::INT AS hops, array_to_string(arg_min(path, (hops, path)), '>') AS path FROM walk GROUP BY ALL")
def route_path(read):
    edges = _edges(read)
    return graph.hop_routes(edges, _starts(edges), ["plan"]).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(f"WITH RECURSIVE {EDGES_SQL}, {WALK.format(cost='1 + 0.05 / greatest(e.width, 0.1)')} SELECT plan, start, node, round(min(cost), 6) AS cost, array_to_string(arg_min(path, (cost, path)), '>') AS path FROM walk GROUP BY ALL")
def route_dijkstra(read):
    edges = _edges(read)
    return rounded(graph.best_routes(edges, _starts(edges), ["plan"], cost=graph.portal_cost(F.col("width"))).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">")))


@query(f"WITH RECURSIVE {EDGES_SQL}, {WALK.format(cost='1')}, n AS (SELECT plan, count(DISTINCT src) AS n_nodes FROM edges GROUP BY plan), r AS (SELECT plan, count(DISTINCT node) AS reached FROM walk GROUP BY plan) SELECT plan, n_nodes, n_nodes = reached AS connected FROM n JOIN r USING (plan)")
def plan_connected(read):
    edges = _edges(read)
    return graph.connected(edges, edges.select("plan", F.col("src").alias("node")), ["plan"])


@query("""WITH inner_ AS (SELECT n_regionkey AS plan, n_nationkey AS room, m.n_nationkey AS target, m.n_name AS target_type, 'portal' AS kind, false AS outdoor FROM nation n JOIN nation m USING (n_regionkey) WHERE m.n_nationkey > n.n_nationkey),
outer_ AS (SELECT DISTINCT n_regionkey, n_nationkey, NULL::INT, 'outdoor', c_mktsegment, true FROM nation JOIN customer ON c_nationkey = n_nationkey),
u AS (SELECT * FROM inner_ UNION ALL SELECT * FROM outer_)
SELECT plan, room, coalesce(target, -1) AS target, target_type, kind, outdoor, row_number() OVER (PARTITION BY plan, room ORDER BY outdoor DESC, target_type, target NULLS LAST, kind)::INT AS place FROM u""".replace("n_nationkey AS room", "n.n_nationkey AS room"))
def connections_union(read):
    nation = read("nation")
    a = nation.select(F.col("n_regionkey").alias("plan"), F.col("n_nationkey").alias("room"))
    portals = a.join(nation.select(F.col("n_regionkey").alias("plan"), F.col("n_nationkey").alias("target")), "plan").where("target > room").withColumn("kind", F.lit("portal"))
    rooms = nation.select(F.col("n_regionkey").alias("plan"), F.col("n_nationkey").alias("room"), F.col("n_name").alias("type"))
    exits = read("customer").select(F.col("c_nationkey").alias("room"), F.col("c_mktsegment").alias("kind")).distinct().join(rooms, "room").select("plan", "room", "kind")
    return graph.connections(portals, rooms, exits, ["plan"]).fillna(-1, ["target"])


@query("SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def memo_anti_join(read):
    return graph.not_yet_computed(read("documents").select("doc_id", "source"), read("labels"), "doc_id")


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY l_returnflag")
def filter_by_selected(read):
    selected = read("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rounded(graph.only_selected(read("lineitem"), selected, "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean_quantity")))


@query("""WITH i AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 3600 * (1 + event_id % 48) AS e FROM events),
m AS (SELECT *, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1704067200) AS reach FROM (SELECT user_id, greatest(s, 1704067200) AS s, least(e, 1706659200) AS e FROM i WHERE s <= 1706659200 AND greatest(s, 1704067200) <= least(e, 1706659200)))
SELECT user_id, reach AS gap_start, s AS gap_end FROM m WHERE s > reach UNION ALL SELECT user_id, max(e), 1706659200 FROM m GROUP BY user_id HAVING max(e) < 1706659200""")
def interval_subtract(read):
    second = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    rows = read("events").select("user_id", second.alias("s0"), (second + 3600 * (1 + F.col("event_id") % 48)).alias("e0"))
    return graph.subtract_intervals(rows, ["user_id"], start="s0", end="e0", low=F.lit(1704067200).cast("long"), high=F.lit(1706659200).cast("long"))


AIR = "[0.0001, 0.0003, 0.0006, 0.0012, 0.0025, 0.006]"


@query(f"SELECT p_partkey, [round(1.0 / greatest(p_size, 2.0) * exp(-a * p_size), 9) FOR a IN {AIR}] AS gains FROM part".replace("AS gains", "AS g").replace("SELECT p_partkey, ", "SELECT p_partkey, g[1] AS g125, g[4] AS g1000, g[6] AS g4000 FROM (SELECT p_partkey, ") + ")")
def band_propagation(read):
    gains = g.propagation(F.col("p_size").cast("double"), 2.0)
    return read("part").select("p_partkey", *[F.round(gains[k], 9).alias(n) for k, n in ((0, "g125"), (3, "g1000"), (5, "g4000"))])


@query("""SELECT p_partkey, round(0.161 * v / greatest((2 * p_size + 4 * sqrt(p_size) * 2.8) * a, 1e-9), 6) AS rt60 FROM (SELECT p_partkey, p_size, p_size * 2.8 AS v, 0.05 + (p_partkey % 10) * 0.05 AS a FROM part)""")
def sabine_rt60(read):
    size = F.col("p_size").cast("double")
    absorbing = (2 * size + 4 * F.sqrt(size) * 2.8) * (0.05 + (F.col("p_partkey") % 10) * 0.05)
    return rounded(read("part").select("p_partkey", g.sabine(size * 2.8, absorbing).alias("rt60")))


@query("""SELECT event_id, round(abs((((value * 37 - 90 + 180) % 360 + 360) % 360) - 180), 6) AS error, round(degrees(acos(greatest(-1, least(1, cos(radians(((value * 37 - 30) % 360 + 360) % 360)))))), 6) AS folded,
round(CASE WHEN abs(value / 10) <= 1.5 THEN 0.5 * (value / 10) ** 2 ELSE 1.5 * (abs(value / 10) - 0.75) END, 9) AS loss FROM events""")
def angles_fold(read):
    v = F.col("value")
    loss = F.round(g.huber(v / 10), 9).alias("loss")
    return read("events").select("event_id", F.round(g.angular_error(v * 37, F.lit(90.0)), 6).alias("error"), F.round(g.fold_to_half_plane(v * 37, F.lit(30.0)), 6).alias("folded"), loss)


@query("""WITH s AS (SELECT s_suppkey, (s_suppkey % 7 + 2)::DOUBLE AS w, (s_suppkey % 5 + 3)::DOUBLE AS h, (s_suppkey % 9)::DOUBLE AS px, (s_suppkey % 6)::DOUBLE + 0.5 AS py FROM supplier)
SELECT s_suppkey, round(w * h - 1, 6) AS area, round(2 * (w + h), 6) AS perimeter, round(w, 6) AS max_x, ((px <= w AND py <= h AND NOT (px > w - 1 AND py > h - 1)) OR (px <= w AND px >= w - 1 AND py = h - 1) OR (px = w - 1 AND py >= h - 1 AND py <= h)) AS inside FROM s""")
def polygon_hof(read):
    w, h = (F.col("s_suppkey") % 7 + 2).cast("double"), (F.col("s_suppkey") % 5 + 3).cast("double")
    x, y = (F.col("s_suppkey") % 9).cast("double"), (F.col("s_suppkey") % 6).cast("double") + 0.5
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    zero = F.lit(0.0)
    shape = F.array(point(zero, zero), point(w, zero), point(w, h - 1), point(w - 1, h - 1), point(w - 1, h), point(zero, h))
    rows = read("supplier").select("s_suppkey", shape.alias("p"), x.alias("x"), y.alias("y"))
    p = F.col("p")
    return rounded(rows.select("s_suppkey", g.polygon_area(p).alias("area"), g.polygon_perimeter(p).alias("perimeter"), g.polygon_bounds(p)["max_x"].alias("max_x"), g.inside(F.col("x"), F.col("y"), p).alias("inside")))


GRID_SQL = """nodes AS (SELECT r_regionkey AS plan, k AS node, (r_regionkey * 3 + k * 5) % 11 * 1.0 AS nx, (r_regionkey * 7 + k * 2) % 9 * 1.0 AS ny, 0.4 + 0.1 * k AS confidence, k % 3 AS hops FROM region, range(0, 5) t(k)),
grid AS (SELECT s_nationkey % 5 AS plan, s_suppkey AS point, s_suppkey % 4 AS room, (s_suppkey * 13 % 100) / 10.0 AS x, (s_suppkey * 29 % 80) / 10.0 AS y FROM supplier)"""


def _nodes(read):
    n = read("region").select(F.col("r_regionkey").alias("plan"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("node"))
    return n.select("plan", "node", ((F.col("plan") * 3 + F.col("node") * 5) % 11).cast("double").alias("node_x"), ((F.col("plan") * 7 + F.col("node") * 2) % 9).cast("double").alias("node_y"), (0.4 + 0.1 * F.col("node")).alias("confidence"), (F.col("node") % 3).alias("hops"))


def _grid(read):
    k = F.col("s_suppkey")
    return read("supplier").select((F.col("s_nationkey") % 5).alias("plan"), k.alias("point"), (k % 4).alias("room"), (k * 13 % 100 / F.lit(10.0)).alias("x"), (k * 29 % 80 / F.lit(10.0)).alias("y"))


TDOA_SQL = f"""WITH {GRID_SQL}, m AS (SELECT *, sqrt((nx - 4) ** 2 + (ny - 3) ** 2) / 343 AS arrival FROM nodes),
j AS (SELECT g.plan, g.point, g.room, g.x, g.y, arrival, sqrt((nx - x) ** 2 + (ny - y) ** 2) / 343 AS p, greatest(0.05, confidence) * 0.78 ** hops AS w FROM grid g JOIN m USING (plan)),
r AS (SELECT *, ((arrival - avg(arrival) OVER (PARTITION BY plan, point)) - (p - avg(p) OVER (PARTITION BY plan, point))) * 1e6 / 120 AS r FROM j),
tdoa AS (SELECT plan, point, any_value(room) AS room, any_value(x) AS x, any_value(y) AS y, sum(w * CASE WHEN abs(r) <= 1.5 THEN 0.5 * r * r ELSE 1.5 * (abs(r) - 0.75) END) / greatest(sum(w), 1e-9) AS loss FROM r GROUP BY plan, point)"""


def _tdoa(read):
    heard = _nodes(read).withColumn("arrival", F.hypot(F.col("node_x") - 4, F.col("node_y") - 3) / g.SPEED)
    return localize.tdoa_loss(_grid(read), heard, ["plan"], point="point")


@query(f"{TDOA_SQL} SELECT plan, point, round(loss, 6) AS loss FROM tdoa")
def localize_tdoa(read):
    return rounded(_tdoa(read))


@query(f"""WITH {GRID_SQL}, j AS (SELECT g.plan, g.point, ((degrees(atan2(3 - ny, 4 - nx)) % 360) + 360) % 360 AS bearing, ((degrees(atan2(y - ny, x - nx)) % 360) + 360) % 360 AS seen, hops, greatest(0.05, confidence) * 0.72 ** hops AS w FROM grid g JOIN nodes USING (plan)),
r AS (SELECT *, abs((((seen - bearing + 180) % 360) + 360) % 360 - 180) / (4 + 5 * hops) AS r FROM j)
SELECT plan, point, round(sum(w * CASE WHEN abs(r) <= 1.5 THEN 0.5 * r * r ELSE 1.5 * (abs(r) - 0.75) END) / greatest(sum(w), 1e-9), 6) AS loss FROM r GROUP BY plan, point""")
def localize_doa(read):
    heard = _nodes(read).withColumn("bearing", g.azimuth(4 - F.col("node_x"), 3 - F.col("node_y")))
    return rounded(localize.doa_loss(_grid(read), heard, ["plan"], point="point"))


@query(f"""{TDOA_SQL}, a AS (SELECT *, first_value(room) OVER (PARTITION BY plan ORDER BY round(loss, 9), point) AS best, min(loss) OVER (PARTITION BY plan) AS least FROM tdoa),
b AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY round(loss, 9), point) AS r, exp(-2 * (loss - least)) AS w FROM a WHERE room = best)
SELECT plan, room, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM b WHERE r <= 5 GROUP BY plan, room""")
def grid_estimate(read):
    placed = _tdoa(read).join(_grid(read), ["plan", "point"])
    return rounded(localize.grid_estimate(placed, ["plan"], point="point", room="room"))


@query("""WITH p AS (SELECT s_suppkey, (s_suppkey % 10)::DOUBLE AS sx, (s_suppkey % 7)::DOUBLE AS sy, 1.5 AS sz, (s_suppkey % 8 + 1)::DOUBLE AS rx, (s_suppkey % 6 + 2)::DOUBLE AS ry, 1.2 AS rz, s_suppkey % 4 * 0.25 AS dipole, s_suppkey % 3 / 2.0 AS occ FROM supplier),
d AS (SELECT *, sqrt((rx - sx) ** 2 + (ry - sy) ** 2 + (rz - sz) ** 2) AS d FROM p)
SELECT s_suppkey, round(d, 6) AS distance, round(d / 343.0, 9) AS delay, round(abs(1 - dipole + dipole * (rx - sx) / greatest(d, 1e-9)) / greatest(d, 0.3) * exp(-0.0012 * d) * (occ + (1 - occ) * 0.1), 6) AS gain_1000 FROM d""")
def solve_direct(read):
    k = F.col("s_suppkey")
    n = lambda e: e.cast("double")
    pairs = read("supplier").select("s_suppkey", n(k % 10).alias("sx"), n(k % 7).alias("sy"), F.lit(1.5).alias("sz"), n(k % 8 + 1).alias("rx"), n(k % 6 + 2).alias("ry"), F.lit(1.2).alias("rz"), F.lit(0.0).alias("yaw"), (k % 4 * F.lit(0.25)).alias("dipole"), (k % 3 / F.lit(2.0)).alias("occlusion"), F.array_repeat(F.lit(0.1), 6).alias("transmission"))
    return localize.direct_field(pairs).select("s_suppkey", F.round("distance", 6).alias("distance"), F.round("delay", 9).alias("delay"), F.round(F.col("gains")[3], 6).alias("gain_1000"))


@query(r"""SELECT doc_id, least(8, coalesce(TRY_CAST(nullif(regexp_extract(text, '(\d+)\s+\w+', 1), '') AS INT), 1))::INT AS rooms, CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 72 THEN substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 72) || '...' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS title FROM documents""")
def text_room_program(read):
    return read("documents").select("doc_id", t.count_of(F.col("text"), r"\w+", 1, 8).alias("rooms"), t.short_title(F.col("text")).alias("title"))


@query("SELECT p_partkey, translate(lower(trim(p_type)), '- ', '__') AS term FROM part")
def normalize_term(read):
    return read("part").select("p_partkey", t.normalized(F.col("p_type")).alias("term"))


@query("SELECT s_suppkey, substr(sha256(s_suppkey || ':' || s_nationkey || ':' || s_name), 1, 16) AS seed_hex FROM supplier")
def stable_seed_sha256(read):
    return read("supplier").select("s_suppkey", t.stable_seed_hex(F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_name")).alias("seed_hex"))
