"""Catalogue, sources, batch and streaming operators on small tables."""

import base64
import io
import json
import sqlite3
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roomlake import engine, streaming
from roomlake.functions import acoustics, geometry, shapes, text
from roomlake.operators import agg, arrays, graph, materials, motion, placement, ranking, selection, solve
from roomlake.sources import audio, exports, scenes, sqlite, tables
from roomlake.storage import Workspace, shared_dir

ROOMS = [{"id": "a", "type": "living", "area_m2": 20.0, "corners": [[0, 0], [5, 0], [5, 4], [0, 4]]}, {"id": "b", "type": "bed", "area_m2": 12.0, "corners": [[5, 0], [8, 0], [8, 4], [5, 4]]}]
PORTALS = [{"id": "p", "type": "door", "room_ids": ["a", "b"], "width_m": 0.9, "open": True}, {"id": "q", "type": "door", "room_ids": ["a", "x"], "width_m": 0.9}]


@pytest.fixture
def packed(tmp_path):
    path = tmp_path / "scenes.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE scenes(idx INTEGER PRIMARY KEY, source_idx INTEGER UNIQUE, payload BLOB)")
        for k in range(7):
            record = {"source_index": 10 * k, "height_m": 2.8, "rooms": ROOMS if k else [], "portals": PORTALS if k else [], "surfaces": [{"a": [0, 0], "b": [5, 0], "type": "wall", "z_min": 2.5, "z_max": 2.8, "name": "w", "room_id": "a"}]}
            db.execute("INSERT INTO scenes VALUES (?, ?, ?)", (k, 10 * k, zlib.compress(json.dumps(record).encode())))
    return str(path)


def test_packed_scenes(spark, packed, tmp_path, monkeypatch):
    monkeypatch.setattr(sqlite, "ROWS_A_RANGE", 3)
    read = scenes.read_packed(spark, packed)
    some = scenes.read_packed(spark, packed, idx=(2, 4))
    assert sorted(r.idx for r in some.select("idx").collect()) == [2, 3, 4] and some.rdd.getNumPartitions() == 1
    assert read.count() == 7 and {r.idx for r in read.select("idx").collect()} == set(range(7))
    assert scenes.rooms(read).count() == 12
    scenes.store(read.where("idx <> 3"), f"{tmp_path}/out")
    stored = spark.read.parquet(f"{tmp_path}/out")
    assert [(r.idx, r.source_index) for r in stored.select("idx", "source_index").orderBy("idx").collect()] == [(k, 10 * (k + (k >= 3))) for k in range(6)]
    assert scenes.record(stored, 2).first().source_index == 20
    strict, loose = scenes.edges(read, open_by_default=False, known_rooms_only=False), scenes.edges(read, open_by_default=True, known_rooms_only=True)
    assert strict.count() == 12 and loose.count() == 12 and scenes.edges(read, open_by_default=True, known_rooms_only=False).count() == 24
    low = read.select(F.size(scenes.at_height(F.col("surfaces"), F.lit(2.51))).alias("n")).first().n
    assert low == 0 and scenes.stats(read).first().with_rooms == 6
    with pytest.raises(Exception, match="no table"):
        sqlite.read_table(spark, packed, "missing").count()


def test_routes_and_connectivity(spark):
    e = spark.createDataFrame([(1, "a", "b", 0.9), (1, "b", "c", None), (1, "a", "c", 0.05), (2, "a", "b", 0.9)], "plan int, a string, b string, width double")
    both = graph.both_ways(e, ["plan"], "a", "b")
    starts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "z")], "plan int, start string")
    hops = {(r.plan, r.node): (r.hops, list(r.path)) for r in graph.hop_routes(both, starts, ["plan"], rounds=4).collect()}
    assert hops == {(1, "a"): (0, ["a"]), (1, "b"): (1, ["a", "b"]), (1, "c"): (1, ["a", "c"]), (2, "a"): (0, ["a"]), (2, "b"): (1, ["a", "b"]), (3, "z"): (0, ["z"])}
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "d")], "plan int, node string")
    assert {r.plan: r.connected for r in graph.connected(both, nodes, ["plan"], rounds=4).collect()} == {1: True, 2: False}


def test_scale_and_text(spark):
    values = [(50.0, 55.0, 5000.0, 2.0, 80.0), (5e6, 55.0, 5000.0, 2.0, 80.0), (50.0, 55.0, 5000.0, 9.0, 80.0), (None, None, 5000.0, 2.0, 80.0), (None, None, None, None, None)]
    rows = spark.createDataFrame(values, "net double, gross double, drawn double, wall double, span double")
    got = [tuple(r.s) for r in rows.select(scenes.metric_scale(*[F.col(c) for c in ("net", "gross", "drawn", "wall", "span")]).alias("s")).collect()]
    assert got[0] == (0.1, "net_area") and got[1][1] == "gross_area_proxy" and [g[1] for g in got[2:]] == ["wall_depth_fallback", "wall_depth_fallback", "constant_fallback"]
    assert got[3][0] == 0.1 and got[4][0] == 0.05
    words = spark.createDataFrame([("3",), ("Two",), ("三",), ("many",), ("九",), ("十",), ("十二",), ("二十三",), ("ten",), ("zero",), ("零",)], "w string")
    assert [r.n for r in words.select(text.parse_count(F.col("w")).alias("n")).collect()] == [3, 2, 3, 1, 9, 10, 12, 23, 10, 0, 0]
    d = spark.createDataFrame([("a room 4 m x 5.5 m",), ("4×3",), ("none",), ("length 8 m, width 6",), ("宽5米",), ("7 BY 6, height 3.1m",)], "t string").select(text.dimensions(F.col("t")).alias("d"), text.height(F.col("t")).alias("h")).collect()
    assert [tuple(r.d) for r in d] == [(4.0, 5.5), (4.0, 3.0), (None, None), (8.0, 6.0), (None, 5.0), (7.0, 6.0)] and d[5].h == 3.1
    program = spark.createDataFrame([("a flat with three bedrooms, 2 baths and a balcony; 1 balcony",), ("两室一厅",), ("0 living rooms, 0 kitchens, 0 bedrooms, 0 bathrooms",)], "t string").select(F.expr("1"), text.room_program(F.col("t")).alias("p")).collect()
    assert [[r["id"] for r in row.p] for row in program][0] == ["living_0", "kitchen_0", "bedroom_0", "bedroom_1", "bedroom_2", "bathroom_0", "bathroom_1", "balcony_0"]
    assert sum(r["type"] == "bedroom" for r in program[1].p) == 2 and [r["id"] for r in program[2].p] == ["living_0"]
    sides = spark.createDataFrame([(None,), (12.34567,)], "w double").select(text.side(F.col("w"), 10.0).alias("s"), text.ceiling(F.lit(None).cast("double")).alias("h")).collect()
    assert [(r.s, r.h) for r in sides] == [(10.0, 2.8), (12.3457, 2.8)]
    with pytest.raises(Exception, match="between 3 and 40"):
        spark.range(1).select(text.side(F.lit(2.0), 10.0)).collect()
    s = spark.createDataFrame([("ab",)], "t string").select(text.label_seed(F.col("t")).alias("s"), text.metric_text(F.lit(None).cast("double")).alias("m")).first()
    assert (s.s, s.m) == (1 * 97 + 2 * 98, "n/a")


def test_geometry_columns_equal_kernels(spark):
    shapes_ = ["rectangle", "l_shape", "u_shape", "circle"]
    rows = spark.createDataFrame([(s, 6.0, 4.0) for s in shapes_], "shape string, w double, d double").withColumn("c", shapes.outline_of(F.col("shape"), F.col("w"), F.col("d")))
    poly = F.transform("c", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    got = rows.select("shape", geometry.polygon_area(poly).alias("a"), geometry.inside(F.lit(3.0), F.lit(3.5), poly).alias("i"), geometry.is_rectangle(poly).alias("r"), shapes.problem_of(F.col("c")).alias("p")).collect()
    for r in got:
        o = shapes.outline(r.shape, 6, 4)
        assert np.isclose(r.a, shapes.signed_area(o)) and r.i == bool(shapes.contains((3.0, 3.5), o)[0]) and r.r == (r.shape == "rectangle") and r.p is None


def test_materials(spark):
    mappings = spark.createDataFrame([("wall", "plaster", 1, ["reflective", "semi_reflective"], True), ("wall", "panel", 2, ["absorptive"], False), ("sofa", "textile", 1, ["absorptive"], False)], "semantic string, family string, priority int, allowed array<string>, is_default boolean")
    stock = spark.createDataFrame(
        [(1, "plaster", "reflective", None, True, "t"), (2, "plaster", "semi_reflective", None, None, None), (3, "panel", "absorptive", None, True, None), (4, "panel", "absorptive", None, False, None), (5, "textile", "absorptive", "equivalent_area", True, None)],
        "material_idx int, family string, level string, kind string, selectable boolean, tag string",
    )
    requests = spark.createDataFrame([(1, "wall", "auto"), (2, "wall", "highly_absorptive"), (3, "wall", "reflective"), (4, "sofa", "absorptive"), (5, "moon", "auto")], "request_id long, semantic string, asked string")
    got = {r.request_id: r for r in materials.draw(requests, mappings, stock, {"wall": ["t"]}, seed=3).collect()}
    assert got[1].family == "plaster" and (got[2].material_idx, got[2].fallback_from) == (3, "highly_absorptive") and got[3].material_idx == 1
    assert got[4].material_idx is None and got[4].fallback_alpha == 0.55 and got[5].fallback_alpha == 0.20
    c = {r.semantic: r for r in materials.catalog(mappings, stock).collect()}
    assert c["wall"].classes == ["absorptive", "reflective", "semi_reflective"] and c["wall"].default_family == "plaster" and c["sofa"].classes is None
    a = spark.createDataFrame([([0.0, 0.0, x, x, x, 0.0],) for x in (0.05, 0.1, 0.3, 0.9)], "a array<double>")
    assert [r.k for r in a.select(materials.absorption_class(F.col("a")).alias("k")).collect()] == list(materials.CLASSES)


def test_placement_and_motion(spark):
    u = shapes.outline("u_shape", 6, 4).tolist()
    jobs = spark.createDataFrame([(k, k, u, u, True) for k in range(5)], "job_id long, seed long, source_corners array<array<double>>, receiver_corners array<array<double>>, same_room boolean")
    first, again = (placement.sample_placements(jobs).orderBy("job_id").collect() for _ in range(2))
    assert first == again and all(np.hypot(r.source[0] - r.receiver[0], r.source[1] - r.receiver[1]) >= 1 for r in first)
    rooms = spark.createDataFrame([(1, "a", "bedroom", u)], "idx long, room string, type string, corners array<array<double>>")
    points = placement.grids(rooms, spacing=0.5, margin=0.3)
    far = placement.farthest_points(points, ["idx", "room"], count=4).collect()
    assert len(far) == 4 and len({(r.x, r.y) for r in far}) == 4
    items = placement.furnish(rooms, {"bedroom": [("bed", 2.0, 1.6), ("desk", 1.2, 0.6), ("ship", 9.0, 9.0)]}).collect()
    assert [r.placed for r in items] == [True, True, False]
    requests = spark.createDataFrame([(1, u, [1.0, 3.5, 1.5], [5.0, 3.5, 1.2], "approach", "source", 2.0, 5)], motion.REQUESTS)
    frames = motion.sample_motion(requests).orderBy("frame").collect()
    n = requests.select(motion.frame_count(F.lit(2.0)).alias("n")).first().n
    assert len(frames) == n and frames[0].source == [1.0, 3.5, 1.5] and frames[-1].phase == 1.0


@pytest.mark.parametrize("small", [True, False])
def test_candidates_once_and_in_blocks(spark, monkeypatch, small):
    """Materials and wishes that share several terms, repeated rows, nulls, and a term of all; the pairs themselves are never shuffled."""
    if small:
        for name, n in {"REQUESTS_A_ROW": 3, "BLOCK": 5, "PAIRS_A_TASK": 50}.items():
            monkeypatch.setattr(materials, name, n)
    stock = [(k, "All", f"n{k % 4}", [f"A{k % 3}", None, "all"] if k % 5 else None) for k in range(40)] + [(3, "extra", None, None), (3, "all", "n3", ["a0"]), (None, "all", None, [])]
    wishes = [(k, ["all", f"n{k % 4}", f"a{k % 6}"] if k % 3 else [f"a{k % 6}", None]) for k in range(30)] + [(30, ["none"]), (31, []), (32, None), (4, ["extra"]), (None, ["n1"])]
    rows = spark.createDataFrame(stock, "material_idx int, a string, b string, c array<string>")
    got = materials.candidates(rows, spark.createDataFrame(wishes, "request_id long, terms array<string>"), ["a", "b"], "c")
    names = lambda a, b, c: {x.lower() for x in (a, b, *(c or [])) if x is not None}
    wanted = {(q, m) for q, terms in wishes for m, *of in stock if names(*of) & set(terms or [])}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(wanted) and set(found) == wanted and got.columns == ["request_id", "material_idx"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange") > plan.index("ShuffledHashJoin") and "Exchange" not in plan[: plan.index("ShuffledHashJoin")]


def test_batch(spark):
    jobs = spark.createDataFrame([(1, 2), (2, 0), (3, 4)], "job_id long, x int")
    got = {r.job_id: r for r in solve.run_jobs(jobs, lambda j: {"y": 8 // j["x"]}, on_error="skip").collect()}
    assert json.loads(got[1].result) == {"y": 4} and got[2].error.startswith("ZeroDivisionError") and got[3].error is None
    with pytest.raises(Exception, match="job 2"):
        solve.run_jobs(jobs, lambda j: {"y": 8 // j["x"]}).collect()
    seeded = solve.with_seeds(spark.createDataFrame([(0, None), (1, 7), (2, None)], "job_id long, seed long"), 100, "job_id")
    assert [r.seed for r in seeded.orderBy("job_id").collect()] == [100, 7, 102]
    stored = spark.createDataFrame([(1, 9)], "job_id long, y int")
    assert {tuple(r) for r in solve.solve_missing(jobs, stored, lambda j: j.select("job_id", F.lit(0).alias("y")), "job_id").collect()} == {(1, 9), (2, 0), (3, 0)}


def test_tables(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2, "y")], "k int, b string")
    tables.write_csv([a, b], f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["k", "a", "b"]
    tables.append_checkpoint(a, f"{tmp_path}/ck", "s1")
    tables.append_checkpoint(a, f"{tmp_path}/ck", "s1")
    done, todo = tables.resume(spark.createDataFrame([(1,), (2,)], "k int"), spark.read.parquet(f"{tmp_path}/ck"), "s1", "k")
    assert done.count() == 1 and [r.k for r in todo.collect()] == [2]
    (tmp_path / "files").mkdir()
    (tmp_path / "files/f.wav").write_bytes(audio.encode(np.ones(100) * 0.5 * np.sign(np.sin(np.arange(100))), 8000))
    good = spark.read.format("binaryFile").load(f"{tmp_path}/files").select(F.lit("f.wav").alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    manifest = good.unionByName(spark.createDataFrame([("none", 1, "x")], "name string, bytes long, sha256 string"))
    assert {r.name: r.problem for r in tables.verify_files(spark, manifest, f"{tmp_path}/files").collect()} == {"f.wav": None, "none": "missing"}
    assert len(audio.read_wav(spark, f"{tmp_path}/files/f.wav", 8000).first().samples) == 100


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k % 3, k, float(k), 2.0 * k) for k in range(30)]
    df = spark.createDataFrame(rows, "u long, at long, x double, y double")
    for k in range(3):
        df.where((F.col("at") >= 10 * k) & (F.col("at") < 10 * k + 10)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    query = streaming.track(stream, key="u", order="at", x="x", y="y").writeStream.format("memory").queryName("tracked").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.key, r.at): r.x for r in spark.table("tracked").collect()}
    want = {(r.u, r.at): r.x for r in arrays.track(df, ["u"], order="at", x="x", y="y").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_selection_and_bootstrap(spark):
    rows = spark.createDataFrame([(1, k, float(k % 4)) for k in range(40)], "g int, c int, v double")
    r = agg.bootstrap_cluster_ci(rows, ["g"], cluster="c", value="v", iterations=300).first()
    assert r.ci_low < 1.5 < r.ci_high
    nothing = rows.limit(0)
    assert agg.bootstrap_cluster_ci(nothing, ["g"], cluster="c", value="v", iterations=3).count() == 0
    assert selection.preferred_or_all(rows, ["g"], F.col("v") == 9).count() == 40 and selection.preferred_or_all(rows, ["g"], F.col("v") == 3).count() == 10


def test_motion_is_dealt_and_looks_lines_up_together(spark, monkeypatch):
    """Requests of one partition go to several tasks, and a random way asks for all its lines in a few calls."""
    monkeypatch.setattr(motion, "JOBS_A_TASK", 4)
    monkeypatch.setattr(placement, "JOBS_A_TASK", 4)
    u = shapes.outline("u_shape", 6, 4).tolist()
    jobs = spark.createDataFrame([(k, k, u, u, True) for k in range(20)], "job_id long, seed long, source_corners array<array<double>>, receiver_corners array<array<double>>, same_room boolean").coalesce(1)
    placed = placement.sample_placements(jobs)
    requests = placed.select("job_id", F.lit(str(u)).alias("c"), "source", "receiver", F.lit("random").alias("mode"), F.lit("source").alias("moving"), F.lit(1.5).alias("distance"), F.col("job_id").alias("seed")).withColumn("corners", F.from_json("c", "array<array<double>>")).drop("c").coalesce(1)
    frames = motion.sample_motion(requests)
    assert placed.rdd.getNumPartitions() == frames.rdd.getNumPartitions() == 6 and frames.select("job_id").distinct().count() == 20
    calls, contains = [], shapes.contains
    monkeypatch.setattr(shapes, "contains", lambda *a: calls.append(1) or contains(*a))
    way, far = motion._random_route(np.array([0.8, 3.5]), np.array(u), 4.0, 0.15, 7)
    assert far == 4.0 and shapes.contains(shapes.along(way, np.linspace(0, far, 50)), u).all() and len(calls) < 40
    both = shapes.shortest_paths((0.8, 3.5), [(5.2, 3.5), (0.8, 0.5), (9, 9)], u)
    assert [len(w) for w in both] == [4, 2, 2] and both[0][1:3].tolist() == [u[5], u[4]] and shapes.shortest_paths((1, 1), np.zeros((0, 2)), u) == []


def test_bootstrap_sends_no_draws(spark):
    """What Spark may send to all tasks are the clusters: the draws, ``iterations`` times as many, look as small to it."""
    data = [(g, c, float((c * 7 + k) % 11)) for g in ("a", "b") for c in range(0, 60, 2 if g == "a" else 3) for k in range(1 + c % 3)]
    rows = spark.createDataFrame([*data, (None, 1, 5.0)], "g string, c int, v double")
    got = agg.bootstrap_cluster_ci(rows, ["g"], cluster="c", value="v", iterations=50)
    assert "BuildLeft" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        sums = [[v for h, d, v in data if (h, d) == (r.g, c)] for c in sorted({d for h, d, _ in data if h == r.g})]
        means = []
        for b in range(1, 51):
            drawn = [x for k in range(len(sums)) for x in sums[(b * 1000003 + k) * 2654435761 % 2147483647 % len(sums)]]
            means.append(sum(drawn) / len(drawn))
        assert [r.ci_low, r.ci_high] == pytest.approx(np.quantile(means, [0.025, 0.975]).tolist())
    assert {r.g for r in got.collect()} == {"a", "b"}


def test_workspace(spark):
    space = Workspace(spark, "t")
    kept = space.save(spark.range(5), "a")
    assert kept.count() == 5 and space.root.startswith(shared_dir(spark))
    space.drop("a")
    with pytest.raises(Exception):
        space.spark.read.parquet(space.path("a")).count()


def test_engine(spark, packed):
    plan = acoustics.plan_from_program([("living", 4), ("bed", 2)], 7, 5, 1)
    scene = engine.Scene.create(spark, "geometry", shape="l_shape", size=(6, 4, 2.8), absorption=0.3)
    got = scene.run_sources({"a": (1, 1, 1.2), "b": (1, 3, 1.2)}, (4, 1, 1.5), seconds=0.2).collect()
    assert {r.source_id for r in got} == {"a", "b"} and all(len(r.rir) == 3200 and np.isfinite(r.rir).all() and max(r.rir) > 0 for r in got)
    assert scene.run_dynamic((1, 1, 1.2), (4, 1, 1.5), mode="recede", distance=0.4, seconds=0.1).count() >= 3
    assert engine.Scene.create(spark, "custom", plan=plan).about["room"] == "living_0"
    assert engine.Scene.create(spark, "floorplan", scenes=scenes.read_packed(spark, packed), idx=2, room="b").corners[0] == (5.0, 0.0)
    for wrong in (lambda: scene.run((9, 9, 1), (4, 1, 1.5)), lambda: engine.Scene.create(spark, "moon"), lambda: engine.Scene.create(spark, "floorplan", scenes=scenes.read_packed(spark, packed), idx=99)):
        with pytest.raises(ValueError):
            wrong()


def test_places_are_exact(spark):
    rng = np.random.default_rng(3)
    data = [(int(k % 7 > 3), k, None if k % 11 == 0 else float(rng.integers(0, 20))) for k in range(500)]
    got = ranking.with_place(spark.createDataFrame(data, "g int, i int, v double"), ["g"], value="v", index="i", ranges=8).collect()
    for g in (0, 1):
        own = sorted((r for r in data if r[0] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        assert {r.i: (r["_at"], r["_c"]) for r in got if r.g == g} == {r[1]: (k, len(own)) for k, r in enumerate(own)}


def test_percentiles_round_as_sql(spark):
    """Between equal values the last bit tells whether they are below the percentile."""
    rng = np.random.default_rng(2)
    data = [(g, float(v)) for g in range(300) for v in np.round(rng.uniform(-2100, 2100, 1 + g % 3), 2).repeat(rng.integers(1, 15))]
    data += [(300, float("inf")), (300, float("inf")), (301, 1e308), (301, -1e308)]
    parts = {"a": 1 / 3, "b": 2 / 3, "c": 0.1, "d": 0.5}
    found = ranking.percentiles(spark.createDataFrame([*data, (302, None)], "g int, v double"), ["g"], {n: (F.col("v"), p) for n, p in parts.items()}).collect()
    con = duckdb.connect()
    con.register("t", pa.table({"g": [g for g, _ in data], "v": [v for _, v in data]}))
    wanted = con.sql(f"SELECT g, {', '.join(f'quantile_cont(v, {p!r}::DOUBLE)' for p in parts.values())} FROM t GROUP BY g").fetchall()
    assert {tuple(r) for r in found if r.g < 302} == set(wanted) and not any(r.g == 302 and r.a is not None for r in found)


def test_exports(spark):
    rows = spark.createDataFrame([(1, [0.0, -3.0, 1.0, 2.0, 2.0], 0.5), (2, [], 0.1)], "k int, rir array<double>, rt60 double")
    got = rows.select("k", exports.preview(F.col("rir"), 2).alias("p"), exports.as_npy(F.col("rir")).alias("n"), exports.rir_payload(8000, F.col("rir"), F.col("rt60")).alias("j")).orderBy("k").collect()
    assert got[0].p == [-3.0, 2.0] and np.load(io.BytesIO(got[0].n)).tolist() == [0.0, -3.0, 1.0, 2.0, 2.0] and got[1].p == []
    doc = json.loads(got[0].j)
    assert np.frombuffer(base64.b64decode(doc["float32"]), "<f4").tolist() == [0.0, -3.0, 1.0, 2.0, 2.0] and doc["rt60"] == 0.5
    cases = spark.createDataFrame([("pass", 1.0), ("skip", 0.5)], "status string, seconds double")
    s = exports.status_summary(cases).first()
    assert (s.cases, s.skip, s.required_passed, s.seconds) == (2, 1, True, 1.5)
    assert exports.markdown(cases).splitlines()[2] == "| pass | 1.000 |" and exports.keep_latest(cases, time="seconds", n=1).first().status == "pass"
    frames = spark.createDataFrame([(1, k, "a" if k < 3 else "b") for k in range(6)], "j int, f int, room string")
    assert exports.first_changes(frames, ["j"], order="f", value="room").first().first_change == 3
