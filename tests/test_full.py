"""The solve of plans: surfaces, paths, energy and responses."""

import json

import numpy as np
import pytest

from roomlake.functions import acoustics, plan_tracer, shapes, tracer
from roomlake.operators import full


def two_rooms(is_open=True, door=True):
    box = lambda x0, x1: [[x0, 0.0], [x1, 0.0], [x1, 4.0], [x0, 4.0]]
    openings = [{"id": "d", "type": "door", "room_ids": ["a", "b"], "segment": [[4.0, 1.5], [4.0, 2.5]], "connection": "interior_room", "open": is_open, "height_m": 2.1, "sill_height_m": 0.0}] if door else []
    openings.append({"id": "w", "type": "window", "room_ids": ["a"], "segment": [[1.0, 0.0], [2.0, 0.0]], "connection": "outdoor_facade", "open": False})
    return {"outer_boundary": [[0.0, 0.0], [8.0, 0.0], [8.0, 4.0], [0.0, 4.0]], "rooms": [{"id": "a", "type": "living", "corners": box(0.0, 4.0)}, {"id": "b", "type": "bedroom", "corners": box(4.0, 8.0)}], "openings": openings}


HOW = {"first_ray": 0, "rays": 2048, "of_rays": 2048, "bounces": 30, "bin_seconds": 0.01, "bins": 60, "seed": 3}


def test_walls_leave_room_for_openings():
    plan = plan_tracer.compile_plan(two_rooms(), 2.8)
    scene = plan_tracer.Surfaces.of(plan)
    assert scene.between((1, 2, 1), (7, 2, 1)) == [] and len(scene.between((1, 2, 2.5), (7, 2, 2.5))) > 0  # the lintel
    assert len(scene.between((1, 3.5, 1), (7, 3.5, 1))) > 0
    shut = plan_tracer.compile_plan(two_rooms(False), 2.8)
    assert {shut["kinds"][k] for k in plan_tracer.Surfaces.of(shut).between((1, 2, 1), (7, 2, 1))} == {"door"}
    assert [plan["kinds"][k] for k in scene.between((1.5, 1, 1.2), (1.5, -1, 1.2))] == ["window"]


def test_first_hit_equals_all_surfaces_one_by_one():
    rng = np.random.default_rng(0)
    objects = [{"position": [x, y], "size": [0.5, 0.4, 0.8], "rotation": 30 * k} for k, (x, y) in enumerate(rng.uniform(0.5, 3.5, (12, 2)))]
    plan = plan_tracer.compile_plan(two_rooms(), 2.8, objects)
    scene = plan_tracer.Surfaces.of(plan)
    plain = plan_tracer.Surfaces(**{**scene.__dict__, "boxes": [(np.full(3, -99.0), np.full(3, 99.0), np.array([k])) for k in range(len(scene.a))]})
    at, d = np.column_stack([rng.uniform(0.2, 7.8, 500), rng.uniform(0.2, 3.8, 500), rng.uniform(0.2, 2.6, 500)]), tracer.directions(500)
    (t, what), (u, other) = scene.first(at, d), plain.first(at, d)
    assert len(scene.boxes) > 4 and np.allclose(t, u) and (what == other).mean() > 0.99


def test_single_room_equals_the_outline_tracer():
    plan = two_rooms(door=False)
    one = {"outer_boundary": plan["rooms"][0]["corners"], "rooms": plan["rooms"][:1], "openings": []}
    scene = plan_tracer.Surfaces.of(plan_tracer.compile_plan(one, 2.8))
    wall, level = (plan_tracer.KINDS["wall"][0],) * 6, lambda v: (v,) * 6
    got = plan_tracer.trace(scene, (1, 1, 1.2), (3, 3, 1.5), **HOW)
    want = tracer.trace_outline(np.array(one["outer_boundary"]), 2.8, (1, 1, 1.2), (3, 3, 1.5), [wall] * 4, level(plan_tracer.FLOOR), level(plan_tracer.CEILING), plan_tracer.SCATTERING, **HOW)
    assert np.allclose(got.sum(1) / want.sum(1), 1, atol=0.05)


def test_energy_goes_through_open_doors_only():
    energy = lambda plan, to: plan_tracer.trace(plan_tracer.Surfaces.of(plan_tracer.compile_plan(plan, 2.8)), (1, 1, 1.2), to, **HOW).sum()
    here, there = energy(two_rooms(), (3, 3, 1.5)), energy(two_rooms(), (6, 3, 1.5))
    assert 0 < there < 0.5 * here and energy(two_rooms(False), (6, 3, 1.5)) == 0


def test_paths():
    plan = plan_tracer.compile_plan(two_rooms(), 2.8)
    scene = plan_tracer.Surfaces.of(plan)
    kinds = [p["kind"] for p in plan_tracer.paths(plan, scene, (1, 0.5, 1.2), (7, 3.5, 1.2))]
    assert kinds == ["direct", "portal"] and plan_tracer.portal_paths(plan_tracer.compile_plan(two_rooms(False), 2.8), (1, 1, 1), (7, 1, 1)) == []
    way = plan_tracer.route(plan, "a", "b")
    line = plan_tracer.portal_points(plan, (1, 0.5, 1.2), (7, 3.5, 1.2), way, "a")
    assert line[0] == [1.0, 0.5, 1.2] and line[-1][:2] == [7.0, 3.5] and any(abs(x - 4) < 0.1 for x, _, _ in line)
    corner = shapes.outline("l_shape", 6, 6)
    bent = plan_tracer.bent_paths(corner, (5.5, 3, 1), (3, 5.5, 1))
    assert len(bent) == 1 and bent[0]["bends"] == 1 and plan_tracer.bent_paths(corner, (1, 1, 1), (5, 1, 1)) == []


def test_simulate(spark):
    program = acoustics.plan_from_program([("living", 4), ("bedroom", 3), ("kitchen", 2)], 9.0, 6.0, 3)
    bad = {**two_rooms(), "rooms": two_rooms()["rooms"][:1]}
    plans = spark.createDataFrame([(1, json.dumps(two_rooms())), (2, json.dumps(bad)), (3, json.dumps(program))], "plan_id long, plan string")
    jobs = spark.createDataFrame([(10, 1, [1.0, 1.0, 1.2], [3.0, 3.0, 1.5], 5), (11, 1, [1.0, 1.0, 1.2], [6.0, 3.0, 1.5], 5), (12, 2, [1.0, 1.0, 1.0], [2.0, 2.0, 1.0], 5), (13, 3, [1.0, 1.0, 1.2], [2.5, 1.5, 1.2], 5)], full.JOBS)
    scenes = full.compiled(plans).collect()
    assert {r.plan_id: r.scene is None for r in scenes} == {1: False, 2: True, 3: False} and any(r.errors for r in scenes)
    out = {r.job_id: np.array(r.rir) for r in full.simulate(jobs, plans, fs=8000, seconds=0.4).collect()}
    assert set(out) == {10, 11, 13} and all(len(x) == 3200 and np.isfinite(x).all() for x in out.values())
    assert (out[10] ** 2).sum() > (out[11] ** 2).sum() > 0
    first = round(np.linalg.norm([2, 2, 0.3]) / 343 * 8000)
    assert np.abs(out[10][first - 1 : first + 2]).max() > 0.2 and (out[10][: first - 8] ** 2).sum() < 0.01 * (out[10] ** 2).sum()
    again = {r.job_id: np.array(r.rir) for r in full.simulate(jobs.where("job_id = 11"), plans, fs=8000, seconds=0.4).collect()}
    assert np.allclose(again[11], out[11], atol=1e-6)


def test_channels(spark):
    from pyspark.sql import functions as F

    jobs = spark.createDataFrame([(4, 1, [1.0, 1.0, 1.0], [2.0, 2.0, 1.0], 0)], full.JOBS)
    got = full.channels(jobs, F.array(*[F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y")) for x in (-0.1, 0.1)])).orderBy("channel").collect()
    assert [(r.job_id, r.of_job, r.receiver) for r in got] == [(4000, 4, [1.9, 2.0, 1.0]), (4001, 4, [2.1, 2.0, 1.0])]


@pytest.mark.parametrize("n", [0, 1, 9, 100])
def test_boxes_hold_every_surface_once(n):
    low = np.random.default_rng(n).uniform(0, 9, (n, 3))
    found = plan_tracer.halved(low, low + 1)
    assert sorted(k for _, _, own in found for k in own.tolist()) == list(range(n)) and all(len(own) <= plan_tracer.IN_A_BOX for *_, own in found)


def test_measurements(spark):
    from roomlake.operators import measure

    plans = spark.createDataFrame([(1, json.dumps(two_rooms()))], "plan_id long, plan string")
    jobs = spark.createDataFrame([(1, 1, [3.4, 2.0, 1.5], [1.4, 2.0, 1.5], 5), (2, 1, [1.4, 3.5, 1.5], [1.4, 1.0, 1.5], 6)], full.JOBS)
    single = {r.job_id: r for r in measure.singles(jobs, plans, fs=16000, seconds=0.2).collect()}
    assert abs(single[1].arrival - 2 / 343) < 5e-4 and abs(single[2].arrival - 2.5 / 343) < 5e-4 and all(0.05 <= r.confidence <= 1 for r in single.values())
    ring = [(0.08 * np.cos(a), 0.08 * np.sin(a)) for a in np.radians([0, 90, 180, 270])]
    bearing = {r.job_id: r.bearing for r in measure.array_bearings(jobs, plans, ring, fs=16000, seconds=0.1).collect()}
    assert set(bearing) == {1, 2} and all(0 <= b < 360 for b in bearing.values())


def test_relative_arrivals(spark):
    from roomlake.operators import measure

    x = np.random.default_rng(3).standard_normal(2000)
    rows = [(1, c, (np.roll(x, 3 * c) * (2 if c == 1 else 1)).tolist()) for c in range(3)]
    got = {r.channel: r.delay * 1000 for r in measure.relative_arrivals(spark.createDataFrame(rows, "k int, channel int, signal array<double>"), ["k"], fs=1000.0).collect()}
    assert [round(got[c]) for c in range(3)] == [-3, 0, 3]
