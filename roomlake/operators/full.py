"""The whole solve of jobs in plans of several rooms.

A job (job_id, plan_id, source, receiver, seed) meets its plan by one join. Its rays are
dealt to tasks and their energy summed by (job, band, bin); reverberation times and
late targets are aggregates and columns over that; one task a job then adds discrete
paths, traced energy and late tail to a response. Nothing of a job but its echogram
(a few hundred rows) ever meets in one place.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlake.functions import acoustics, plan_tracer
from roomlake.functions.geometry import BANDS
from roomlake.operators import decay, reverb, solve

#: source and receiver are [x, y, z] in metres.
JOBS = "job_id long, plan_id long, source array<double>, receiver array<double>, seed long"
PATHS = "kind string, delay double, length double, bends int, gains array<double>"


def compiled(plans: DataFrame, *, height: float = 2.8) -> DataFrame:
    """plan_id, scene (JSON) of ``plans`` (plan_id, plan: JSON of rooms, openings and objects); a faulty plan has errors and no scene."""

    def run(batches):
        for pdf in batches:
            rows = []
            for plan_id, text in zip(pdf["plan_id"], pdf["plan"]):
                plan = json.loads(text)
                errors, _ = acoustics.check_plan(plan)
                rows.append((plan_id, None if errors else json.dumps(plan_tracer.compile_plan(plan, height, plan.get("objects", ()))), errors))
            yield pd.DataFrame(rows, columns=["plan_id", "scene", "errors"])

    return plans.select("plan_id", "plan").mapInPandas(run, "plan_id long, scene string, errors array<string>")


def _scene_of(text: str, known: dict) -> tuple[dict, plan_tracer.Surfaces]:
    """A plan and its surfaces; the last few of a task are kept."""
    if text not in known:
        if len(known) >= 8:
            known.clear()
        plan = json.loads(text)
        known[text] = plan, plan_tracer.Surfaces.of(plan)
    return known[text]


def paths(jobs: DataFrame, scenes: DataFrame) -> DataFrame:
    """job_id and a row for each discrete path, numbered by delay, kind and strength."""

    def run(batches):
        known: dict = {}
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                plan, scene = _scene_of(r.scene, known)
                rows += [(r.job_id, k, p["kind"], p["delay"], p["length"], p["bends"], p["gains"]) for k, p in enumerate(plan_tracer.paths(plan, scene, r.source, r.receiver))]
            yield pd.DataFrame(rows, columns=["job_id", "place", "kind", "delay", "length", "bends", "gains"])

    met = jobs.join(scenes.where("scene is not null").select("plan_id", "scene"), "plan_id").select("job_id", "scene", "source", "receiver")
    return met.mapInPandas(run, f"job_id long, place int, {PATHS}")


def trace(jobs: DataFrame, scenes: DataFrame, *, quality: str = "preview", seconds: float = 1.0) -> DataFrame:
    """job_id, band, bin, energy."""
    rays, bounces, width = solve.PRESETS[quality]
    bins = int(np.ceil(seconds * 1000 / width))

    def run(batches):
        known: dict = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                _, scene = _scene_of(r.scene, known)
                found = plan_tracer.trace(scene, r.source, r.receiver, first_ray=r.first_ray, rays=min(solve.RAYS_A_TASK, rays - r.first_ray), of_rays=rays, bounces=bounces, bin_seconds=width / 1000, bins=bins, seed=int(r.seed))
                band, at = np.nonzero(found)
                yield pd.DataFrame({"job_id": r.job_id, "band": band.astype(np.int32), "bin": at.astype(np.int32), "energy": found[band, at]})

    met = solve.dealt(jobs, rays).join(F.broadcast(scenes) if _small(scenes) else scenes, "plan_id").where("scene is not null")
    return met.select("job_id", "scene", "source", "receiver", "seed", "first_ray").mapInPandas(run, "job_id long, band int, bin int, energy double").groupBy("job_id", "band", "bin").agg(F.sum("energy").alias("energy"))


def _small(scenes: DataFrame, most: int = 10_000) -> bool:
    """Whether there are few enough plans (of some kilobytes each) to send to all tasks, which keeps the parts of rays where they were dealt."""
    return len(scenes.select("plan_id").limit(most + 1).collect()) <= most


def times(echogram: DataFrame, *, quality: str = "preview") -> DataFrame:
    """job_id, band, standard (the usual time), and target and source of the late tail."""
    width = solve.PRESETS[quality][2] / 1000
    usual = decay.schroeder_rt60(echogram, ["job_id", "band"], at="bin", energy="energy", bin_seconds=width).select("job_id", "band", F.col("rt60").alias("standard"))
    shape = decay.two_slopes(echogram, ["job_id", "band"], at="bin", energy="energy", bin_seconds=width).select("job_id", "band", "shape", "rt60", "rt60_late")
    return reverb.late_targets(usual.join(shape, ["job_id", "band"], "left")).select("job_id", "band", "standard", "target", "source")


def responses(jobs: DataFrame, found: DataFrame, echogram: DataFrame, targets: DataFrame, *, fs: int, quality: str = "preview", seconds: float = 1.0) -> DataFrame:
    """job_id, rir, rt60 (by band, of the traced field) from paths, energy and late targets."""
    width = solve.PRESETS[quality][2] / 1000
    bins = int(np.ceil(seconds / width))
    e = echogram.groupBy("job_id").agg(F.collect_list(F.struct("band", "bin", "energy")).alias("e"))
    t = targets.groupBy("job_id").agg(F.collect_list(F.struct("band", "target", "standard")).alias("t"))
    p = found.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("place", "kind", "delay", "gains"))).alias("p"))
    met = jobs.select("job_id", "seed").join(p, "job_id").join(e, "job_id", "left").join(t, "job_id", "left")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                energy, late, usual = np.zeros((len(BANDS), bins)), np.zeros(len(BANDS)), np.zeros(len(BANDS))
                for x in r.e if r.e is not None else ():
                    energy[x["band"], x["bin"]] = x["energy"]
                for x in r.t if r.t is not None else ():
                    late[x["band"]], usual[x["band"]] = x["target"], x["standard"]
                bands = plan_tracer.render(list(r.p), energy, late, fs=fs, seconds=seconds, bin_seconds=width, seed=int(r.seed))
                yield pd.DataFrame({"job_id": [r.job_id], "rir": [bands.sum(0).astype(np.float32)], "rt60": [usual]})

    return met.mapInPandas(run, "job_id long, rir array<float>, rt60 array<double>")


def simulate(jobs: DataFrame, plans: DataFrame, *, fs: int = 16000, quality: str = "preview", seconds: float = 1.0, height: float = 2.8) -> DataFrame:
    """job_id, rir, rt60 of every job whose plan is sound."""
    scenes = compiled(plans, height=height)
    echogram = trace(jobs, scenes, quality=quality, seconds=seconds)
    return responses(jobs, paths(jobs, scenes), echogram, times(echogram, quality=quality), fs=fs, quality=quality, seconds=seconds)


def channels(jobs: DataFrame, offsets: Column) -> DataFrame:
    """A job for each sensor of a receiver: ``offsets`` (array of x, y) move it; job_id becomes that of the sensor, ``of_job`` and ``channel`` say whose it is."""
    each = jobs.select("*", F.posexplode(offsets).alias("channel", "_o"))
    moved = F.array(F.element_at("receiver", 1) + F.col("_o.x"), F.element_at("receiver", 2) + F.col("_o.y"), F.element_at("receiver", 3))
    return each.withColumn("of_job", F.col("job_id")).withColumn("job_id", F.col("job_id") * 1000 + F.col("channel")).withColumn("receiver", moved).drop("_o")
