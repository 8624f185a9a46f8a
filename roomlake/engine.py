"""One entrance to scenes, runs and batches.

    scene = Scene.create(spark, "geometry", shape="l_shape", size=(6, 4, 2.8))
    scene.run(source=(1, 1, 1.2), receiver=(4, 1, 1.5)).show()

A scene is a description on the driver; everything it runs is a DataFrame of jobs,
so a batch of any size is dealt to the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomlake.functions import acoustics, inputs, shapes, tracer
from roomlake.operators import motion, solve

JOBS = "job_id long, source array<double>, receiver array<double>, seed long"
KINDS = {"geometry": "geometry", "shape": "geometry", "floorplan": "floorplan", "plan": "floorplan", "custom": "custom"}


@dataclass(frozen=True)
class Scene:
    """An outline with a height and the absorption of its walls, floor and ceiling by band."""

    spark: SparkSession
    corners: tuple[tuple[float, float], ...]
    height: float = 2.8
    walls: tuple[tuple[float, ...], ...] = ()
    floor: tuple[float, ...] = (0.1,) * 6
    ceiling: tuple[float, ...] = (0.08,) * 6
    scattering: float = 0.12
    about: Mapping = field(default_factory=dict)

    @classmethod
    def create(cls, spark: SparkSession, kind: str = "geometry", **options) -> Scene:
        """geometry (shape, size), floorplan (scenes table, idx, room) or custom (a plan, room)."""
        if kind not in KINDS:
            raise ValueError(f"no kind of scene {kind!r}; there are {', '.join(KINDS)}")
        return {"geometry": cls._from_shape, "floorplan": cls._from_store, "custom": cls._from_plan}[KINDS[kind]](spark, **options)

    @classmethod
    def _make(cls, spark, corners, height, absorption: float = 0.06, **more) -> Scene:
        p = np.asarray(corners, float)
        if (wrong := shapes.problem(p)) is not None:
            raise ValueError(f"not an outline: {wrong}")
        p = p if shapes.signed_area(p) > 0 else p[::-1]
        return cls(spark, tuple(map(tuple, p.tolist())), float(height), tuple((float(absorption),) * 6 for _ in p), **more)

    @classmethod
    def _from_shape(cls, spark, *, shape: str = "rectangle", size: Sequence[float] = (6.0, 4.0, 2.8), **more) -> Scene:
        return cls._make(spark, shapes.outline(shape, size[0], size[1]), size[2], **more)

    @classmethod
    def _from_store(cls, spark, *, scenes: DataFrame, idx: int, room: str | None = None, **more) -> Scene:
        record = scenes.where(F.col("idx") == idx).select("rooms", "height_m").first()
        if record is None:
            raise ValueError(f"no scene {idx}")
        found = [r for r in record.rooms if room in (None, r["id"])]
        if not found:
            raise ValueError(f"no room {room!r}; there are {', '.join(r['id'] for r in record.rooms)}")
        return cls._make(spark, [list(c) for c in found[0]["corners"]], record.height_m or 2.8, about={"idx": idx, "room": found[0]["id"]}, **more)

    @classmethod
    def _from_plan(cls, spark, *, plan: Mapping, room: str | None = None, height: float = 2.8, **more) -> Scene:
        errors, _ = acoustics.check_plan(plan)
        if errors:
            raise ValueError("; ".join(errors))
        chosen = next(r for r in plan["rooms"] if room in (None, r["id"]))
        return cls._make(spark, chosen["corners"], height, about={"room": chosen["id"]}, **more)

    def _check(self, point: Sequence[float]) -> list[float]:
        p = [float(v) for v in point]
        if len(p) != 3 or not np.isfinite(p).all() or not 0 <= p[2] <= self.height or not shapes.contains(p[:2], self.corners)[0]:
            raise ValueError(f"{tuple(point)} isn't a point of the room")
        return p

    def jobs(self, pairs: Sequence, *, seed: int = 0) -> DataFrame:
        """A job for each pair of source and receiver (two points, a mapping or a Pair); its seed is its own, or the base plus its place."""
        found = [inputs.Pair.of(p, k) for k, p in enumerate(pairs)]
        return self.spark.createDataFrame([(k, self._check(p.source), self._check(p.receiver), seed + k if p.seed is None else p.seed) for k, p in enumerate(found)], JOBS)

    def trace(self, jobs: DataFrame, *, quality: str = "preview", seconds: float = 1.0) -> DataFrame:
        """job_id, band, bin, energy; the rays of a job are dealt to several tasks and summed."""
        rays, bounces, width = solve.PRESETS[quality]
        bins = int(np.ceil(seconds * 1000 / width))
        corners, height, walls, floor, ceiling, scattering = self.corners, self.height, self.walls, self.floor, self.ceiling, self.scattering

        def run(batches):
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    found = tracer.trace_outline(corners, height, r.source, r.receiver, walls, floor, ceiling, scattering, first_ray=r.first_ray, rays=min(solve.RAYS_A_TASK, rays - r.first_ray), of_rays=rays, bounces=bounces, bin_seconds=width / 1000, bins=bins, seed=int(r.seed))
                    band, at = np.nonzero(found)
                    yield pd.DataFrame({"job_id": r.job_id, "band": band.astype(np.int32), "bin": at.astype(np.int32), "energy": found[band, at]})

        return solve.dealt(jobs, rays).mapInPandas(run, "job_id long, band int, bin int, energy double").groupBy("job_id", "band", "bin").agg(F.sum("energy").alias("energy"))

    def run_batch(self, pairs, *, seed: int = 0, quality: str = "preview", fs: int = 16000, seconds: float = 1.0) -> DataFrame:
        """job_id, rir of each pair."""
        jobs = self.jobs(pairs, seed=seed)
        return solve.responses(self.trace(jobs, quality=quality, seconds=seconds), jobs, fs=fs, quality=quality, seconds=seconds)

    def run(self, source, receiver, **more) -> DataFrame:
        return self.run_batch([(source, receiver)], **more)

    def run_sources(self, sources: Mapping[str, Sequence[float]], receiver, **more) -> DataFrame:
        """source_id, rir: several sources heard at one place."""
        names = self.spark.createDataFrame(list(enumerate(sources)), "job_id long, source_id string")
        return self.run_batch([(s, receiver) for s in sources.values()], **more).join(F.broadcast(names), "job_id").drop("job_id")

    def sample_motion(self, source, receiver, *, mode: str = "approach", moving: str = "source", distance: float = 0.8, seed: int = 42) -> DataFrame:
        row = (0, [list(c) for c in self.corners], self._check(source), self._check(receiver), mode, moving, float(distance), seed)
        return motion.sample_motion(self.spark.createDataFrame([row], motion.REQUESTS))

    def run_dynamic(self, source, receiver, *, seed: int = 42, quality: str = "preview", fs: int = 16000, seconds: float = 1.0, **how) -> DataFrame:
        """frame, rir along a trajectory."""
        frames = self.sample_motion(source, receiver, seed=seed, **how)
        jobs = frames.select(F.col("frame").cast("long").alias("job_id"), "source", "receiver", F.lit(seed).cast("long").alias("seed"))
        return solve.responses(self.trace(jobs, quality=quality, seconds=seconds), jobs, fs=fs, quality=quality, seconds=seconds).withColumnRenamed("job_id", "frame")
