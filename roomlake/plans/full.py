"""The whole solve over the standard tables: a plan of two rooms, and a job for each nation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from roomlake.operators import full
from roomlake.plans.metrics import rounded
from roomlake.plans.registry import query

_ROOM = lambda x0, x1: [[x0, 0.0], [x1, 0.0], [x1, 4.0], [x0, 4.0]]
#: Two rooms of 4 by 4 m with an open door between (4, 1.5) and (4, 2.5).
PLAN = {
    "outer_boundary": _ROOM(0.0, 8.0),
    "rooms": [{"id": "a", "type": "living", "corners": _ROOM(0.0, 4.0)}, {"id": "b", "type": "bedroom", "corners": _ROOM(4.0, 8.0)}],
    "openings": [{"id": "door", "type": "door", "room_ids": ["a", "b"], "segment": [[4.0, 1.5], [4.0, 2.5]], "connection": "interior_room", "open": True, "height_m": 2.1, "sill_height_m": 0.0}],
}
JOBS_SQL = "j AS (SELECT n_nationkey AS job_id, 0.5 + n_nationkey % 6 * 0.5 AS sx, 0.5 + n_nationkey % 5 * 0.7 AS sy, 1.2 AS sz, CASE WHEN n_nationkey % 3 = 0 THEN 3.3 ELSE 5.1 + n_nationkey % 4 * 0.6 END AS rx, 3.6 - n_nationkey % 7 * 0.4 AS ry, 1.5 AS rz, n_nationkey % 3 = 0 AS same FROM nation)"


def _jobs(read):
    k = F.col("n_nationkey")
    point = lambda *v: F.array(*[x.cast("double") for x in v])
    jobs = read("nation").select(k.cast("long").alias("job_id"), F.lit(1).cast("long").alias("plan_id"), point(0.5 + k % 6 * 0.5, 0.5 + k % 5 * 0.7, F.lit(1.2)).alias("source"), point(F.when(k % 3 == 0, 3.3).otherwise(5.1 + k % 4 * 0.6), 3.6 - k % 7 * 0.4, F.lit(1.5)).alias("receiver"), (k + 7).cast("long").alias("seed"))
    return jobs, jobs.sparkSession.createDataFrame([(1, json.dumps(PLAN))], "plan_id long, plan string")


@query(f"""WITH {JOBS_SQL}, d AS (SELECT job_id, 'direct' AS kind, 0 AS bends, sqrt((sx - rx) ** 2 + (sy - ry) ** 2 + (sz - rz) ** 2) AS length FROM j),
p AS (SELECT job_id, 'portal', 1, sqrt((sx - 4) ** 2 + (sy - 2) ** 2 + (sz - 1.05) ** 2) + sqrt((rx - 4) ** 2 + (ry - 2) ** 2 + (rz - 1.05) ** 2) FROM j WHERE NOT same), a AS (SELECT * FROM d UNION ALL SELECT * FROM p)
SELECT job_id::BIGINT AS job_id, (row_number() OVER (PARTITION BY job_id ORDER BY length / 343, kind) - 1)::INT AS place, kind, bends, round(length::DOUBLE, 6) AS length, round(length::DOUBLE / 343 * 1e6, 3) AS delay_us FROM a""")
def plan_paths(read):
    """Direct paths, and those through the door between two rooms."""
    jobs, plans = _jobs(read)
    found = full.paths(jobs, full.compiled(plans))
    return found.select("job_id", "place", "kind", "bends", F.round("length", 6).alias("length"), F.round(F.col("delay") * 1e6, 3).alias("delay_us"))


@query()
def plan_responses(read):
    """Responses of all jobs: rays, late tails and paths together."""
    jobs, plans = _jobs(read)
    out = full.simulate(jobs, plans, fs=8000, seconds=0.5)
    return rounded(out.select("job_id", F.size("rir").alias("samples"), F.aggregate("rir", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("energy"), F.col("rt60")[3].alias("rt60_1000")))
