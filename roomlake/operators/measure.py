"""What a study measures in plans: bearings and arrivals of arrays, arrivals of single microphones, and positions from them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlake.functions import spectral
from roomlake.functions.geometry import SPEED
from roomlake.operators import arrays, full

#: The part of its peak at which a response begins.
ONSET = 0.025


def onset(rir: Column, fs: float, ratio: float = ONSET) -> Column:
    """Seconds to the first sample that reaches a part of the peak, and how far the onset stands above what comes before and after it; null for a silent response."""

    @F.pandas_udf("arrival double, confidence double")
    def of(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            x = np.abs(np.asarray(v, float))
            peak = x.max(initial=0.0)
            if peak <= 0:
                rows.append((None, None))
                continue
            at = int((x >= ratio * peak).argmax())
            near = x[at : at + max(1, round(0.004 * fs))]
            rows.append((at / fs, float(np.clip((near**2).sum() / max((x**2).sum(), 1e-20), 0.05, 1.0))))
        return pd.DataFrame(rows, columns=["arrival", "confidence"]).astype(float)

    return of(rir)


def singles(jobs: DataFrame, plans: DataFrame, *, fs: int = 16000, quality: str = "preview", seconds: float = 0.5) -> DataFrame:
    """job_id, arrival, confidence of each job's response."""
    found = full.simulate(jobs, plans, fs=fs, quality=quality, seconds=seconds)
    return found.select("job_id", onset(F.col("rir"), fs).alias("o")).select("job_id", "o.*")


def array_bearings(jobs: DataFrame, plans: DataFrame, offsets: Sequence[tuple[float, float]], *, fs: int = 16000, quality: str = "preview", seconds: float = 0.25, probe_seconds: float = 0.1, n_fft: int = 512, seed: int = 5) -> DataFrame:
    """job_id, bearing, confidence, second_peak of an array at each job's receiver that hears a probe from its source."""
    sensors = full.channels(jobs, F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in offsets]))
    heard = full.simulate(sensors.select(*jobs.columns), plans, fs=fs, quality=quality, seconds=seconds)
    probe = F.lit(spectral.probe(fs, probe_seconds, seed).tolist())
    place = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in offsets])
    rows = heard.join(sensors.select("job_id", "of_job", "channel"), "job_id").select(
        F.col("of_job").alias("case"), F.col("channel").cast("int").alias("channel"), arrays.through_responses(probe, F.col("rir").cast("array<double>")).alias("signal"), F.element_at(place, F.col("channel") + 1).alias("p"),
    )
    return arrays.bearing(rows.select("case", "channel", "signal", "p.x", "p.y"), ["case"], fs=float(fs), n_fft=n_fft).withColumnRenamed("case", "job_id")


def relative_arrivals(rows: DataFrame, keys: Sequence[str], *, fs: float, most: float = 0.2) -> DataFrame:
    """keys, channel, delay, confidence against the loudest channel. ``rows``: keys, channel, signal."""

    def kernel(pdf):
        x = np.stack([np.asarray(s, float) for s in pdf["signal"]])
        best = int((x**2).mean(1).argmax())
        order = np.argsort(np.arange(len(x)) != best, kind="stable")
        delay, sure = spectral.gcc_phat(x[order], fs, most)
        back = np.argsort(order)
        return {"channel": pdf["channel"].to_numpy(), "delay": delay[back], "confidence": sure[back]}

    return arrays._per_case(rows, keys, kernel, "channel int, delay double, confidence double")


def straight_arrival(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Seconds over the straight line between two points of a level."""
    return F.hypot(ax - bx, ay - by) / SPEED
