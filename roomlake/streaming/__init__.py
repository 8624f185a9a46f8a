"""Structured Streaming forms of the ordered operators; each takes a stream or a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlake.functions import spectral


def tumbling(events: DataFrame, *, time: str, width: str, keys: list[str], late: str = "1 hour", value: str = "value") -> DataFrame:
    """Count and mean of each key and window; rows later than ``late`` are dropped on a stream."""
    w = F.window(time, width)
    grouped = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), *keys, "n", "mean")


def sessions(events: DataFrame, *, time: str, gap: str, keys: list[str], late: str = "1 hour", value: str = "value") -> DataFrame:
    """Runs of events with no pause longer than ``gap``."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def track(observed: DataFrame, *, key: str, order: str, x: str, y: str) -> DataFrame:
    """The filter of :func:`roomlake.operators.arrays.track` with its state kept between micro-batches.

    The state of a key is its past observations' sufficient part: position,
    velocity and covariance. Rows must come in order across batches.
    """
    rows = observed.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("at"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def update(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("at")
        known = np.array(state.get[0]).reshape(5, 4) if state.exists else None
        found, left = spectral.kalman_step(pdf[["x", "y"]].to_numpy(float), known)
        state.update((left.ravel().tolist(),))
        yield pd.DataFrame({"key": k[0], "at": pdf["at"].to_numpy(), "x": found[:, 0], "y": found[:, 1], "vx": found[:, 2], "vy": found[:, 3]})

    return rows.groupBy("key").applyInPandasWithState(update, "key long, at long, x double, y double, vx double, vy double", "s array<double>", "append", "NoTimeout")
