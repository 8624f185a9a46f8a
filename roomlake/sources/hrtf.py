"""Responses of two ears by direction: rows of a Parquet table, or a SOFA file where a reader for HDF5 is installed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "measurement int, azimuth double, elevation double, left array<float>, right array<float>"


def validated(rows: DataFrame) -> DataFrame:
    """``rows`` of :data:`SCHEMA` with the unit vector of each direction; an error for responses that are empty or of unequal length."""
    bad = (F.coalesce(F.size("left"), F.lit(0)) < 1) | (F.size("left") != F.size("right"))
    checked = F.when(bad, F.raise_error(F.lit("a response needs samples, as many for both ears"))).otherwise(F.col("left"))
    a, e = F.radians("azimuth"), F.radians("elevation")
    return rows.withColumn("left", checked.cast("array<float>")).withColumn("direction", F.array(F.cos(e) * F.cos(a), F.cos(e) * F.sin(a), F.sin(e)))


def resampled(rows: DataFrame, *, fs: float, to: float) -> DataFrame:
    """Responses at another rate, by linear interpolation; levels are kept."""
    if fs == to:
        return rows

    def run(batches):
        for pdf in batches:
            for ear in ("left", "right"):
                pdf[ear] = [np.interp(np.arange(max(1, round(len(x) * to / fs))) * fs / to, np.arange(len(x)), x).astype(np.float32) * np.float32(fs / to) for x in pdf[ear]]
            yield pdf

    return rows.mapInPandas(run, rows.schema)


def read(spark: SparkSession, path: str, *, fs: float, to: float) -> DataFrame:
    """The responses of a Parquet table at the rate ``to``."""
    return resampled(validated(spark.read.schema(SCHEMA).parquet(path)), fs=fs, to=to)


def read_sofa(spark: SparkSession, path: str, *, to: float) -> DataFrame:
    """The responses of one SOFA file (measurements x 2 ears x samples); a file is read on the driver, as it is small."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading SOFA needs h5py; store the responses as Parquet and use read()") from e
    with h5py.File(path) as file:
        responses, rate, where = np.asarray(file["Data.IR"]), float(np.asarray(file["Data.SamplingRate"]).ravel()[0]), np.asarray(file["SourcePosition"])
    if responses.ndim != 3 or responses.shape[1] != 2 or len(where) != len(responses):
        raise ValueError("Data.IR must have the shape [measurement, 2, sample]")
    frame = pd.DataFrame({"measurement": np.arange(len(where), dtype=np.int32), "azimuth": where[:, 0], "elevation": where[:, 1], "left": [x.astype(np.float32) for x in responses[:, 0]], "right": [x.astype(np.float32) for x in responses[:, 1]]})
    return resampled(validated(spark.createDataFrame(frame, SCHEMA)), fs=rate, to=to)
