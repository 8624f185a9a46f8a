"""Sensor-array operators: the numpy kernels as grouped maps over the channels of a case.

A case is a few channels; its rows meet by one shuffle, and a kernel sees a case
at a time. Single-row kernels run in Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlake.functions import frontends
from roomlake.functions import spectral as s


def _per_case(rows: DataFrame, keys: Sequence[str], kernel, schema: str) -> DataFrame:
    head = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("channel")
        out = pd.DataFrame(kernel(pdf))
        for at, k in enumerate(keys):
            out.insert(at, k, pdf[k].iloc[0])
        return out

    return rows.groupBy(*keys).applyInPandas(run, f"{head}, {schema}")


def _stack(pdf: pd.DataFrame, column: str = "signal") -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in pdf[column]])


def delays(rows: DataFrame, keys: Sequence[str], *, fs: float, most: float | None = None) -> DataFrame:
    """Delay of each channel against the first and its confidence. ``rows``: keys, channel, signal."""

    def kernel(pdf):
        delay, confidence = s.gcc_phat(_stack(pdf), fs, most)
        return {"channel": pdf["channel"].to_numpy(), "delay": delay, "confidence": confidence}

    return _per_case(rows, keys, kernel, "channel int, delay double, confidence double")


def bearing(rows: DataFrame, keys: Sequence[str], *, fs: float, step: float = 2.0, n_fft: int = 512) -> DataFrame:
    """Direction of a source by steered power. ``rows``: keys, channel, signal, x, y."""
    search = np.arange(0, 360, step)

    def kernel(pdf):
        found, power = s.srp_phat(_stack(pdf), pdf[["x", "y"]].to_numpy(float), fs=fs, search=search, n_fft=n_fft)
        sure, second = s.spectrum_confidence(power)
        return {"bearing": [found], "confidence": [sure], "second_peak": [second]}

    return _per_case(rows, keys, kernel, "bearing double, confidence double, second_peak double")


def beamform(rows: DataFrame, keys: Sequence[str], *, kind: str, fs: float, n_fft: int = 512) -> DataFrame:
    """One output signal a case. ``rows``: keys, channel, signal, arrival, and for adaptive kinds target and noise recordings."""

    def kernel(pdf):
        x = _stack(pdf)
        vector = s.steering(pdf["arrival"].to_numpy(float), fs, n_fft)
        target = noise = None
        if kind != "ds":
            target, noise = (s.covariance(s.stft(_stack(pdf, c), n_fft)) for c in ("target", "noise"))
        return {"signal": [s.apply_weights(x, s.beamformer(kind, vector, target, noise), n_fft)]}

    return _per_case(rows, keys, kernel, "signal array<double>")


def dereverberate(rows: DataFrame, keys: Sequence[str], *, n_fft: int = 512, taps: int = 6, delay: int = 3) -> DataFrame:
    def kernel(pdf):
        return {"channel": pdf["channel"].to_numpy(), "signal": list(s.dereverberate(_stack(pdf), n_fft=n_fft, taps=taps, delay=delay))}

    return _per_case(rows, keys, kernel, "channel int, signal array<double>")


def track(rows: DataFrame, keys: Sequence[str], *, order: str, x: str, y: str) -> DataFrame:
    """Filtered positions and velocities along the order of each key's rows."""
    renamed = rows.select(*keys, F.col(order).alias("channel"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def kernel(pdf):
        at, speed = s.kalman(pdf[["x", "y"]].to_numpy(float))
        return {"channel": pdf["channel"].to_numpy(), "x": at[:, 0], "y": at[:, 1], "vx": speed[:, 0], "vy": speed[:, 1]}

    kind = renamed.schema["channel"].dataType.simpleString()
    return _per_case(renamed, keys, kernel, f"channel {kind}, x double, y double, vx double, vy double").withColumnRenamed("channel", order)


def power_spectrum(signal: Column, n_fft: int = 32) -> Column:
    """Mean power of each bin over the frames of an array column."""

    @F.pandas_udf("array<double>")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else (np.abs(s.stft(v, n_fft)[0]) ** 2).mean(0))

    return of(signal)


def through_responses(dry: Column, response: Column, gain_db: float = 0.0) -> Column:
    """A signal through an impulse response."""

    @F.pandas_udf("array<double>")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return a.combine(b, lambda x, h: None if x is None or h is None else s.convolve(x, h, gain_db)[0])

    return of(dry, response)


def aligned(estimate: Column, reference: Column, most: int) -> Column:
    """shift (samples by which the estimate is late, up to ``most``) and si_sdr once both are aligned."""

    @F.pandas_udf("shift int, si_sdr double")
    def of(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [s.align_pair(x, y, most) for x, y in zip(a, b)]
        return pd.DataFrame({"shift": [late for _, _, late in found], "si_sdr": [s.si_sdr(x, y) for x, y, _ in found]}).astype({"shift": "int32"})

    return of(estimate, reference)


def distortionless(rows: DataFrame, keys: Sequence[str], *, fs: float, n_fft: int = 512, delay: int = 3, taps: int = 5) -> DataFrame:
    """One dry signal a case by weighted power. ``rows``: keys, channel, signal, arrival."""

    def kernel(pdf):
        return {"signal": [s.power_distortionless(_stack(pdf), pdf["arrival"].to_numpy(float), fs, n_fft=n_fft, delay=delay, taps=taps)]}

    return _per_case(rows, keys, kernel, "signal array<double>")


def beamform_components(rows: DataFrame, keys: Sequence[str], components: Sequence[str], *, kind: str, fs: float, n_fft: int = 512) -> DataFrame:
    """Every component under the weights that one beamformer gets from the target and the noise: keys, component, signal.

    ``rows``: keys, channel, arrival, reliability, target, noise and the components as arrays.
    """

    def kernel(pdf):
        vector = s.steering(pdf["arrival"].to_numpy(float), fs, n_fft)
        if kind == "weighted_ds":
            weights = s.weighted_steering(vector, pdf["reliability"].to_numpy(float))
        else:
            target, noise = (s.covariance(s.stft(_stack(pdf, c), n_fft)) for c in ("target", "noise"))
            weights = s.beamformer(kind, vector, target, noise)
        return {"component": list(components), "signal": [s.apply_weights(_stack(pdf, c), weights, n_fft) for c in components]}

    return _per_case(rows, keys, kernel, "component string, signal array<double>")


def front_ends(rows: DataFrame, keys: Sequence[str], names: Sequence[str], *, fs: float, n_fft: int = 512) -> DataFrame:
    """Each front end's measures of each case: keys, pipeline, ratios before and after, and gains.

    ``rows``: keys, channel, arrival, target, noise, mixture, sensor, dry (arrays; dry is that of the first channel).
    """
    measures = ("input_snr_db", "input_si_sdr_db", "output_snr_db", "output_si_sdr_db", "output_stoi", "output_pesq", "output_dry_si_sdr_db", "output_dry_stoi", "output_dry_pesq", "gain_snr_db", "gain_si_sdr_db")

    def kernel(pdf):
        parts = {c: _stack(pdf, c) for c in ("target", "noise", "mixture", "sensor")}
        found = frontends.compare(names, parts, pdf["arrival"].to_numpy(float), np.asarray(pdf["dry"].iloc[0], float), fs, n_fft=n_fft)
        return {"pipeline": [r["pipeline"] for r in found], **{m: [r[m] for r in found] for m in measures}}

    return _per_case(rows, keys, kernel, "pipeline string, " + ", ".join(f"{m} double" for m in measures))


def coupled_decay(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rt60 of coupled rooms. ``rows``: keys, channel (room's number), volume, absorption, coupling (array, a value a room), receiver (boolean)."""

    def kernel(pdf):
        where = np.flatnonzero(pdf["receiver"].to_numpy(bool))
        return {"rt60": [s.coupled_rt60(pdf["volume"], pdf["absorption"], _stack(pdf, "coupling"), int(where[0]) if len(where) else 0)]}

    return _per_case(rows, keys, kernel, "rt60 double")
