"""WAVE files as rows, and back."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RMS = 0.1
SIGNAL = "struct<fs:int,samples:array<float>>"


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and [channel, sample] of PCM (16, 24, 32 bits) or float (32, 64 bits)."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, head, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            head = struct.unpack_from("<HHIIHH", data, at + 8)
            if head[0] == 0xFFFE:  # the real format stands in the extension
                head = (struct.unpack_from("<H", data, at + 32)[0], *head[1:])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if head is None or body is None:
        raise ValueError("no format or no data")
    kind, channels, fs, _, _, bits = head
    if (kind, bits) == (1, 24):
        raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / 2**23
    elif (kind, bits) in ((1, 16), (1, 32)):
        x = np.frombuffer(body, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    elif (kind, bits) in ((3, 32), (3, 64)):
        x = np.frombuffer(body, f"<f{bits // 8}").astype(np.float64)
    else:
        raise ValueError(f"format {kind} of {bits} bits")
    return fs, x[: len(x) // channels * channels].reshape(-1, channels).T


def mono(data: bytes, fs: int) -> np.ndarray:
    """One channel at a given rate, without its mean, at a fixed level; silence is an error."""
    own, x = decode(data)
    x = x.mean(0)
    if own != fs:
        x = np.interp(np.arange(round(len(x) * fs / own)) * own / fs, np.arange(len(x)), x)
    x = x - x.mean()
    level = np.sqrt((x**2).mean()) if len(x) else 0.0
    if level < 1e-12:
        raise ValueError("silent")
    return x * (RMS / level)


def encode(samples: np.ndarray, fs: int, *, floating: bool = False) -> bytes:
    """PCM of 16 bits, or floats of 32, interleaved."""
    x = np.atleast_2d(np.asarray(samples, np.float64)).T
    body = x.astype("<f4").tobytes() if floating else (np.clip(x, -1, 1) * 32767).round().astype("<i2").tobytes()
    width = 4 if floating else 2
    n = x.shape[1]
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3 if floating else 1, n, fs, fs * n * width, n * width, 8 * width) + b"data" + struct.pack("<I", len(body)) + body


def read_wav(spark: SparkSession, path: str, fs: int) -> DataFrame:
    """path and samples of each file."""

    @F.pandas_udf("array<float>")
    def samples(content):
        return content.map(lambda v: mono(v, fs).astype(np.float32))

    return spark.read.format("binaryFile").load(path).select("path", samples("content").alias("samples"))


def as_wav(samples: Column, fs: int, *, floating: bool = False) -> Column:
    """A binary column with the file of each signal."""

    @F.pandas_udf("binary")
    def of(values):
        return values.map(lambda v: None if v is None else encode(np.asarray(v), fs, floating=floating))

    return of(samples)
