"""Results as files and documents: arrays, JSON payloads and reports."""

from __future__ import annotations

import io
import json
from collections.abc import Mapping
from html import escape

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREVIEW_POINTS = 48_000


def as_npy(samples: Column) -> Column:
    """A binary column of NPY files of 32-bit floats."""

    @F.pandas_udf("binary")
    def of(values):
        def one(v):
            out = io.BytesIO()
            np.save(out, np.asarray(v, np.float32))
            return out.getvalue()

        return values.map(lambda v: None if v is None else one(v))

    return of(samples)


def float32_base64(samples: Column) -> Column:
    """All samples, exactly, as text."""

    @F.pandas_udf("binary")
    def of(values):
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return F.base64(of(samples))


def preview(samples: Column, points: int = PREVIEW_POINTS) -> Column:
    """At most ``points`` samples: of each stretch the one of the largest magnitude, the first of equal ones."""
    stride = F.greatest(F.lit(1), F.ceil(F.size(samples) / points).cast("int"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(samples) - 1) / stride).cast("int"))

    def loudest(k):
        part = F.slice(samples, k * stride + 1, stride)
        return F.element_at(part, F.array_position(F.transform(part, lambda x: F.abs(x)), F.array_max(F.transform(part, lambda x: F.abs(x)))).cast("int"))

    return F.when(F.size(samples) > 0, F.transform(blocks, loudest)).otherwise(samples)


def rir_payload(fs: int, rir: Column, rt60: Column, *, exact: bool = True) -> Column:
    """A JSON document of a response: preview, reverberation and, if asked for, all samples."""
    parts = [F.lit(fs).alias("fs"), F.size(rir).alias("samples"), preview(rir).alias("preview"), rt60.alias("rt60")]
    return F.to_json(F.struct(*parts, *([float32_base64(rir).alias("float32")] if exact else [])))


def keep_latest(results: DataFrame, *, time: str, n: int = 64) -> DataFrame:
    """The ``n`` latest results: a bounded store as a view."""
    return results.orderBy(F.desc(time)).limit(n)


def status_summary(cases: DataFrame) -> DataFrame:
    """Counts by status, total and time; required cases pass if none failed or broke."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return cases.agg(F.count("*").alias("cases"), n("pass"), n("fail"), n("error"), n("skip"), F.round(F.sum("seconds"), 4).alias("seconds"), F.coalesce(F.bool_and(~F.col("status").isin("fail", "error")), F.lit(True)).alias("required_passed"))


def markdown(table: DataFrame, *, digits: int = 3, most: int = 1000) -> str:
    """A small table as Markdown, for a report; what is longer than ``most`` rows isn't one."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    text = lambda v: "n/a" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(table.columns) + " |", "|" + "-|" * len(table.columns), *("| " + " | ".join(map(text, r)) + " |" for r in rows)])


def html(text: str, title: str) -> str:
    """A page of its own from a report: headings, lists and tables of the Markdown that :func:`markdown` makes."""
    out, rows = [], []

    def close() -> None:
        if rows:
            head, *body = rows
            cells = lambda row, tag: "".join(f"<{tag}>{escape(c.strip())}</{tag}>" for c in row)
            out.append(f"<table><tr>{cells(head, 'th')}</tr>" + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in body) + "</table>")
            rows.clear()

    for line in text.split("\n"):
        if line.startswith("|"):
            if not set(line) <= set("|-"):
                rows.append(line.strip("|").split("|"))
            continue
        close()
        marks = len(line) - len(line.lstrip("#"))
        if marks:
            out.append(f"<h{marks}>{escape(line[marks:].strip())}</h{marks}>")
        elif line.startswith("* "):
            out.append(f"<p>{escape(line[2:])}</p>")
        elif line.strip():
            out.append(f"<p>{escape(line)}</p>")
    close()
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>body{{font-family:sans-serif;max-width:70em;margin:auto}}td,th{{padding:.2em .8em;text-align:right}}</style></head><body>{''.join(out)}</body></html>"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file, by the file system that ``path`` names."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def export_scene(spark: SparkSession, scene: Mapping, path: str) -> None:
    """A scene with its sources and receivers as one JSON document."""
    write_text(spark, json.dumps(scene, ensure_ascii=False, indent=2, default=lambda v: v.tolist()), path)


def first_changes(frames: DataFrame, keys: list[str], *, order: str, value: str) -> DataFrame:
    """The first frame at which a value differs from that of the frame before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return frames.withColumn("_was", F.lag(value).over(w)).where(F.col("_was").isNotNull() & (F.col("_was") != F.col(value))).groupBy(*keys).agg(F.min(order).alias("first_change"))
