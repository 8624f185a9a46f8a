"""Document token counts from flat token files without an index.

A token file is a run of unsigned little-endian integers in which an
end-of-document id closes each document. Files are read in blocks of fixed size
by any number of tasks; a block finds its separators with one vectorised
comparison. What crosses blocks is put together by a prefix scan over one small
row a block: the running maximum of the last separator's place gives the start of
the document that a block's first separator ends, the running sum of separators
its number. The scan has two levels, so that no task sees all blocks of a file.

Defined cases
-------------
empty documents        separators that follow each other: 0 tokens
no separator at all    one unterminated document
tokens after the last  an unterminated document, if there are any
empty file             no documents
null ids               an empty document
other columns          of the input are ignored
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomlake.llm.memory import releasing
from roomlake.storage import Workspace

BLOCK_TOKENS = 1 << 22
#: Blocks that one task of the scan's lower level sees.
GROUP = 1024
#: Tasks that blocks are dealt to, at most; beyond, a task takes several.
TASKS = 50_000
ROLL_TOKENS = 1 << 28


def token_type(vocabulary: int) -> str:
    """The smaller type that holds ids below ``vocabulary``."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_token_files(encoded: DataFrame, root: str, *, separator: int, dtype: str) -> DataFrame:
    """Write ``ids`` of each row, each closed by ``separator``; lazily returns path, ordinal (from 0), doc_id.

    Each attempt of a task writes files of its own; those of a lost attempt are in no committed row.
    """

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        scheme, out = root[: len(root) - len(base)], None
        end = np.array([separator], dtype).tobytes()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if out is None or tokens >= ROLL_TOKENS:
                    if out is not None:
                        out.close()
                    name, ordinal, tokens = f"{base}/tokens-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin", 0, 0
                    out = fs.open_output_stream(name, compression=None, buffer_size=1 << 20)
                part = batch.slice(at, 500)
                for ids in part.column("ids"):
                    values = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                    if len(values) and not 0 <= values.min() <= values.max() < separator:
                        raise ValueError("an id is the separator or doesn't fit the type")
                    out.write(values.astype(dtype).tobytes() + end)
                    tokens += len(values) + 1
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([scheme + name] * n), pa.array(np.arange(ordinal, ordinal + n)), part.column("doc_id")], ["path", "ordinal", "doc_id"])
                ordinal, at = ordinal + n, at + n
        if out is not None:
            out.close()

    return encoded.select("doc_id", "ids").mapInArrow(releasing(write), f"path string, ordinal long, doc_id {encoded.schema['doc_id'].dataType.simpleString()}")


def list_blocks(paths: DataFrame, *, dtype: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """path, block, start, length (in tokens) of the files named in ``paths``."""
    width = np.dtype(dtype).itemsize

    def stat(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                size = fs.get_file_info(name).size
                if size % width:
                    raise ValueError(f"{path} isn't a whole number of tokens")
                starts = np.arange(0, size // width, block_tokens)
                lengths = np.minimum(block_tokens, size // width - starts)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(np.arange(len(starts))), pa.array(starts), pa.array(lengths)], ["path", "block", "start", "length"])

    return paths.select("path").mapInArrow(releasing(stat), "path string, block long, start long, length long")


def scan_blocks(blocks: DataFrame, *, separator: int, dtype: str) -> DataFrame:
    """For each block: n_ends, first_end, last_end (places in the file, null without separators), inner: lengths of the documents that lie inside."""
    width = np.dtype(dtype).itemsize

    def scan(batches):
        for batch in batches:
            for path, block, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "start", "length"))):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    tokens = np.frombuffer(file.read_at(length * width, start * width), dtype)
                ends = np.flatnonzero(tokens == separator)
                inner = pa.array([(np.diff(ends) - 1).astype(np.int32)], pa.list_(pa.int32()))
                edge = lambda k: pa.array([int(ends[k]) + start if len(ends) else None], pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block]), pa.array([start]), pa.array([length]), pa.array([len(ends)]), edge(0), edge(-1), inner], ["path", "block", "start", "length", "n_ends", "first_end", "last_end", "inner"])

    return blocks.mapInArrow(releasing(scan), "path string, block long, start long, length long, n_ends long, first_end long, last_end long, inner array<int>")


def prefix_scan(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``before`` (documents ended in earlier blocks of the file) and ``last_before`` (the last place of an end there, -1 for none)."""
    grouped = blocks.withColumn("group", F.floor(F.col("block") / GROUP))
    totals = grouped.groupBy("path", "group").agg(F.sum("n_ends").alias("n"), F.max("last_end").alias("last"))
    earlier = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("path", "group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("group_before"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("group_last"))
    within = Window.partitionBy("path", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = grouped.withColumn("n", F.coalesce(F.sum("n_ends").over(within), F.lit(0))).withColumn("last", F.coalesce(F.max("last_end").over(within), F.lit(-1)))
    return local.join(carried, ["path", "group"]).select(*blocks.columns, (F.col("n") + F.col("group_before")).alias("before"), F.greatest("last", "group_last").alias("last_before"))


def count_tokens(paths: DataFrame, space: Workspace, *, separator: int, dtype: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """path, ordinal, n_tokens, terminated of every document in the files named in ``paths``."""
    listed = space.save(list_blocks(paths, dtype=dtype, block_tokens=block_tokens), "blocks")
    # a row of the list stands for megabytes: a number of partitions that adaptive execution leaves alone
    dealt = listed.repartition(max(1, min(listed.count(), TASKS)))
    scanned = space.save(scan_blocks(dealt, separator=separator, dtype=dtype), "scanned")
    stitched = prefix_scan(scanned.drop("inner"))
    first = stitched.where("n_ends > 0").select("path", F.col("before").alias("ordinal"), (F.col("first_end") - F.col("last_before") - 1).alias("n_tokens"), F.lit(True).alias("terminated"))
    inner = (
        stitched.where("n_ends > 1").select("path", "block", "before")
        .join(scanned.select("path", "block", "inner"), ["path", "block"])
        .select("path", "before", F.posexplode("inner").alias("k", "n"))
        .select("path", (F.col("before") + F.col("k") + 1).alias("ordinal"), F.col("n").cast("long").alias("n_tokens"), F.lit(True).alias("terminated"))
    )
    file_end = scanned.groupBy("path").agg(F.sum("n_ends").alias("ordinal"), F.max(F.col("start") + F.col("length")).alias("stop"), F.coalesce(F.max("last_end"), F.lit(-1)).alias("last"))
    tail = file_end.where("stop - last - 1 > 0").select("path", "ordinal", (F.col("stop") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("terminated"))
    return first.unionByName(inner).unionByName(tail)
