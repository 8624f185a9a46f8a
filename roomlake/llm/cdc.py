"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk ends where the hash has enough
zero bits. Chunking is normalised: up to the normal size more zero bits are asked
for, beyond it fewer, so that sizes gather around it. The hash depends on the
last ``WINDOW`` bytes only and a chunk has at least that many, so boundaries move
with the text and an insertion changes the chunks around it alone.

A fingerprint is the set of chunk digests, each with the chunk's length as its
weight: ten hexadecimal digits a chunk, eight of the digest and two of the
length, in ascending order. Two fingerprints are compared by containment: the
weight of what they share by the smaller of both weights.

Defined cases
-------------
null text               an empty text: the empty fingerprint
empty fingerprints      likeness 1 to each other, 0 to all others
invalid UTF-8           is chunked as it is; for editing replaced as by Python's "replace"
null ids                come after all others in descending order
rows of equal id        follow each other by text
a single row            is its own next document
empty table             no rows
other columns           of the input are ignored
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlake.llm.memory import releasing

MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 16, 32, 96
WINDOW = 16
#: Zero bits asked for up to the normal size, and beyond it; among the highest, which all of the window's bytes reach.
HARD, EASY = 0b1111111 << 24, 0b111 << 28

GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=4).digest(), "little") for k in range(256)], np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """The hash after each byte: the sum over the window of each byte's gear, doubled for each byte since."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def boundaries(data: bytes) -> list[int]:
    """The end of each chunk, ascending; the last is the end of the data."""
    h, n = gear_hashes(data), len(data)
    hard = (np.flatnonzero((h & np.uint32(HARD)) == 0) + 1).tolist()
    easy = (np.flatnonzero((h & np.uint32(EASY)) == 0) + 1).tolist()
    ends, at, i, j = [], 0, 0, 0
    while at < n:
        end = min(at + MAX_SIZE, n)
        if at + MIN_SIZE < n:
            i = bisect_left(hard, at + MIN_SIZE, i)
            if i < len(hard) and hard[i] < min(at + NORMAL_SIZE, end):
                end = hard[i]
            else:
                j = bisect_left(easy, at + NORMAL_SIZE, j)
                if j < len(easy) and easy[j] < end:
                    end = easy[j]
        ends.append(end)
        at = end
    return ends


def digests(data: bytes, ends: list[int], start: int = 0) -> list[int]:
    """Digest and length of each chunk, as one number."""
    out, of = [], xxhash.xxh32_intdigest
    for end in ends:
        out.append(of(data[start:end]) << 8 | end - start)
        start = end
    return out


def chunk_set(numbers: list[int]) -> np.ndarray:
    return np.unique(np.array(numbers, np.uint64))


def to_text(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    rows = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return np.pad(rows, ((0, 0), (3, 0))).reshape(-1).view(">u8").astype(np.uint64)


def weight(chunks: np.ndarray) -> int:
    return int((chunks & np.uint64(255)).sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared weight by the smaller weight."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return weight(np.intersect1d(a, b, assume_unique=True)) / min(weight(a), weight(b))


def fingerprint(data: bytes) -> np.ndarray:
    return chunk_set(digests(data, boundaries(data)))


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row."""

    def run(batches):
        for batch in batches:
            found = [to_text(fingerprint(t.as_py() or b"")) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    source = docs.select("doc_id", F.col(text).cast("binary").alias("_text"))
    return source.mapInArrow(releasing(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_likeness(pairs: DataFrame, left: str, right: str, *, column: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two fingerprint columns; null where one is null."""

    @F.pandas_udf("double")
    def of(a, b):
        return a.combine(b, lambda x, y: None if x is None or y is None else likeness(from_text(x), from_text(y)))

    return pairs.withColumn(column, of(left, right))


class Edited:
    """A text, its chunks, and those of the text whose last third another one replaces."""

    __slots__ = ("chunks", "doc_id", "ends", "numbers", "raw", "text")

    def __init__(self, doc_id, raw: bytes):
        self.doc_id, self.raw, self.text = doc_id, raw, raw.decode("utf-8", "replace")
        self.ends = boundaries(raw)
        self.numbers = digests(raw, self.ends)
        self.chunks = chunk_set(self.numbers)

    def row(self, following: Edited) -> tuple:
        n = len(self.text)
        kept = self.text[: n - n // 3].encode()
        edited = kept + following.text[: n // 3].encode()
        if self.raw.startswith(kept):  # chunks that end in what is kept stay
            same = bisect_left(self.ends, len(kept) + 1)
            start = self.ends[same - 1] if same else 0
            # boundaries look at the chunk's own bytes only, as the smallest chunk holds the window
            rest = boundaries(edited[start:])
            chunks = chunk_set(self.numbers[:same] + digests(edited[start:], rest))
        else:
            chunks = fingerprint(edited)
        return self.doc_id, n, hashlib.sha256(edited).hexdigest(), to_text(self.chunks), to_text(chunks), likeness(self.chunks, chunks), likeness(self.chunks, following.chunks)


RESULT = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare_with_next(docs: DataFrame, *, text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document, in descending order of doc_id.

    Ids are cut into ranges at sampled quantiles and each range is gone through in
    order; the first document of a range also goes to the end of the range before.
    Texts are shuffled once. The driver has two numbers a range.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(1 << 63)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("_key"), "doc_id", F.col(text).cast("binary").alias("_text"))
    cuts = sorted({int(x) for x in keyed.select("_key").where(F.col("_key") > lowest).approxQuantile("_key", [k / parts for k in range(1, parts)], 0.25 / parts)})
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def part_of(key):
        return pd.Series((len(edges) - np.searchsorted(edges, key.to_numpy(np.int64))).astype(np.int32))  # descending

    numbered = keyed.withColumn("_part", part_of("_key"))
    heads = sorted(map(tuple, keyed.select("_key").withColumn("_part", part_of("_key")).groupBy("_part").agg(F.max("_key").alias("head")).collect()))
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}
    earlier = spark.createDataFrame(list(before.items()), "_key long, _earlier int")
    numbered = numbered.join(F.broadcast(earlier), "_key", "left")  # a row a range
    here = F.struct(F.col("_part").alias("at"), F.lit(0).alias("extra"))
    places = F.when(F.col("_earlier").isNotNull(), F.array(here, F.struct(F.col("_earlier").alias("at"), F.lit(1).alias("extra")))).otherwise(F.array(here))
    dealt = numbered.withColumn("_place", F.explode(places)).select(F.col("_place.at").alias("_at"), F.col("_place.extra").alias("_extra"), "_key", "doc_id", "_text")
    ordered = dealt.repartition("_at").sortWithinPartitions("_at", "_extra", F.desc("_key"), "_text")

    def run(batches):
        held, at, closed = None, None, False
        rows = []
        for batch in batches:
            for where, extra, doc_id, raw in zip(*(batch.column(c) for c in ("_at", "_extra", "doc_id", "_text"))):
                if where.as_py() != at:
                    held, at, closed = None, where.as_py(), False
                if closed:  # more rows of the next range's first id
                    continue
                now = Edited(doc_id.as_py(), raw.as_py() or b"")
                if held is not None:
                    rows.append(held.row(now))
                held, closed = now, bool(extra.as_py())
            if rows:
                yield out(rows)
                rows = []

    id_type = docs.schema["doc_id"].dataType

    def out(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns[1:], RESULT))], ["doc_id", *RESULT.names])

    result = ordered.mapInArrow(releasing(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return result.withColumn("doc_id", F.col("doc_id").cast(id_type))
