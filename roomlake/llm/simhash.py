"""SimHash near-duplicates by pivot distance tables.

Fingerprints are compared through their Hamming distances to ``PIVOTS`` reference
fingerprints (pivots), which lie far apart. The distances are computed once for
each distinct fingerprint and travel with it. By the triangle inequality no
coordinate of two fingerprints at distance k differs by more than k, so a pair
with a larger coordinate difference is discarded, and only survivors are verified
by their own distance.

Not all pairs can be formed, and distances to far pivots say too little to sort by:
they are 32 give or take 4 for any fingerprint. Hence rows meet by blocks first:
of ``BLOCKS`` blocks of bits at most k differ, so the others agree, and rows meet once for
each choice of these. No pair within distance k can be missed. What meets but is
farther apart differs in several of the other bits, whose signs rarely cancel
against all pivots: that is what the table finds.

A meeting place holds distinct fingerprints only. Where more than ``PAIRS_UP_TO`` meet,
pairs are not enumerated: each member is linked to its *midpoints*, the values
one free bit away. Two members share a midpoint exactly if they differ by two
bits or fewer, so the graph has the same components with linearly many edges.

For word shingles at a similarity of 0.8 the bits say too little; see
:mod:`roomlake.llm.similar`.

Defined cases
-------------
null or wordless text   fingerprint zero, linked like any other
null ids                kept; a component's id is its smallest non-null id
repeated rows           kept, each with its component
empty table             no rows
other columns           of the input are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlake.llm.components import connected_components
from roomlake.llm.memory import releasing
from roomlake.storage import Workspace

SEED = 42
BITS = 64
BLOCKS = 5
#: Bits in which two texts may differ, for which the blocks and midpoints are made.
DISTANCE = 2
PIVOTS = 16
#: Any two pivots differ in this many bits at least; of random ones in 32 on average.
PIVOTS_APART = 28
#: Members of a meeting place up to which pairs are enumerated; more are linked by midpoints.
PAIRS_UP_TO = 32
#: Distinct fingerprints that one task puts into places, on average.
ROWS_A_TASK = 20_000


@cache
def pivots() -> tuple[int, ...]:
    """The reference fingerprints: of the hashes of 0, 1, 2, ... those that are far enough from all before them."""
    found: list[int] = []
    for k in range(10_000):
        value = xxhash.xxh64_intdigest(k.to_bytes(8, "little"), SEED)
        if len(found) < PIVOTS and all((value ^ p).bit_count() >= PIVOTS_APART for p in found):
            found.append(value)
    return tuple(found)


def blocks() -> list[tuple[int, int]]:
    """First bit and width of each block."""
    cuts = [BITS * b // BLOCKS for b in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def choices() -> list[tuple[int, ...]]:
    """The blocks that agree, for each way in which they can."""
    return list(combinations(range(BLOCKS), BLOCKS - DISTANCE))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes, *, words: int, seed: int = SEED) -> int:
    """The signed fingerprint of one text."""
    hashed = xxhash.xxh64_intdigest
    return int(majority(text, words, 8, lambda parts: np.fromiter((hashed(x, seed) for x in parts), "<u8", len(parts)).tobytes()).view("<i8")[0])


#: Shingles hashed at a time.
STRETCH = 1 << 13


def shingles(text: bytes, words: int) -> Iterator[list[bytes]]:
    """All word shingles of the lower-cased text, space-joined, in stretches; of fewer words the whole sequence, of none nothing."""
    tokens = text.lower().split()  # bytes: A-Z only, and blanks \x20 and \x09-\x0D only
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(1, len(tokens) - words + 1)
    del tokens
    starts, stops = np.concatenate([[0], ends[: n - 1] + 1]), ends[min(words, len(ends)) - 1 :]
    for at in range(0, n, STRETCH):
        yield [joined[a:b] for a, b in zip(starts[at : at + STRETCH].tolist(), stops[at : at + STRETCH].tolist())]


def majority(text: bytes, words: int, size: int, hashes) -> np.ndarray:
    """The bits set in over half the hashes (``size`` bytes each) of the shingles, packed with the lowest bit first; zero for none."""
    ones, n = np.zeros(8 * size, np.int64), 0
    for parts in shingles(text, words):
        ones += np.unpackbits(np.frombuffer(hashes(parts), np.uint8).reshape(-1, size), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(parts)
    return np.packbits(2 * ones > n, bitorder="little")


def fingerprints(docs: DataFrame, *, words: int = 5, seed: int = SEED, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp`` (long): a bit is 1 if set in over half the XXH64 of the lower-cased word shingles."""

    def of(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", words=words, seed=seed) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps, pa.int64())], [*keep, "fp"])

    source = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    return source.mapInArrow(releasing(of), ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", fp long")


def as_hex(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distance_table(fps: DataFrame) -> DataFrame:
    """``fps`` with ``table``: the distances of fp to the pivots, a byte each."""
    return fps.withColumn("table", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("byte") for p in pivots()]))


def farthest_coordinate(a: Column, b: Column) -> Column:
    """The largest difference of two rows of the table: a bound of the distance from below."""
    return F.greatest(*[F.abs(a[k] - b[k]) for k in range(PIVOTS)])


def meeting_keys(fp: Column) -> Column:
    """A long for each choice of blocks: the choice's number and the blocks' bits."""
    bits = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for at, width in blocks()]
    keys = []
    for k, chosen in enumerate(choices()):
        key = F.lit(k).cast("long")
        for b in chosen:
            key = F.shiftleft(key, blocks()[b][1]).bitwiseOR(bits[b])
        keys.append(F.struct(F.lit(k).alias("choice"), key.alias("key")))
    return F.array(*keys)


def free_bits(choice: int) -> list[int]:
    """The bits outside the blocks that agree."""
    return [bit for b, (at, width) in enumerate(blocks()) if b not in choices()[choice] for bit in range(at, at + width)]


def pairs_that_meet(met: DataFrame) -> DataFrame:
    """x, y (fp and table each) of every pair in a place of ``met`` (choice, members), once a place."""
    return met.select(F.posexplode("members").alias("k", "x"), "members").select("x", F.explode(F.expr("slice(members, k + 2, size(members))")).alias("y"))


def survivors(pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` that no pivot tells apart."""
    return pairs.where(farthest_coordinate(F.col("x.table"), F.col("y.table")) <= DISTANCE)


def places(fps: DataFrame) -> DataFrame:
    """choice, members (fp and table) of every place in which two or more of ``fps`` (distinct) meet."""
    placed = distance_table(fps.select("fp")).select(F.struct("fp", "table").alias("member"), F.explode(meeting_keys(F.col("fp"))).alias("place"))
    met = placed.groupBy("place").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)
    return met.select("place.choice", "members")


def links(fps: DataFrame, space: Workspace) -> DataFrame:
    """Edges (a, b) of a graph in which fingerprints are connected as by all pairs within ``DISTANCE``.

    ``fps``: distinct fingerprints. Midpoints that are no fingerprints may occur
    as ends.
    """
    met = space.save(places(fps), "met")
    near = survivors(pairs_that_meet(met.where(F.size("members") <= PAIRS_UP_TO))).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    verified = near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)

    masks = [[0, *(_signed(1 << bit) for bit in free_bits(k))] for k in range(len(choices()))]
    flips = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in masks])[F.col("choice")]
    crowded = met.where(F.size("members") > PAIRS_UP_TO).select(F.explode("members.fp").alias("a"), flips.alias("flips"))
    middle = crowded.select("a", F.explode("flips").alias("m")).select("a", F.col("a").bitwiseXOR(F.col("m")).alias("b")).where("a <> b")
    return verified.unionByName(middle).distinct()


def components(fps: DataFrame, space: Workspace) -> DataFrame:
    """(fp, root) of every fingerprint that has a link; ``fps`` are distinct."""
    return connected_components(links(fps, space), space)


def smallest_of_roots(first: DataFrame, space: Workspace) -> DataFrame:
    """fp, component_id for ``first`` (fp, first_id, root): the smallest id of each root.

    Both sides are written, so that adaptive execution can split a root of very
    many fingerprints or send the small side to all tasks.
    """
    first = space.save(first, "first")
    smallest = space.save(first.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    return space.save(first.join(smallest, "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, space: Workspace, *, words: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp, component_id: the smallest id that is reachable over fingerprints within ``DISTANCE`` bits.

    Copies meet in the distinct fingerprints (pre-aggregated), and their number
    plays no part beyond. The last join is by fingerprint; adaptive execution can
    split the side of the documents.
    """
    marked = space.save(fingerprints(docs, words=words, text=text, keep=(id_column,)), "fingerprints")
    distinct = space.save(marked.groupBy("fp").agg(F.min(id_column).alias("first_id")), "distinct")
    # the table is small before it is put into places, so Spark would read it in few tasks
    dealt = distinct.select("fp").repartition(1 + distinct.count() // ROWS_A_TASK)
    rooted = components(dealt, space)
    classes = smallest_of_roots(distinct.join(rooted, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), space)
    return marked.join(classes, "fp").select(id_column, "fp", "component_id")
