"""Byte-level BPE in linear time.

The bytes of a piece are mapped to Latin-1 so that an Aho-Corasick automaton
(pyahocorasick) over the vocabulary yields, in one pass, every token that stands
at every position. Encoding goes from left to right and takes the longest token
that is compatible with the one before; where none is, it steps back and marks
the position as dead. Two tokens are compatible if merging their joined bytes
gives these two again, which is remembered. A sequence of pairwise compatible
tokens is exactly what merging by rank gives, and each position dies at most
once, so the time is linear in the piece.

Texts are cut into pieces by the pattern of the vocabulary. As in that pattern a
blank before a non-blank always begins a piece, texts are first split there, and
the ids of each such stretch are remembered in a bounded table.

Defined cases
-------------
null text         an empty text: no ids
invalid UTF-8     replaced as by Python's "replace"
null ids          decode to an empty text
empty table       no rows
other columns     are passed through
"""

from __future__ import annotations

import base64
import functools
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomlake.llm.memory import releasing

#: Stretches, and pieces, whose ids are remembered in each of two generations.
REMEMBER = 150_000
REMEMBER_UP_TO = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks, which run from 0 without a gap."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError(f"the ranks of {path} have gaps")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[int], tuple[int, int] | None]:
    """The ids of plain merging by rank (the lowest first, of equal ones the leftmost) and the two merged last.

    Quadratic; for short pieces.
    """
    parts, last = [piece[k : k + 1] for k in range(len(piece))], None
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 60:
            break
        last = ranks[parts[at]], ranks[parts[at + 1]]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts], last


def split_table(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token that merging can yield, the two tokens of its last merge; of single bytes the byte twice."""
    table = {}
    for token, rank in ranks.items():
        ids, last = merge(token, ranks)
        if ids == [rank]:
            table[rank] = last or (rank, rank)
    return table


class Recent(dict):
    """What ``make`` gives for a key, remembered in two generations of ``size`` entries at most."""

    def __init__(self, make, size: int):
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        if len(key) <= REMEMBER_UP_TO:
            self[key] = value
        return value


class Vocabulary:
    """Encoder and decoder of one set of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, splits: dict[int, tuple[int, int]] | None = None):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.splits = split_table(ranks) if splits is None else splits
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.single = [(ranks[bytes([k])], 1) for k in range(256)]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            if len(token) > 1 and rank in self.splits:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.compatible = functools.lru_cache(1 << 19)(self._compatible)
        self.pieces = Recent(lambda piece: array("i", self.encode_piece(piece.encode())).tobytes(), REMEMBER)
        self.after_blank = Recent(lambda rest: b"".join(map(self.pieces.__getitem__, self.find(" " + rest))), REMEMBER)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes gives these two tokens again.

        Walks back in time: of the two parts at the seam the one merged last is
        undone. Parts that could join before either was merged away don't stay
        apart; of equal ranks the one farther left comes first.
        """
        tokens, ranks, splits, until = self.tokens, self.ranks, self.splits, 1 << 60
        while True:
            joint = ranks.get(tokens[left] + tokens[right])
            if joint is not None and joint < until:
                return False
            undo_left = splits[left][0] != left and (left > right or splits[right][0] == right)
            if undo_left:
                until, left = left, splits[left][1]
            elif splits[right][0] != right:
                until, right = right + 1, splits[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        starting = [[self.single[byte]] for byte in piece]
        for last, token in self.automaton.iter(piece.decode("latin-1")):
            starting[last - token[1] + 1].append(token)  # by end, so the longest is the last
        n, dead, found, lengths, at, compatible = len(piece), bytearray(len(piece) + 1), [], [], 0, self.compatible
        untried = [starting[0][:]]
        while at < n:
            options = untried[-1]
            while options:
                token, length = options.pop()
                if not dead[at + length] and (not found or compatible(found[-1], token)):
                    found.append(token)
                    lengths.append(length)
                    at += length
                    untried.append(starting[at][:] if at < n else [])
                    break
            else:
                dead[at] = 1
                untried.pop()
                found.pop()
                at -= lengths.pop()
        return found

    def forget(self) -> None:
        """Keep one generation of stretches and pieces, for the next task."""
        self.after_blank.older = {}
        self.pieces.older = {}

    def encode(self, text: str) -> bytes:
        """The ids of a text as native 32-bit integers."""
        first, *rest = split_before_blanks(text)
        head = b"".join(map(self.pieces.__getitem__, self.find(first)))
        return head + b"".join(map(self.after_blank.__getitem__, rest))


_before_blank = re.compile(r" (?=\S)")
_blank_elsewhere = re.compile(r" (?:\s|$)")


def split_before_blanks(text: str) -> list[str]:
    """The text cut at every blank that stands before a non-blank; these blanks are left out."""
    return _before_blank.split(text) if _blank_elsewhere.search(text) else text.split(" ")


_vocabularies: dict[tuple[int, str], Vocabulary] = {}


def _vocabulary(tables: tuple[dict[bytes, int], dict[int, tuple[int, int]]], pattern: str) -> Vocabulary:
    """One a process, whichever broadcast it came by."""
    key = (hash(tuple(tables[0].items())), pattern)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(tables[0], pattern, tables[1])
    return _vocabularies[key]


class Tokenizer:
    """DataFrame operators over one rank file, which the driver reads and broadcasts; its size is that of the vocabulary."""

    def __init__(self, spark, path: str, pattern: str):
        ranks = load_ranks(path)
        self.tables = spark.sparkContext.broadcast((ranks, split_table(ranks)))
        self.pattern = pattern

    def encode(self, df: DataFrame, *, text: str = "text", ids: str = "ids") -> DataFrame:
        """``df`` with the ids of each text in place of the text."""
        tables, pattern = self.tables, self.pattern
        others = [f for f in df.schema.fields if f.name != text]
        names = [f"c{k}" for k in range(len(others))]

        def run(batches):
            vocabulary = _vocabulary(tables.value, pattern)
            for batch in batches:
                for part in by_bytes(batch, "_text"):
                    encoded = [vocabulary.encode((t.as_py() or b"").decode("utf-8", "replace")) for t in part.column("_text")]
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in encoded], dtype=np.int64)]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(encoded), np.int32), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.ListArray.from_arrays(pa.array(offsets), values)], [*names, "_ids"])
            vocabulary.forget()

        source = df.select(*[F.col(f"`{f.name}`").alias(n) for f, n in zip(others, names)], F.col(f"`{text}`").cast("binary").alias("_text"))
        schema = T.StructType([*[T.StructField(n, f.dataType) for f, n in zip(others, names)], T.StructField("_ids", T.ArrayType(T.IntegerType()))])
        return source.mapInArrow(releasing(run), schema).select(*[F.col(n).alias(f.name) for f, n in zip(others, names)], F.col("_ids").alias(ids))

    def decode(self, df: DataFrame, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """``df`` with the decoded bytes of ``ids`` beside all other columns."""
        tables = self.tables
        names = [f"c{k}" for k in range(len(df.columns))]
        at = names[df.columns.index(ids)]

        def run(batches):
            ranks = tables.value[0]
            tokens = pa.array(sorted(ranks, key=ranks.__getitem__), pa.binary())
            for batch in batches:
                sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                for part in slices(batch, sizes, 2 << 20):
                    lists = part.column(at)
                    data = tokens.take(lists.flatten())
                    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
                    _, offsets, values = data.buffers()
                    offsets = np.frombuffer(offsets, np.int32)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int32)
                    joined = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(offsets[ends])), values if values is not None else pa.py_buffer(b"")])
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), joined], [*names, "_decoded"])

        source = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])
        schema = T.StructType([*source.schema.fields, T.StructField("_decoded", T.BinaryType())])
        return source.mapInArrow(releasing(run), schema).select(*[F.col(n).alias(c) for c, n in zip(df.columns, names)], F.col("_decoded").alias(decoded))


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int):
    """Parts of a batch of about ``most`` in total size, or of a single row."""
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Slices of a batch in which ``column`` (binary) has about ``most`` bytes, or a single row."""
    return slices(batch, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64), most)
