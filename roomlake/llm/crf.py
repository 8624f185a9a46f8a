"""Document quality by a linear-chain conditional random field over lines.

Each line of a document is good or bad. A line's scores come from its own
features and those of the lines before and after it; neighbouring labels have
pair scores. The forward-backward recursion gives each line's probability of
being good, and the document's score is their mean, weighted by line length.

The field is fitted on the driver, on line features of a bounded sample of
labelled documents, whose lines take the document's label. Scoring sees all
lines of all documents, wherever they are, with the weights as a closure of a
few hundred numbers.

Defined cases
-------------
null, empty or wordless text  has no lines: the score is the sample's share of good documents
lines without words           are left out of the chain
null labels                   are not learned from
rows of equal id              are scored each; each label row of an id counts
no labels, or of one kind     the weights stay zero: all scores are that share (0.5 without labels)
empty table                   no rows
other columns                 of the input are ignored
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlake.llm.bpe import by_bytes
from roomlake.llm.memory import releasing

#: Labelled documents to fit on, those of the smallest hashes.
SAMPLE = 6000
#: Lines of a chain when fitting; a longer document is cut into several, all of which are fitted.
STRETCH = 400
ROUNDS = 150
RATE = 0.15
RIDGE = 1e-3

FEATURES = ("symbols", "pipes", "upper", "exclaims", "digits", "same_next", "distinct", "words", "word_length", "high_bytes", "seen_before", "full_stop", "capital")
_CLASSES = {"symbols": b"#*$%&<>", "pipes": b"|", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "exclaims": b"!", "digits": b"0123456789", "high": bytes(range(0xC0, 256))}
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _k, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members)] = _k


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features (a row for each line with words) and lengths in bytes."""
    lines = [(line, words) for line in text.split(b"\n") if (words := line.split())]
    if not lines:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0, np.int64)
    lengths = np.array([len(line) for line, _ in lines])
    # classes of all lines at once: a histogram over (line, class)
    which = np.repeat(np.arange(len(lines)), lengths) * (len(_CLASSES) + 1) + _CLASS_OF[np.frombuffer(b"".join(line for line, _ in lines), np.uint8)]
    symbols, pipes, upper, lower, exclaims, digits, high, _ = np.bincount(which, minlength=len(lines) * (len(_CLASSES) + 1)).reshape(len(lines), -1).T.astype(np.float64)
    n = np.array([len(words) for _, words in lines], np.float64)
    same = np.array([sum(map(bytes.__eq__, words, words[1:])) for _, words in lines])
    distinct = np.array([len(set(words)) for _, words in lines])
    seen, before = set(), []
    for line, _ in lines:
        before.append(line in seen)
        seen.add(line)
    stop = np.array([line.rstrip()[-1:] in b".?!" for line, _ in lines])
    capital = np.array([line.lstrip()[:1].isupper() for line, _ in lines])
    letters = np.maximum(upper + lower + high, 1)
    rows = (np.minimum(symbols / n, 3) / 3, np.minimum(2 * pipes / n, 1), upper / letters, np.minimum(exclaims / n, 1), np.minimum(digits / n, 3) / 3, same / n, distinct / n, np.log1p(n) / 6, np.minimum(lengths / n, 20) / 20, high / letters, before, stop, capital)
    return np.stack(rows, 1).astype(np.float32), lengths


def with_neighbours(features: np.ndarray) -> np.ndarray:
    """A constant, the line's own features, those of the line before and after (zeros at the ends), and whether there is one."""
    n = len(features)
    own = np.hstack([np.ones((n, 1), np.float32), features])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    return np.hstack([own, before, after])


WIDTH = 3 * (len(FEATURES) + 1)


@dataclass(frozen=True)
class LineField:
    """Weights: of a good line's score (a bad one has 0), and of pairs of labels (bad, good)."""

    weights: np.ndarray
    pairs: np.ndarray
    share: float

    def marginals(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """For each chain (its rows of features) each line's probability of being good."""
        return [m[:, 1] for m, _, _ in _forward_backward([c @ self.weights for c in chains], self.pairs)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        found = [line_features(t) for t in texts]
        filled = [k for k, (f, _) in enumerate(found) if len(f)]
        out = np.full(len(texts), self.share)
        for k, good in zip(filled, self.marginals([with_neighbours(found[k][0]) for k in filled])):
            out[k] = np.average(good, weights=found[k][1])
        return np.clip(out, 0, 1)


def _forward_backward(potentials: list[np.ndarray], pairs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each chain its marginals, its pair marginals summed, and its log partition.

    All chains take each step together, the longest first; messages are scaled.
    """
    order = sorted(range(len(potentials)), key=lambda k: -len(potentials[k]))
    lengths = np.array([len(potentials[k]) for k in order], np.int64)
    if not len(lengths):
        return []
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    u = np.concatenate([potentials[k] for k in order]).astype(np.float64)
    top = np.maximum(u, 0)
    local = np.exp(np.stack([-top, u - top], 1))
    step = np.exp(pairs)
    alpha, beta, scale = np.empty_like(local), np.empty_like(local), np.empty(len(u))
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(int(lengths[0]))]  # chains longer than t
    for t, m in enumerate(active):
        at = starts[:m] + t
        a = local[at] if t == 0 else (alpha[at - 1] @ step) * local[at]
        scale[at] = a.sum(1)
        alpha[at] = a / scale[at][:, None]
    beta[starts + lengths - 1] = 1
    for t in range(int(lengths[0]) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        b = (local[at + 1] * beta[at + 1]) @ step.T
        beta[at] = b / scale[at + 1][:, None]
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    logs = np.log(scale) + top
    out: list = [None] * len(potentials)
    for k, s, n in zip(order, starts, lengths):
        between = (alpha[s : s + n - 1, :, None] * step * ((local[s + 1 : s + n] * beta[s + 1 : s + n]) / scale[s + 1 : s + n, None])[:, None, :]).sum(0)
        out[k] = gamma[s : s + n], between, float(logs[s : s + n].sum())
    return out


def fit(chains: list[np.ndarray], labels: list[int], *, rounds: int = ROUNDS) -> LineField:
    """Maximum likelihood with a ridge, by Adam. A chain counts by the root of its length; both labels count alike in sum.

    Chains are cut into stretches, so that the steps of the recursion are bounded.
    """
    labels = np.asarray(labels)
    share = float(labels.mean()) if len(labels) else 0.5
    theta = np.zeros(WIDTH + 4)
    chains, labels = [c for c in chains if len(c)], labels[[k for k, c in enumerate(chains) if len(c)]]
    if len(set(labels.tolist())) < 2:
        return LineField(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), share)
    lengths = np.array([len(c) for c in chains])
    mass = 1 / np.sqrt(lengths)
    for y in (0, 1):
        mass[labels == y] *= 0.5 / (mass[labels == y] * lengths[labels == y]).sum()
    pieces = -(-lengths // STRETCH)
    mass, labels = np.repeat(mass, pieces), np.repeat(labels, pieces)
    lengths = np.concatenate([np.diff(np.append(np.arange(0, n, STRETCH), n)) for n in lengths])
    rows, line_mass, line_label = np.concatenate(chains).astype(np.float64), np.repeat(mass, lengths), np.repeat(labels, lengths)
    cuts = np.cumsum(lengths)[:-1]
    held = np.zeros((2, 2))
    for y in (0, 1):
        held[y, y] = (mass * (lengths - 1))[labels == y].sum()
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        found = _forward_backward(np.split(rows @ theta[:WIDTH], cuts), theta[WIDTH:].reshape(2, 2))
        good = np.concatenate([m[:, 1] for m, _, _ in found])
        between = sum(w * b for w, (_, b, _) in zip(mass, found))
        slope = np.concatenate([rows.T @ (line_mass * (line_label - good)), (held - between).ravel()]) - RIDGE * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
    return LineField(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), share)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, text: str = "text") -> LineField:
    """A field fitted on at most ``sample`` labelled documents that are not held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = usable.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "quality").limit(sample)

    def features(batches):
        for batch in batches:
            for part in by_bytes(batch, "_text"):
                rows = [(q, line_features(t.as_py() or b"")[0]) for q, t in zip(part.column("quality").to_pylist(), part.column("_text"))]
                rows = [(q, f.ravel().tolist()) for q, f in rows]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int32()), pa.array([f for _, f in rows], pa.list_(pa.float32()))], ["quality", "features"])

    joined = docs.select("doc_id", F.col(text).cast("binary").alias("_text")).join(F.broadcast(chosen), "doc_id").select("quality", "_text")  # ``sample`` rows at most
    collected = joined.mapInArrow(releasing(features), "quality int, features array<float>").toArrow().sort_by([("quality", "ascending")])
    rows = sorted((q, np.array(f, np.float32).tobytes()) for q, f in zip(collected.column("quality").to_pylist(), collected.column("features").to_pylist()))
    chains = [with_neighbours(np.frombuffer(f, np.float32).reshape(-1, len(FEATURES))) for _, f in rows]
    return fit(chains, [q for q, _ in rows])


def score_documents(docs: DataFrame, field: LineField, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), column: str = "score") -> DataFrame:
    """The ``keep`` columns and the score of each text."""
    names = [f"c{k}" for k in range(len(keep))]

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "_text", 4 << 20):
                scores = field.scores([t.as_py() or b"" for t in part.column("_text")])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scores)], [*names, "_score"])

    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").cast("binary").alias("_text"))
    schema = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names) + ", _score double"
    return source.mapInArrow(releasing(run), schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("_score").alias(column))
