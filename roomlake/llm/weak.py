"""Quality rules by weak supervision.

Rules look at measures of a text and vote good (1) or bad (0), or abstain (-1).
No rule decides alone: expectation-maximisation estimates how often each rule is
right on good and on bad texts, from all texts, and a text is kept by its
posterior probability. Abstaining counts as an outcome of its own, since most
rules look for one defect and say nothing where they don't find it.

Votes have few patterns (3 for each rule), so the texts are counted by pattern;
the driver fits on these counts, whose number doesn't grow with the input, and
the posterior of each pattern goes back as a literal.

Defined cases
-------------
null or wordless text   no words: base_failed
null ids, repeated rows kept
rules that all abstain  leave the prior
empty table             no rows
other columns           of the input are ignored
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlake.llm.bpe import by_bytes
from roomlake.llm.memory import releasing
from roomlake.storage import Workspace

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_exclaims", "n_repeat_next")
PRIOR_GOOD = 0.8
#: How a rule is taken to vote (bad, good, none) on bad and on good texts before any is seen: it looks for one
#: defect, which a bad text need not have and a good one hardly has. Counted as so many texts of each class.
START = ((0.3, 0.2, 0.5), (0.002, 0.3, 0.698))
STRENGTH = 20.0
#: A rule against a defect is held to vote against this part of the good texts at most. Without the bound the
#: largest group of defects that occur together would take the bad class, and single defects would pass as good.
MOST_WRONG = 0.005
ROUNDS = 100


#: Words from which repeats are counted on numbers in arrays, which take less memory and give the same.
LONG = 20_000


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found, covered, upto = Counter(windows), 0, 0
    for k, window in enumerate(windows):
        if found[window] > 1:
            covered += k + 3 - max(k, upto)
            upto = k + 3
    return covered


def repeated_words_long(words: list[bytes]) -> int:
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1].ravel()
    _, which, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    hit = counts[which.ravel()] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``."""
    words = text.split()  # blanks \\x20 and \\x09-\\x0D only
    n = len(words)
    repeated = repeated_words(words) if n < LONG else repeated_words_long(words)
    lines = [line for line in text.split(b"\n") if line.split()]
    code_points = sum(map(len, words)) - _continuations(text)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    same = sum(a == b for a, b in zip(words, words[1:]))
    return n, code_points, symbols, len(lines) - len(set(lines)), repeated, upper, upper + lower, text.count(b"!"), same


_CONTINUATION = bytes(range(0x80, 0xC0))


def _continuations(text: bytes) -> int:
    return len(text) - len(text.translate(None, _CONTINUATION))


def measures(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id and the measures of each text (long)."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "_text"):
                rows = np.array([measure(t.as_py() or b"") for t in part.column("_text")], np.int64).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], ["doc_id", *MEASURES])

    source = docs.select("doc_id", F.col(text).cast("binary").alias("_text"))
    return source.mapInArrow(releasing(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))


def _per(top: str, below: str) -> Column:
    return F.col(top) / F.greatest(F.col(below), F.lit(1))


def _vote(bad: Column | None = None, good: Column | None = None) -> Column:
    vote = F.when(bad, 0) if bad is not None else F.when(good, 1)
    return (vote.when(good, 1) if bad is not None and good is not None else vote).otherwise(-1)


def rules() -> dict[str, Column]:
    """Rules over the measures: most look for one defect and abstain where it is absent."""
    mean = _per("word_chars", "n_words")
    return {
        "long": _vote(good=F.col("n_words") >= 200),
        "word_length": _vote(bad=(mean < 2) | (mean > 14)),
        "symbols": _vote(bad=_per("n_symbols", "n_words") > 0.1),
        "repeats": _vote(bad=_per("n_repeat_words", "n_words") > 0.3),
        "same_next": _vote(bad=_per("n_repeat_next", "n_words") > 0.2),
        "upper": _vote(bad=_per("n_upper", "n_letters") > 0.4),
        "exclaims": _vote(bad=_per("n_exclaims", "n_words") > 0.1),
        "dup_lines": _vote(bad=(F.col("n_dup_lines") >= 3) & (_per("n_dup_lines", "n_words") > 0.02)),
        "plain": _vote(good=(F.col("n_symbols") + F.col("n_exclaims") + F.col("n_repeat_words") == 0) & (F.col("n_words") > 0)),
    }


def fit(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """The prior and, by rule and true class, the log probability of the votes bad, good and none.

    ``patterns``: a row of votes for each pattern (-1, 0, 1).
    """
    start = STRENGTH * np.broadcast_to(np.array(START), (patterns.shape[1], 2, 3))
    votes = np.where(patterns < 0, 2, patterns)
    chosen = votes[:, :, None] == np.arange(3)
    prior, table = PRIOR_GOOD, np.log(start / start.sum(2, keepdims=True))
    for _ in range(ROUNDS):
        good = posterior(patterns, prior, table)
        soft = np.stack([1 - good, good], 1) * counts[:, None]
        seen = start + np.einsum("pc,prv->rcv", soft, chosen)
        rate = seen / seen.sum(2, keepdims=True)
        excess = np.maximum(rate[:, 1, 0] - MOST_WRONG, 0)
        rate[:, 1, 0] -= excess
        rate[:, 1, 2] += excess
        table = np.log(rate)
        was, prior = prior, float((soft[:, 1].sum() + PRIOR_GOOD * STRENGTH) / (counts.sum() + STRENGTH))
        if abs(was - prior) < 1e-10:
            break
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """The probability that a text of each pattern is good."""
    votes = np.where(patterns < 0, 2, patterns)
    logs = table[np.arange(patterns.shape[1])[None], :, votes].sum(1)
    x = np.clip(logs[:, 0] - logs[:, 1] + math.log(1 - prior) - math.log(prior), -700, 700)
    return 1 / (1 + np.exp(x))


def code_of(votes: list[Column]) -> Column:
    code = F.lit(0)
    for v in votes:
        code = code * 3 + v + 1
    return code.cast("int")


def judge(measured: DataFrame, voting: dict[str, Column] | None = None) -> DataFrame:
    """``measured`` with ``votes`` (the pattern's code) and ``posterior``."""
    voting = rules() if voting is None else voting
    if len(voting) > 10:
        raise ValueError("at most ten rules: the driver has a count for each pattern of votes")
    voted = measured.withColumn("votes", code_of(list(voting.values())))
    counted = dict(voted.groupBy("votes").agg(F.count("*").alias("n")).collect())  # 3 ** rules rows at most
    every = {code: p for code, p in enumerate(product((-1, 0, 1), repeat=len(voting))) if code in counted}
    patterns = np.array(list(every.values()), np.int64).reshape(-1, len(voting))
    counts = np.array([counted[c] for c in every], np.float64)
    prior, table = fit(patterns, counts)
    found = dict(zip(every, posterior(patterns, prior, table).tolist()))
    if not found:
        return voted.withColumn("posterior", F.lit(None).cast("double"))
    spark = measured.sparkSession
    lookup = spark.createDataFrame(list(found.items()), "votes int, posterior double")
    return voted.join(F.broadcast(lookup), "votes", "left")  # 3 ** rules rows at most


def quality_rules(docs: DataFrame, space: Workspace, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, posterior, kept: for each text of ``docs``."""
    judged = judge(space.save(measures(docs), "measures"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *MEASURES, failed.alias("base_failed"), "votes", "posterior", (~failed & (F.col("posterior") >= threshold)).alias("kept"))
