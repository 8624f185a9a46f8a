"""The queries that SQL can't say, over the smallest tables, against plain Python on the driver."""

import collections
import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from roomlake.llm import bpe, cdc, crf, queries, weak

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert len({d for d, _ in rows}) == len(rows) > 100
    return dict(rows)


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})


def collected(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_op3(spark, texts):
    prints = {}
    for d, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in collected(spark, "op3_simhash_pivot")} == {(d, f"{prints[d]:016x}", find(d)) for d in ids}


def test_op4(spark, texts, encoding):
    rows = collected(spark, "op4_byte_bpe")
    assert len(rows) == len(texts)
    for r in rows:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))


def test_op6(spark, texts):
    """Measures and the base rule for every row; the verdict from a plain run of the same rules over all patterns of votes."""
    rows = collected(spark, "op6_weak_quality")
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert 0 <= r.posterior <= 1 and r.kept == (not r.base_failed and r.posterior >= 0.5)
    measured = weak.measures(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    votes = measured.select("doc_id", *[v.alias(f"v{k}") for k, v in enumerate(weak.rules().values())]).collect()
    matrix = np.array([[v for v in row[1:]] for row in votes], np.int64)
    prior, table = weak.fit(matrix, np.ones(len(matrix)))
    plain = dict(zip([row[0] for row in votes], weak.posterior(matrix, prior, table)))
    assert all(abs(r.posterior - plain[r.doc_id]) < 1e-6 for r in rows)


def test_op8(spark, texts, encoding):
    assert {(r.doc_id, r.n_tokens) for r in collected(spark, "op8_token_counts")} == {(d, len(encoding.encode_ordinary(t))) for d, t in texts.items()}


def test_op9(spark, texts):
    order = sorted(texts, reverse=True)
    expected = set()
    for k, d in enumerate(order):
        a, b = texts[d], texts[order[(k + 1) % len(order)]]
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        x, y, z = (cdc.fingerprint(s.encode()) for s in (a, edited, b))
        expected.add((d, len(a), sha(edited), cdc.to_text(x), cdc.to_text(y), cdc.likeness(x, y), cdc.likeness(x, z)))
    assert {(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in collected(spark, "op9_chunk_fingerprint")} == expected


def test_op10(spark, texts):
    rows = collected(spark, "op10_line_crf")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality in (0, 1)]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in texts}
    learned = sorted(((q, crf.line_features(texts[d].encode())[0]) for d, q in labels if d in texts and not held[d]), key=lambda x: (x[0], x[1].tobytes()))
    field = crf.fit([crf.with_neighbours(f) for _, f in learned], [q for q, _ in learned])
    scores = dict(zip(texts, field.scores([t.encode() for t in texts.values()])))
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == held[r.doc_id] and abs(r.score - scores[r.doc_id]) < 1e-6 and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    unseen = [(q, scores[d]) for d, q in labels if d in texts and held[d]]
    assert np.mean([(s >= 0.3) == q for q, s in unseen]) > 0.7
