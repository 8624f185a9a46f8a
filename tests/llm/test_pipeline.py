"""The stages of the pipeline against brute force, and the queries against SQL, on the smallest tables."""

import collections
import hashlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from roomlake.llm import bpe, crf, lines, oracles, queries, simhash, similar

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def docs(spark):
    """The documents, with rows of nulls, an empty text, a copy and a repeated row."""
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(9001, None, None, None, None), (None, "No id, but words enough to be a line.", "en", "src1", 37), (9002, "", "en", "src2", 0)], raw.schema)
    first = raw.where("doc_id < 2")
    return raw.unionByName(more).unionByName(first).unionByName(first.withColumn("doc_id", F.col("doc_id") + 8000)).cache()


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_classifier_stage(spark, docs):
    field = crf.train(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))
    kept = corpus_pipeline.drop_low_quality(spark, docs, SF)
    assert kept.columns == docs.columns
    expected = collections.Counter(tuple(r) for r in docs.collect() if field.scores([(r.text or "").encode()])[0] >= queries.SCORE_AT_LEAST)
    assert rows(kept) == expected and 0 < sum(expected.values()) < docs.count()


def test_line_stage(spark, docs):
    got = corpus_pipeline.drop_site_boilerplate(spark, docs, SF)
    raw = docs.collect()
    pages, seen = collections.Counter(r.source for r in raw), collections.Counter()
    split = [r.text.split("\n") if r.text is not None else [] for r in raw]
    for r, every in zip(raw, split):
        seen.update({(r.source, x) for x in every if x.encode().split()})
    expected = collections.Counter()
    for r, every in zip(raw, split):
        kept = [x for x in every if not (x.encode().split() and seen[r.source, x] >= lines.AT_LEAST and seen[r.source, x] > lines.RATIO * pages[r.source])]
        text = "\n".join(kept if any(x.encode().split() for x in kept) else every) if r.text is not None else None
        expected[r.doc_id, text, r.lang, r.source, len(text) if text is not None else None] += 1
    assert got.columns == docs.columns and rows(got) == expected


def test_mixing_and_tokens_stages(spark, docs):
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and not rows(mixed) - rows(docs) and 0 < mixed.count() < docs.count()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})
    got = corpus_pipeline.tokenize(spark, mixed, SF).collect()
    text = {r.doc_id: r.text or "" for r in mixed.collect()}
    assert len(got) == mixed.count()
    for r in got:
        ids = encoding.encode_ordinary(text[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_and_empty_tables(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.run(spark, SF).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, expected = queries.QUERIES[name](spark, SF), con.sql(oracles.ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    order = sorted(got.columns)
    wanted = collections.Counter(tuple(r[expected.columns.index(c)] for c in order) for r in expected.fetchall())
    assert collections.Counter(tuple(r[c] for c in order) for r in got.collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_queries_return_every_row(spark, name):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_lines_ratio_is_documented():
    assert 0 < lines.RATIO < 1 and lines.AT_LEAST > 1


@pytest.mark.parametrize("name", ["op5_source_mix", "op7_line_dedup", "op2_chat_format"])
def test_native_plans_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("few", [4, 1])
def test_near_dedup_is_by_shingle_sets(spark, docs, monkeypatch, few):
    """Blocks and salts are small, so that places are divided; where a member asks for one other only, much is left to the last round."""
    monkeypatch.setattr(similar, "NEAREST", (few, None))
    monkeypatch.setattr(similar, "BLOCK", 16)
    monkeypatch.setattr(similar, "SALTS", 5)
    words = [f"w{k}" for k in range(60)]
    # 56 five-word shingles; m altered words at the end leave 56 - m of 56 + m: 6 pass at 50 / 62, 7 do not at 49 / 63
    planted = [(7000 + m, " ".join(words[: 60 - m] + [f"x{m}_{k}" for k in range(m)])) for m in (0, 6, 7)]
    rng = np.random.default_rng(3)
    base = [f"v{k}" for k in range(200)]
    for c in range(80):
        edited = list(base)
        for at in rng.integers(0, 200, 2 + c % 3).tolist():
            edited[at] = f"e{c}_{at}"
        planted.append((7100 + c, " ".join(edited)))
    more = spark.createDataFrame([(d, t, "en", "src0", len(t)) for d, t in planted], docs.schema)
    both = docs.unionByName(more)
    named = [r for r in both.collect() if r.doc_id is not None]

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [shingles(r.text or "") for r in named], list(range(len(named)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if 5 * common >= 4 * (len(x) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for k, r in enumerate(named):
        least[find(k)] = min(least.get(find(k), r.doc_id), r.doc_id)
    kept = [r.doc_id for r in corpus_pipeline.keep_one_of_similar(spark, both, SF).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(least.values()) and kept.count(None) == 1
    assert {7000, 7007} <= set(kept) and 7006 not in kept and 1 < sum(7100 <= x < 7200 for x in kept if x is not None) < 80


def test_near_dedup_links_by_simhash(spark, docs, monkeypatch):
    """Where no texts meet by common shingles, what SimHash links is still found, and only what the sets confirm goes."""
    words = [f"w{k}" for k in range(400)]
    texts = {1: " ".join(words), 2: " ".join([*words[:399], "x2_0"]), 3: " ".join(words[::-1]), 4: "a b", 5: "c d", 6: " ".join(words).upper()}
    bits = {d: simhash.fingerprint(t.encode(), words=5) & 2**64 - 1 for d, t in texts.items()}
    assert bits[1] == bits[6] and (bits[1] ^ bits[2]).bit_count() == 2 and (bits[1] ^ bits[3]).bit_count() > 2
    rows = spark.createDataFrame([(d, t, "en", "src0", len(t)) for d, t in texts.items()], docs.schema)
    none = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "place long, fp long")
    monkeypatch.setattr(similar, "meeting_places", lambda prefixes, space: tuple(space.save(df, n) for df, n in zip(none, ("stars", "members"))))
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_similar(spark, rows, SF).collect()) == [1, 3, 4, 5]
    false = spark.createDataFrame([(3, 1), (4, 3), (2, 1)], "doc_id long, component_id long")
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs, space, words: false)
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_similar(spark, rows, SF).collect()) == [1, 3, 4, 5]
