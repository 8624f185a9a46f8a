"""The operators against brute force, on small tables with every awkward case."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from roomlake.llm import bpe, cdc, chat, crf, lines, mixing, similar, simhash, tokenscan, warc, weak
from roomlake.storage import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use inside; as extra columns of the input they must do no harm.
EXTRA = ", _text string, fp long, tokens long, host string, place long, path string, `a.b` string, ids string"
EXTRA_VALUES = ("x", 1, 2, "h", 3, "p", "d", "i")


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame([(*r, *EXTRA_VALUES) for r in rows], schema + EXTRA)


PROSE = "The quick brown fox jumps over the lazy dog while seven small ships sail past the old stone tower at dawn. "
TEXTS = [
    (1, PROSE * 3), (2, PROSE * 3), (3, (PROSE * 3).replace("seven", "eight")), (4, None), (5, ""), (6, " \n\t "), (7, "Ünïcode ÄÖÜ 漢字 words İ"), (8, "one"), (9, "one two"),
    (10, "a b c " * 5000), (10, "a b c " * 5000), (None, "row without an id"), (11, "###$$$ %%% " * 40), (12, "x" * 50_000), (13, "Line one\nLine one\n\nLine two\nLine one"),
]


# --- archives ---------------------------------------------------------------


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 40_000, "<p>a</p>"]
    rows = [(5, "http://h/1\r\nX: y", html[0]), (2, None, html[1]), (3, "http://h/3", html[2]), (4, "u", html[3]), (9, "u", html[4]), (7, "u", html[5]), (3, "http://h/3", html[6]), (None, "u", html[0])]
    pages = documents(spark, rows, "page_id long, url string, html string").withColumn("payload", F.col("html").cast("binary"))
    got = warc.archive_and_deduplicate(pages, Workspace(spark, "t")).collect()
    assert len(got) == len(rows)
    first = {}
    for page, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", page)
    expected, seen = [], set()
    for page, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kind = "revisit" if h in seen or (h or "") in seen else "response"
        seen.add(h or "")
        expected.append((page, len(payload), digest, kind, first[h or ""] if kind == "revisit" else None))
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == collections.Counter(expected)


def test_warc_min_bytes_empty_and_incoming_revisits(spark):
    pages = spark.createDataFrame([(1, "u", b"aa"), (2, "u", b"aa"), (3, "u", b"bbbb"), (4, "u", b"bbbb")], "page_id long, url string, payload binary")
    space = Workspace(spark, "t")
    read = warc.archive_and_deduplicate(pages, space, min_bytes=3).collect()
    assert {r.page_id: r.record_type for r in read} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.archive_and_deduplicate(pages.limit(0), Workspace(spark, "t")).count() == 0
    headers = spark.createDataFrame(
        [("p", 0, 9, "<r1>", "response", 7, "u", "d", "DIG", 5, None, None), ("p", 9, 9, "<r2>", "revisit", 8, "u", "d", "DIG", None, None, None), ("q", 0, 9, "<r3>", "revisit", 9, "u", "d", "NONE", None, "<lost>", None)], warc.HEADERS
    )
    out = {r.record_id: r for r in warc.resolve_revisits(headers).collect()}
    assert (out["<r2>"].refers_to, out["<r2>"].refers_to_record, out["<r2>"].payload_bytes) == (7, "<r1>", 5)
    assert (out["<r3>"].verdict, out["<r3>"].refers_to_record) == ("revisit", "<lost>")


def test_warc_members_and_records():
    records = [warc.build_record({"WARC-Type": "response", "WARC-Record-ID": "<x>", "Content-Type": "text/plain"}, bytes([k]) * n) for k, n in enumerate((0, 1, 100_000, 7))]
    import io

    found = list(warc.scan_members(io.BytesIO(b"".join(records)), window=10))
    assert [n for _, n, _ in found] == [len(r) for r in records]
    assert [len(warc.parse_record(raw)[1]) for _, _, raw in found] == [0, 1, 100_000, 7]
    with pytest.raises((EOFError, zlib.error)):
        list(warc.scan_members(io.BytesIO(records[2][:-3]), window=10))


# --- chat -------------------------------------------------------------------

TURNS = [
    (1, 1, "assistant", "b <|end|> <\\|more|> </s>"), (1, 0, "user", "a [INST] <|turn|>x\n"), (1, 2, "assistant", None), (1, 3, "assistant", "é<|more|>"), (1, 4, "user", ""),
    (2, 0, None, "no role"), (2, 0, None, "no role"), (2, None, "assistant", "first"), (3, 0, "as\nsis<|end|>tant", "odd role"), (None, 0, "assistant", "no id"), (4, 0, "assistant", "\\" * 5 + "[/INST]<\\\\|end|>" + "y" * 30_000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, "f", "t", [1]) for r in TURNS], "conv_id long, turn long, role string, text string, formatted string, turns string, loss_spans array<int>")
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("read"), chat.read_trained(F.col("formatted"), F.col("loss_spans")).alias("trained")).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in TURNS:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(x.role, x.text) for x in got[c].read] == [(r, x) for _, _, r, x in turns]
        assert got[c].trained == "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].formatted.count("<|turn|>") == 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:]))
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_template_must_be_reversible():
    with pytest.raises(ValueError):
        chat.ChatTemplate(reserved=("<s>", "a<s>b"))


# --- fingerprints -----------------------------------------------------------


def brute_fingerprint(text, words):
    w = WORD.findall((text or "").translate(LOWER))
    parts = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if parts else 0


def brute_components(values, linked):
    parent = list(range(len(values)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


def test_simhash_near_duplicates(spark):
    rows = [r for r in TEXTS if r[1] is None or len(r[1]) < 40_000]
    got = simhash.near_duplicates(documents(spark, rows), Workspace(spark, "t"), words=3).select("doc_id", simhash.as_hex(F.col("fp")).alias("h"), "component_id").collect()
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    expected = collections.Counter((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, roots))
    assert collections.Counter((r.doc_id, r.h, r.component_id) for r in got) == expected
    assert simhash.near_duplicates(documents(spark, rows).limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("spread", [3, 12, 40])
def test_pivot_links_lose_nothing(spark, spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 1 << 63, 4, dtype=np.int64)
    flips = rng.integers(0, spread, (600, 3))
    values = sorted({int(np.int64(np.uint64(base[k % 4]) ^ np.bitwise_xor.reduce(np.uint64(1) << f.astype(np.uint64)))) for k, f in enumerate(flips)})
    found = simhash.components(spark.createDataFrame([(v,) for v in values], "fp long"), Workspace(spark, "t")).collect()
    root = {r.fp: r.root for r in found}
    expected = brute_components(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    groups, want = collections.defaultdict(set), collections.defaultdict(set)
    for v, e in zip(values, expected):
        groups[root.get(v, v)].add(v)
        want[e].add(v)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


def test_similar_documents(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    originals = [[word() for _ in range(300)] for _ in range(30)]
    rows = []
    for k, w in enumerate(originals):
        rows.append((1000 * k + 1000, " ".join(w)))
        for c in range(1, 6):
            edited = list(w)
            edited[int(rng.integers(0, 300))] = word()
            rows.append((1000 * k + 1000 + c, " ".join(edited)))
    rows += [(1, None), (2, ""), (3, rows[0][1]), (3, rows[0][1])]
    got = {(r.doc_id, r.component_id) for r in similar.similar_documents(documents(spark, rows), Workspace(spark, "t")).collect()}
    assert got == {(d, d // 1000 * 1000 if d > 3 else {1: 1, 2: 1, 3: 3}[d]) for d, _ in rows} - {(k, 1000) for k in range(1000, 1006)} | {(k, 3) for k in range(1000, 1006)}
    assert similar.similar_documents(documents(spark, rows).limit(0), Workspace(spark, "t")).count() == 0


def test_pivots_lie_far_apart():
    found = simhash.pivots()
    assert len(found) == simhash.PIVOTS and all((a ^ b).bit_count() >= simhash.PIVOTS_APART for k, a in enumerate(found) for b in found[:k])


def test_pivot_table_discards_what_is_far_and_nothing_near(spark):
    """Pairs that meet differ in 1 to 24 bits here; the table must let all within two pass, and hardly any beyond four."""
    rng = np.random.default_rng(8)
    base, free, values = int(rng.integers(0, 1 << 62)), simhash.free_bits(0), set()
    for m in range(25):
        for _ in range(6):
            values.add(simhash._signed(base ^ sum(1 << int(b) for b in rng.choice(free, m, replace=False))))
    met = simhash.places(spark.createDataFrame([(v,) for v in sorted(values)], "fp long"))
    pairs = simhash.pairs_that_meet(met).select("x", "y", F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))).alias("d")).cache()
    compared, met_by = ({r.d: r["count"] for r in df.groupBy("d").count().collect()} for df in (simhash.survivors(pairs), pairs))
    assert all(compared[d] == met_by[d] for d in met_by if d <= 2)
    far = sum(n for d, n in met_by.items() if d > 4)
    assert far > 5000 and sum(n for d, n in compared.items() if d > 4) < 0.02 * far
    assert sum(compared.values()) < 0.1 * sum(met_by.values())


# --- byte-level bpe ---------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_tables(spark, reference):
    tokens = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    df = documents(spark, TEXTS, "doc_id long, text string").drop("ids")
    out = tokens.decode(tokens.encode(df)).collect()
    got = collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded), r["a.b"]) for r in out)
    assert got == collections.Counter((d, tuple(reference.encode_ordinary(t or "")), (t or "").encode(), "d") for d, t in TEXTS)
    assert tokens.decode(tokens.encode(df.limit(0))).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {bytes(r.decoded) for r in tokens.decode(nulls).collect()} == {b""}


def test_bpe_equals_merging(ranks, reference):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    vocabulary = bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    parts = st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "\r\n", "é", "the", " in", "1", "'s", "'re", "漢", " ", "😀", "ing", "tion", "aaaa", "--", "\x00"]), max_size=40).map("".join)

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(parts, st.text(max_size=60)))
    def check(text):
        text = text.encode("utf-8", "replace").decode()
        assert np.frombuffer(vocabulary.encode(text), np.int32).tolist() == reference.encode_ordinary(text)
        first, *rest = bpe.split_before_blanks(text)
        cut = [m for k, s in enumerate([first, *rest]) for m in regex.findall(public_tokenizers.PATTERN, " " * bool(k) + s)]
        assert cut == regex.findall(public_tokenizers.PATTERN, text)

    check()


def test_bpe_is_linear(ranks, reference):
    vocabulary = bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    for unit in ("a", "ab", "aab", "the"):
        text = unit * 20_000
        assert np.frombuffer(vocabulary.encode(text), np.int32).tolist() == reference.encode_ordinary(text)


# --- mixing -----------------------------------------------------------------


def brute_allocation(capacity, weights, default, budget, depth):
    """capacity by path; fills each level up by repeated sharing."""
    out = {}

    def fill(prefix, amount, level):
        children = sorted({p[: level + 1] for p in capacity if p[:level] == prefix})
        cap = {c: sum(v for p, v in capacity.items() if p[: level + 1] == c) for c in children}
        w = {c: weights.get("/".join(c), weights.get("*/" * bool(level) + c[-1], default)) for c in children}
        cap = {c: cap[c] if w[c] else 0 for c in children}
        full, open_ = set(), set(children)
        while True:
            rest, total = amount - sum(cap[c] for c in full), sum(w[c] for c in open_)
            more = {c for c in open_ if w[c] == 0 or cap[c] * total <= rest * w[c]}
            if not more:
                break
            full |= more
            open_ -= more
        upto = 0
        for c in children:
            if c in full:
                share = cap[c]
            else:
                share = rest * (upto + w[c]) // total - rest * upto // total
                upto += w[c]
            if level + 1 == depth:
                out[c] = share
            else:
                fill(c, share, level + 1)

    fill((), budget, 0)
    return out


@pytest.mark.parametrize("epochs,percent", [(1, 30), (1, 90), (3, 150)])
def test_mixing(spark, epochs, percent):
    rng = np.random.default_rng(epochs * percent)
    rows = [(int(k), " ".join(["w"] * int(rng.integers(0, 40))), f"l{rng.integers(0, 2)}", f"s{min(int(rng.integers(0, 9)), 5)}", int(rng.integers(0, 2))) for k in range(400)]
    rows += [(1000, None, None, "s1", 0), (1000, None, None, "s1", 0), (1001, "a b c", "l0", None, 1), (1001, "a b c", "l0", None, 1), (None, "x y", "l1", "s2", 0)]
    df = spark.createDataFrame([(*r, 9, "c", "b") for r in rows], "doc_id long, text string, lang string, source string, dom int, tokens long, budget string, bucket string")
    plan = mixing.MixPlan(("domain", "lang", "source"), {"1": 3, "*/l1": 2, "*/s4": 0, "0/l0/s1": 5}, 1, percent, epochs, 11)
    got = mixing.mix(df, plan, Workspace(spark, "t"), labels={"domain": F.col("dom"), "lang": F.col("lang"), "source": F.col("source")}).collect()
    leaf = lambda r: (str(r[4]), r[2] or "unknown", r[3] or "unknown")
    tokens = collections.Counter()
    for r in rows:
        tokens[leaf(r)] += len((r[1] or "").split())
    total = sum(tokens.values())
    leaves = {leaf(r) for r in rows}
    budget = min(total * percent // 100, total * epochs)
    allocated = brute_allocation({p: tokens[p] * epochs for p in leaves}, dict(plan.weights), 1, budget, 3)
    expected = collections.Counter()
    for p in leaves:
        whole, rest = divmod(allocated[p], tokens[p]) if tokens[p] else (0, 0)
        order = collections.defaultdict(list)
        for r in rows:
            if leaf(r) == p:
                for e in range(whole):
                    expected[r[0], e] += 1
                order[hashlib.md5(f"11:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0].append(r)
        used = 0
        for key in sorted(order):
            if used >= rest:
                break
            for r in order[key]:
                expected[r[0], whole] += 1
            used += sum(len((r[1] or "").split()) for r in order[key])
    assert collections.Counter((r.doc_id, r.epoch) for r in got) == expected
    assert all((r.tokens, r.budget, r.bucket) == (9, "c", "b") for r in got)
    assert mixing.mix(df.limit(0), plan, Workspace(spark, "t"), labels={"domain": F.col("dom"), "lang": F.col("lang"), "source": F.col("source")}).count() == 0


# --- rules ------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
    rows = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(rows) - len(set(rows)), len(covered)


def test_weak_supervision(spark):
    rng = np.random.default_rng(2)
    good = [(100 + k, " ".join("".join(rng.choice(list("abcdefghijk"), int(rng.integers(2, 8)))) for _ in range(120))) for k in range(200)]
    bad = [(500 + k, t.replace(" ", "*** ")) for k, (_, t) in enumerate(good[:15])]
    rows = [*TEXTS, *good, *bad]
    got = weak.quality_rules(documents(spark, rows), Workspace(spark, "t")).collect()
    expected = collections.Counter((d, *brute_measures(t)) for d, t in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    kept = {r.doc_id for r in got if r.kept}
    assert {d for d, _ in good} <= kept and not {d for d, _ in bad} & kept
    assert weak.quality_rules(documents(spark, rows).limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("vocabulary", [2, 7, 50])
def test_long_texts_count_repeats_alike(vocabulary):
    words = [b"%d" % w for w in np.random.default_rng(vocabulary).integers(0, vocabulary, 300)]
    for n in (0, 1, 2, 3, 4, 300):
        expected = brute_measures(b" ".join(words[:n]).decode())[4]
        assert weak.repeated_words(words[:n]) == expected and (n < 3 or weak.repeated_words_long(words[:n]) == expected)


def test_em_counts_equal_rows():
    rng = np.random.default_rng(3)
    votes = rng.integers(-1, 2, (500, 4))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    grouped = weak.posterior(patterns, *weak.fit(patterns, counts.astype(float)))[inverse.ravel()]
    assert np.allclose(grouped, weak.posterior(votes, *weak.fit(votes, np.ones(len(votes)))))


# --- lines ------------------------------------------------------------------


def test_line_dedup(spark):
    rows = [(k, f"Home | About\nBody of page {k}\n\nFooter {k % 2}", "h") for k in range(40)]
    rows += [(100 + k, "Home | About\nFooter 0", "h") for k in range(2)] + [(200 + k, f"Home | About\nother {k}", None) for k in range(12)]
    rows += [(300, None, "h"), (301, "", "h"), (302, "\n \n", "h"), (303, "Home | About\nHome | About\nx", "h"), (303, "Home | About\nHome | About\nx", "h"), (400, "Home | About\nq", "g")]
    rows += [(500 + k, f"Menu\nown {k}", "small") for k in range(5)] + [(600, "Same\nx", "two"), (601, "Same\ny", "two")]
    df = documents(spark, rows, "doc_id long, text string, source string").withColumn("_bad", F.lit(1)).withColumn("n", F.lit("n"))
    got = lines.drop_boilerplate(df, Workspace(spark, "t"), host=F.col("source")).collect()
    pages, seen = collections.Counter(), collections.Counter()
    for _, t, h in rows:
        pages[h] += 1
        for x in {x for x in (t or "").split("\n") if WORD.search(x)}:
            seen[h, x] += 1
    expected = []
    for d, t, h in rows:
        every = t.split("\n") if t is not None else []
        kept = [x for x in every if not (WORD.search(x) and seen[h, x] >= lines.AT_LEAST and seen[h, x] > 0.1 * pages[h])]
        expected.append((d, "\n".join(kept) if t is not None else None, len(every), len(every) - len(kept)))
    assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == collections.Counter(expected)
    assert sum(r.n_dropped for r in got) > 90
    assert {(r.doc_id, r.text) for r in got if 100 <= r.doc_id < 102} == {(100, ""), (101, "")}  # boilerplate only
    assert {r.text for r in got if r.source == "small"} == {f"own {k}" for k in range(5)}  # few pages
    assert [r.text for r in got if r.source == "two"] == ["Same\nx", "Same\ny"]  # two pages are chance
    assert lines.drop_boilerplate(df.limit(0), Workspace(spark, "t"), host=F.col("source")).count() == 0


def test_url_host(spark):
    urls = ["http://A.b.example:80/x?y#z", "https://user:pw@c.example", "HTTPS://d.example?q", "no url", "", None]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(lines.url_host(F.col("url")).alias("h")).collect()
    assert [r.h for r in got] == ["a.b.example", "c.example", "d.example", None, None, None]


# --- token files ------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_token_scan(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(tokenscan, "GROUP", 4)
    rng = np.random.default_rng(block)
    files = {"a": [int(x) for x in rng.integers(0, 6, 200)], "b": [5] * 9, "c": [1, 2, 3], "d": [], "e": [5, 1], "f": [1, 5]}
    paths = []
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(np.array(tokens, "<u2").tobytes())
        paths.append((f"file://{tmp_path}/{name}",))
    got = tokenscan.count_tokens(spark.createDataFrame(paths, "path string"), Workspace(spark, "t"), separator=5, dtype="<u2", block_tokens=block).collect()
    expected = []
    for name, tokens in files.items():
        k = n = 0
        for t in tokens:
            if t == 5:
                expected.append((name, k, n, True))
                k, n = k + 1, 0
            else:
                n += 1
        if n:
            expected.append((name, k, n, False))
    assert sorted((r.path.rpartition("/")[2], r.ordinal, r.n_tokens, r.terminated) for r in got) == sorted(expected)


def test_token_files_written(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None), (None, [4]), (1, [1])], "doc_id long, ids array<int>")
    space = Workspace(spark, "t")
    written = space.save(tokenscan.write_token_files(df, space.path("files"), separator=9, dtype="<u2"), "w")
    counted = tokenscan.count_tokens(written.select("path").distinct(), space, separator=9, dtype="<u2")
    got = written.join(counted, ["path", "ordinal"]).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter([(1, 3), (2, 0), (3, 0), (None, 1), (1, 1)])


# --- chunks -----------------------------------------------------------------


def test_chunks_against_definition():
    rng = np.random.default_rng(4)
    for n in (0, 1, 15, 16, 17, 33, 97, 5000):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        ends, at = [], 0
        while at < n:
            end = min(at + cdc.MAX_SIZE, n)
            for c in range(at + cdc.MIN_SIZE, end):
                h = sum(int(cdc.GEAR[data[c - 1 - k]]) << k for k in range(cdc.WINDOW)) & 0xFFFFFFFF
                if h & (cdc.HARD if c < at + cdc.NORMAL_SIZE else cdc.EASY) == 0:
                    end = c
                    break
            ends.append(end)
            at = end
        assert cdc.boundaries(data) == ends


def test_compare_with_next(spark):
    got = cdc.compare_with_next(documents(spark, TEXTS), parts=5).collect()
    order = sorted(TEXTS, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] is not None, (r[1] or "").encode()))
    expected = collections.Counter()
    for k, (d, t) in enumerate(order):
        a, b = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(a)
        edited = a[: n - n // 3] + b[: n // 3]
        x, y, z = (cdc.fingerprint(s.encode()) for s in (a, edited, b))
        expected[d, n, hashlib.sha256(edited.encode()).hexdigest(), cdc.to_text(x), cdc.to_text(y), cdc.likeness(x, y), cdc.likeness(x, z)] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == expected
    assert cdc.compare_with_next(documents(spark, TEXTS).limit(0)).count() == 0
    (one,) = cdc.compare_with_next(documents(spark, TEXTS[:1])).collect()
    assert one.near_next == 1.0


def test_fingerprints_are_shift_resistant(spark):
    a = cdc.fingerprint((PROSE * 1 + "".join(chr(97 + k % 26) * (k % 7) for k in range(500))).encode())
    b = cdc.fingerprint(("inserted " + PROSE * 1 + "".join(chr(97 + k % 26) * (k % 7) for k in range(500))).encode())
    assert cdc.likeness(a, b) > 0.8
    assert (cdc.from_text(cdc.to_text(a)) == a).all() and cdc.to_text(cdc.fingerprint(b"")) == ""
    pairs = spark.createDataFrame([(cdc.to_text(a), cdc.to_text(b)), ("", ""), ("", cdc.to_text(a)), (None, "")], "l string, r string")
    assert [r.likeness for r in cdc.with_likeness(pairs, "l", "r").collect()] == [cdc.likeness(a, b), 1.0, 0.0, None]
    assert {r.fingerprint for r in cdc.fingerprints(documents(spark, [(1, None), (2, "")])).collect()} == {""}


# --- line field -------------------------------------------------------------


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(6)
    pairs = rng.normal(size=(2, 2))
    chains = [rng.normal(size=n) for n in (1, 4, 2, 6)]
    for chain, (m, between, logz) in zip(chains, crf._forward_backward(chains, pairs)):
        n, total, single, double = len(chain), 0.0, np.zeros((len(chain), 2)), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            p = np.exp(sum(chain[k] * y[k] for k in range(n)) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
            total += p
            for k in range(n):
                single[k, y[k]] += p
            for a, b in zip(y, y[1:]):
                double[a, b] += p
        assert np.allclose(m, single / total) and np.allclose(between, double / total) and np.isclose(logz, np.log(total))


def test_line_field(spark):
    rng = np.random.default_rng(7)
    sentence = lambda: " ".join("".join(rng.choice(list("abcdefghijk"), int(rng.integers(2, 8)))) for _ in range(12)).capitalize() + "."
    rows, marks = [], []
    for k in range(300):
        body = [sentence() for _ in range(int(rng.integers(1, 9)))]
        bad = k % 4 == 0
        rows.append((k, "\n".join(x.replace(" ", "### ") if bad else x for x in body)))
        marks.append((k, int(not bad)))
    docs = documents(spark, [*rows, *[r for r in TEXTS if r[0] is None or r[0] > 3], (4000, None)])
    labels = spark.createDataFrame([(*m, 0, "x") for m in marks] + [(5, None, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, _text string")
    field = crf.train(docs, labels)
    scored = crf.score_documents(docs, field, keep=("doc_id", "a.b", "text")).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    truth = dict(marks)
    held = [r for r in scored if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text and "w" not in r.text]
    assert np.mean([(r.score >= 0.3) == bool(truth[r.doc_id]) for r in held]) > 0.95
    assert {r.score for r in scored if r.doc_id == 4000} == {field.share}
    assert crf.train(docs, labels.limit(0)).share == 0.5
    assert crf.score_documents(docs.limit(0), field).count() == 0
