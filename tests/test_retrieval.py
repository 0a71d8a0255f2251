"""Retrieval and cache replay against brute force, on the block path as well."""

import math
import random
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.functions.terms import tokenize
from clausemill.operators import cache as C, ingest as I, matching as X, postings, retrieval as R

rng = random.Random(3)
WORDS = [f"w{i}" for i in range(40)] + ["等待期", "既往症", "the"]
TEXTS = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40)))) for i in range(120)]
QUERIES = [(i, " ".join(rng.choice(WORDS) for _ in range(4))) for i in range(9)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(TEXTS, "chunk long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string")


def _best(scores, k):
    return sorted(((-round(s, 9), c) for c, s in scores if s is not None))[:k]


def _found(df, key="chunk"):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r[key], round(r.score, 6)))
    return {q: [(c, s) for _, c, s in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("max_queries", [100, 4])
def test_string_match(corpus, asked, max_queries):
    found = _found(R.string_match_topk(corpus, "chunk", "text", asked, "query", 7, max_queries=max_queries, rows_per_slice=30))
    for qid, q in QUERIES:
        scores = []
        for c, t in TEXTS:
            s = sum(ch in t for ch in q) + 3 * sum(q[i : i + 2] in t for i in range(len(q) - 1))
            scores.append((c, s or None))
        assert found[qid] == [(c, -s) for s, c in _best(scores, 7)]


@pytest.mark.parametrize("slice_chunks, query_terms", [(8192, 50_000), (10, 50_000), (3, 8)])
def test_bm25(corpus, asked, slice_chunks, query_terms, tmp_path):
    index = R.build_index(corpus, "chunk", "text", str(tmp_path / "index"), slice_chunks)
    found = _found(R.bm25_topk(index, "chunk", asked, "query", 7, query_terms))
    docs = {c: Counter(t.split()) for c, t in TEXTS}
    n, mean = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = Counter(t for d in docs.values() for t in d)
    raw = {t: math.log((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else floor for t, v in raw.items()}
    for qid, q in QUERIES:
        scores = []
        for c, d in docs.items():
            terms = [t for t in q.split() if t in d]
            length = sum(d.values())
            s = sum(idf[t] * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * length / mean)) for t in terms)
            scores.append((c, s if terms else None))
        want = [(c, round(-s, 6)) for s, c in _best(scores, 7)]
        assert [c for c, _ in found[qid]] == [c for c, _ in want]
        assert np.allclose([s for _, s in found[qid]], [s for _, s in want], atol=1e-6)


@pytest.mark.parametrize("max_queries", [100, 3])
def test_vectors(spark, max_queries):
    gen = np.random.default_rng(5)
    base = gen.normal(size=(300, 16)).round(3)
    base[200:] = base[:100]  # exact copies: ties go to the lower key
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "chunk long, v array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base[:8])], "query_id long, q array<float>")
    found = _found(R.vector_topk(rows, "chunk", "v", asked, "q", 5, max_queries=max_queries, rows_per_slice=64))
    as_stored = base.astype(np.float32).astype(np.float64)
    for i in range(8):
        d = ((as_stored - as_stored[i]) ** 2).sum(1).round(9)
        want = np.lexsort((np.arange(len(d)), d))[:5]
        assert [c for c, _ in found[i]] == want.tolist()


def test_bm25_skips_slices(spark, tmp_path):
    """With rare terms in few chunks, slices that can't reach a query's bar are left out and nothing is lost."""
    gen = random.Random(8)
    texts = [(i, " ".join([f"c{gen.randrange(30)}" for _ in range(gen.choice([5, 20, 80]))] + [f"rare{i % 50}"] * (i % 3 == 0))) for i in range(900)]
    asked = spark.createDataFrame([(q, f"c{q} c{q + 1} rare{q}") for q in range(20)], "query_id long, query string")
    index = R.build_index(spark.createDataFrame(texts, "chunk long, text string"), "chunk", "text", str(tmp_path / "many"), 20)
    whole = R.build_index(spark.createDataFrame(texts, "chunk long, text string"), "chunk", "text", str(tmp_path / "one"), 10**6)
    assert _found(R.bm25_topk(index, "chunk", asked, "query", 5)) == _found(R.bm25_topk(whole, "chunk", asked, "query", 5))
    rows = postings.asked_terms(index, asked, "query")
    block, terms = postings._Asked.of(rows.orderBy("query_id", "term").toPandas())
    codes = spark.createDataFrame(list(zip(terms, range(len(terms)))), "term string, code long")
    mine = index.postings.join(codes, "term")
    bars = postings.bar_rows(rows, mine, block, 5)
    assert len(bars) == 20
    bounds = mine.join(rows, "term").groupBy("query_id", "slice").agg(F.sum(F.col("w") * F.col("top")).alias("bound")).collect()
    assert sum(r.bound < bars[r.query_id] for r in bounds) > len(bounds) / 4


def test_index_counts_every_chunk(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "b ..."), (5, "x " * 70_000)], "chunk long, text string")
    index = R.build_index(chunks, "chunk", "text", str(tmp_path / "index"), 1)
    assert (index.n, index.mean_len) == (5, 70_004 / 5)
    assert {(r.term, r.df, r.cf) for r in index.terms.collect()} == {("a", 1, 2), ("b", 2, 2), ("x", 1, 70_000)}
    empty = R.build_index(chunks.limit(0), "chunk", "text", str(tmp_path / "empty"))
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert empty.n == 0 and R.bm25_topk(empty, "chunk", asked, "query").collect() == []


def test_fusion_invariants(corpus, asked, tmp_path):
    arms = R.hits(R.string_match_topk(corpus, "chunk", "text", asked, "query", 20), "chunk", "string_match").unionByName(
        R.hits(R.bm25_topk(R.build_index(corpus, "chunk", "text", str(tmp_path / "index")), "chunk", asked, "query", 20), "chunk", "bm25")
    )
    rows = R.fuse_priority(arms).collect()
    assert len({(r.query_id, r.chunk) for r in rows}) == len(rows)
    assert all(r.sources and r.sources[0] == r.arm and set(r.sources) <= {"bm25", "string_match"} for r in rows)
    pairs = {(r.query_id, r.chunk) for r in arms.collect()}
    assert pairs == {(r.query_id, r.chunk) for r in rows}


@pytest.mark.parametrize("chunk_ttls", [1, 3, 16])
def test_cache_replay(spark, chunk_ttls):
    ttl = 50
    gen = random.Random(chunk_ttls)
    log = [("hot" if gen.random() < 0.6 else f"k{gen.randint(0, 9)}", gen.randint(0, 4000)) for _ in range(1500)]
    got = C.query_cache(spark.createDataFrame(log, "key string, ts long"), "key", "ts", ttl, chunk_ttls).collect()
    want, anchor = [], {}
    for k, t in sorted(log, key=lambda x: x[1]):
        hit = k in anchor and t - anchor[k] <= ttl
        if not hit:
            anchor[k] = t
        want.append((k, t, hit))
    # Rows of one key and time may swap places; their hits and misses may not.
    assert Counter((r.key, r.ts, r.hit) for r in got) == Counter(want)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_contains_pairs(spark, monkeypatch, broadcast):
    monkeypatch.setattr(X, "BROADCAST_NEEDLES", broadcast)
    rows = TEXTS + [(500, None), (501, ""), (502, "w1"), (503, "𝒳𝒴 aaaaaaaaaaaa"), (503, "a second row of the key"), (None, "w1 no key")]
    texts = spark.createDataFrame(rows, "id long, body string")
    needles = ["w1", "w12", "the", "w3 w", "absent", "等待期", "w1 w", "", "w1", "𝒴 a", "𝒳", "aaaaaaaaa", "second row of", "w", None]
    found = X.contains_pairs(texts, "id", "body", spark.createDataFrame([(n,) for n in needles], "needle string"), "needle")
    want = [(i, t, n) for i, t in rows for n in set(needles) if i is not None and t and n and n in t]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    none = spark.createDataFrame([("",)], "needle string")
    assert X.contains_pairs(texts, "id", "body", none, "needle").collect() == []


def test_a_hundred_thousand_needles(spark):
    """Numbered keys, all with the same beginning and end: the anchor is the part where they differ."""
    needles = spark.range(100_000).select(F.format_string("policy-%06d-key", "id").alias("needle"))
    texts = spark.range(3_000).select("id", F.format_string("{before policy-%06d-key, policy-%06d-key after}", F.col("id") * 7, F.col("id") * 40 + 1).alias("body"))
    found = X.contains_pairs(texts, "id", "body", needles, "needle")
    want = {(i, n) for i in range(3_000) for n in (7 * i, 40 * i + 1) if n < 100_000}
    got = [(r.id, int(r.needle[7:13])) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert X.anchors(needles, "needle").groupBy("_anchor").count().agg(F.max("count")).first()[0] <= 100


def test_large_policy_signature(spark):
    def expected(tokens):
        buckets = {}
        for token in sorted(tokens):
            buckets.setdefault(md5(token.encode()).hexdigest()[:3], []).append(token)
        return md5("|".join(md5("|".join(buckets[k]).encode()).hexdigest() for k in sorted(buckets)).encode()).hexdigest()

    files = [("big", f"f{i}", f"e{i}") for i in range(20_001)] + [("small", "a", "x"), ("small", "b", "y"), ("bare", "c", None), ("bare", "d", "")]
    df = spark.createDataFrame(files, "p string, n string, e string")
    signed = {r.p: (r.n_files, r.signature) for r in I.corpus_signature(df, "p", "n", "e").collect()}
    assert signed == {
        "big": (20_001, expected(f"f{i}:e{i}" for i in range(20_001))), "small": (2, expected(["a:x", "b:y"])),
    }
    assert [tuple(r) for r in I.unsigned_policies(df, "p", "e").collect()] == [("bare", 2)]


def test_no_work_for_topk(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0]), (2, "保险责任", [0.0, 1.0])], "chunk long, text string, v array<double>")
    none = spark.createDataFrame([], "query_id long, q string, v array<double>")
    index = R.build_index(chunks, "chunk", "text", str(tmp_path / "index"))
    assert R.bm25_topk(index, "chunk", none, "q").collect() == []
    assert R.string_match_topk(chunks, "chunk", "text", none, "q").collect() == []
    assert R.vector_topk(chunks, "chunk", "v", none, "v").collect() == []
    assert R.cosine_rank(chunks, "chunk", "v", none, "v").collect() == []
    odd = spark.createDataFrame([(1, ""), (2, None), (3, "zzz")], "query_id long, q string")
    assert R.bm25_topk(index, "chunk", odd, "q").collect() == []
    assert R.string_match_topk(chunks, "chunk", "text", odd.filter("query_id < 3"), "q").collect() == []
    assert R.bm25_topk(index, "chunk", odd, "q", query_terms=1).collect() == []


def test_tokens(spark):
    df = spark.createDataFrame([("保险abc责任免除x1 日本語 éà_ß 12",)], "t string")
    assert df.select(tokenize(F.col("t"))).first()[0] == ["保", "险", "abc", "责任免除", "x1", "日", "本", "語", "éà", "ß", "12"]
