"""The training-data operators next to plain versions, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import os
import random
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clausemill.llm import (
    decontaminate, graph, line_dedup, near_dedup, packing, quality, queries, records, sharding, suffix_dedup, tokens, url_filter, warc,
)
from clausemill.session import load
from tests.llm import brute

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars int, key string, label string, digest string, id string, bands string, spans string"


def edited(rnd, text, times):
    w = text.split(" ")
    for _ in range(times):
        w[rnd.randrange(len(w))] = f"edit{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows(spark):
    """Some given documents, edge cases, copies, edited copies and shared passages."""
    rnd = random.Random(5)
    docs = [(r.doc_id, r.text) for r in load(spark, SF, "documents").orderBy("doc_id").limit(90).collect()]
    items = [r.text for r in load(spark, SF, "benchmark").orderBy("item_id").collect()]
    long_docs = [t for _, t in docs if len(t.split()) > 150]
    passage = " ".join(f"pass{i}" for i in range(60))
    n = 1000
    extra = [None, "", "  \n\t ", "one two", "one two", "one two three four five", "a\nb\na\nb\na\nb", "x" * 5000, "ab" * 1500, "ñß漢字 " * 300, "\n".join(["same line here"] * 40)]
    extra += [edited(rnd, long_docs[k % len(long_docs)], 1 + k % 3) for k in range(30)]
    extra += [f"{edited(rnd, long_docs[k], 60)} {passage} {edited(rnd, long_docs[k + 1], 60)}" for k in range(6)]
    extra += [edited(rnd, long_docs[3], 40) + " " + edited(rnd, items[0], 2) + " tail words", items[1], items[2].upper(), " ".join(items[3].split()[:9])]
    extra += [long_docs[0] + "\n" + "\n".join(f"line {i} of a shared block" for i in range(30)) + "\n" + long_docs[1],
              "\n".join(f"line {i} of a shared block" for i in range(30)), "first\n" + "\n".join(f"line {i} of a shared block" for i in range(30))]
    extra += [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(50)) for _ in range(30_000))]
    docs += [(n + i, t) for i, t in enumerate(extra)]
    docs += [docs[3], docs[3], (None, docs[5][1]), (None, "a text without an id that has quite a few words of its own")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", f"src{(d or 0) % 7}", 0, "k", "l", "d", "i", "b", "s") for d, t in docs], DOCS).repartition(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_cut_like_the_tokenizer():
    rnd = random.Random(2)
    alphabet = " \n\t\x0b\x85\xa0 ab'sS.,!é1٢ǅ́ßﬁſİΣ\x1c<|endoftext|>漢"
    for path, parts in ((BYTE_BPE, tokens.BYTE_LEVEL_PARTS), (WORD_BPE, tokens.WORD_PARTS)):
        e = tokens.Encoder(path, parts, words_kept=50)
        texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(25))) for _ in range(4000)]
        for text, data in zip(texts, e.encode(texts)):
            assert tokens.ids_of(data).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(docs, rows):
    packed = packing.pack(docs, BYTE_BPE)
    got = packed.pieces.join(packed.places, "piece_key").collect()
    assert len({r.piece_key for r in got}) == len(got) == packed.pieces.count()
    sequences = defaultdict(list)
    for r in got:
        assert r.length * 4 == len(r.ids) and 0 < r.length <= 1024
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    whole = sorted((tuple([*brute.token_ids(BYTE_BPE, t), 2]), -1 if d is None else d) for d, t in rows)
    starts = defaultdict(list)
    for r in got:
        starts[r.doc_id, r.piece].append(r)
    rebuilt = []
    for r in (x for x in got if x.piece == 0):
        if len(starts[r.doc_id, 0]) == 1:
            pieces = [starts[r.doc_id, k][0] for k in range(len([1 for d, _ in starts if d == r.doc_id]))]
            assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
            assert all(p.length == 1024 for p in pieces[1:])
            rebuilt.append((tuple(np.concatenate([tokens.ids_of(p.ids) for p in pieces]).tolist()), r.doc_id))
    assert set(rebuilt) <= set(whole) and len(rebuilt) > 100
    assert sum(r.length for r in got) == sum(len(w) for w, _ in whole)
    assert len(sequences) <= 1.03 * sum(r.length for r in got) / 1024 + 1
    assert {len(r.ids) // 4 for r in packed.sequences().collect()} <= set(range(1, 1025))


def test_packing_in_groups_and_of_nothing(docs, empty):
    kept = packing.pack(docs, BYTE_BPE, pieces_per_group=20)
    got = kept.pieces.join(kept.places, "piece_key").groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 1024 for r in got)
    assert packing.packed_rows(empty, BYTE_BPE).count() == 0


def test_sum_of_squares_prefers_the_rarer_gap():
    bins, offsets = packing.sum_of_squares(np.array([6, 6, 5, 4]), 10)
    assert bins.tolist() == [0, 1, 2, 1] and offsets.tolist() == [0, 0, 0, 6]


def test_near_duplicates(docs, rows, empty):
    got = sorted(((r.doc_id is None, r.doc_id or 0), (r.class_id is None, r.class_id or 0)) for r in near_dedup.near_duplicates(docs).collect())
    want, roots = brute.near_classes(rows)
    assert got == sorted(((d is None, d or 0), (w is None, w or 0)) for (d, _), w in zip(rows, want))
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((w is None, w or 0) for w in {r: w for r, w in zip(roots, want)}.values())
    assert near_dedup.near_duplicates(empty).count() == near_dedup.near_dedup(empty).count() == 0


def test_signatures_are_unbiased():
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 6, 400), rnd.integers(0, 6, 400)
    value = near_dedup._mix(np.arange(400, dtype=np.uint64) + np.uint64(77))
    bags = [(i, value[w > 0], w[w > 0]) for i, w in enumerate((a, b))]
    doc = np.concatenate([np.full(len(v), i) for i, v, _ in bags])
    s = near_dedup.signatures(doc, np.concatenate([v for _, v, _ in bags]), np.concatenate([w for _, _, w in bags]), 2, 8000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_pivots_lose_no_link(spark, monkeypatch):
    """One bucket whose texts are similar in a chain, so that no pivot is like all of them."""
    base = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(base[i * 6 : i * 6 + 120])) for i in range(12)]
    signed = near_dedup._signed(spark.createDataFrame(texts, "doc_id long, text string"), near_dedup.Bands()).collect()
    of = {r.digest: r for r in signed}
    key = {i: hashlib.md5(t.encode()).hexdigest() for i, t in texts}
    assert any(of[key[0]].bands[k] == of[key[1]].bands[k] for k in range(48))
    # All twelve in each of the buckets that any two of them share.
    members = spark.createDataFrame([(k, k, 12, i, 116) for k in range(48) for i, _ in texts], "bucket long, band int, n long, id long, weight long")
    marks = spark.createDataFrame([(i, of[key[i]].marks) for i, _ in texts], "id long, marks binary")
    for block, weight in ((near_dedup.BLOCK, near_dedup.BLOCK_WEIGHT), (3, 10_000), (1_000, 400)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "BLOCK_WEIGHT", weight)
        links = near_dedup.links_of(members, spark.createDataFrame(texts, "id long, text string"), marks)
        labels = {r.id: r.label for r in graph.components(links).collect()}
        assert labels == {i: 0 for i in range(12)}


def test_blocks_compare_every_pair_that_shares_a_band(spark):
    """Pairs of signatures at 0.8; chance equality of bytes in an earlier band must not hide the band that is shared."""
    bands, n = near_dedup.Bands(), 10_000
    rnd = np.random.default_rng(11)
    a = rnd.random((n, bands.slots))
    b = np.where(rnd.random(a.shape) < 0.8, a, rnd.random(a.shape))
    x, y = near_dedup.band_hashes(a, bands), near_dedup.band_hashes(b, bands)
    p, q = near_dedup._marks(a), near_dedup._marks(b)
    share = (p == q).mean(1)
    expected = (x == y).any(1) & (share - (1 - share) / 255 >= near_dedup.ESTIMATE)
    misled = (p == q).reshape(n, bands.bands, bands.rows).all(2).argmax(1) != (x == y).argmax(1)
    # All pairs that bytes would mislead, and some others.
    chosen = np.flatnonzero(expected & misled).tolist() + np.flatnonzero(expected & ~misled)[:100].tolist()
    assert (expected & misled).sum() > 20
    bag = near_dedup.bags(["one two three four five six"])[0].tobytes()
    members, held = [], []
    for k in chosen:
        for i, marks in ((2 * k, p[k]), (2 * k + 1, q[k])):
            held.append((i, marks.tobytes(), bag))
            members += [(int(x[k, at]), int(at), 2, i, 2, i, 4) for at in np.flatnonzero(x[k] == y[k])]
    rest = spark.createDataFrame(members, "bucket long, band int, n long, id long, weight long, label long, total long")
    held = spark.createDataFrame(held, "id long, marks binary, bag binary").join(near_dedup._places(rest), "id")
    got = sorted((r.a, r.b) for r in near_dedup._likely(rest.join(held, "id"), bands).collect())
    assert got == sorted((2 * k, 2 * k + 1) for k in chosen)


def test_bags_keep_counts():
    texts = ["a b c d e f", "x y", "", " \n", "a b c d e a b c d e a b c d e", "a b c d e f g h"]
    found = near_dedup.bags(texts)
    assert [len(b) for b in found] == [sum(near_dedup._bag(t).values()) for t in texts]
    for a, x in zip(found, texts):
        for b, y in zip(found, texts):
            if len(a) and len(b):
                assert near_dedup._overlaps(a, b) == (near_dedup.similarity(x, y) >= near_dedup.SIMILARITY)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(150)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_decontamination(spark, docs, rows, empty):
    bench = load(spark, SF, "benchmark").select("item_id", "text", F.lit("x").alias("key"))
    bench = bench.union(spark.createDataFrame([(None, None, "x"), (900, "", "x"), (901, "too short", "x")], bench.schema)).cache()
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    want = {(d, i) for d, t in set(rows) for i, b in items if brute.is_leak(t, b)}
    assert got == want and len(want) >= 3
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    bad = {t or "" for d, t in rows if any(brute.is_leak(t, b) for _, b in items)}
    assert sorted(r.text or "" for r in left.collect()) == sorted(t or "" for _, t in rows if (t or "") not in bad)
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_plan_is_native(spark, docs):
    plan = decontaminate.leaks(docs.select("doc_id", "text"), load(spark, SF, "benchmark"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("sample, class_rows", [("content", 200_000), ("cover", 200_000), ("content", 2)])
def test_suffix_dedup(docs, rows, sample, class_rows):
    small = docs.filter(F.length("text") < 100_000) if sample == "cover" or class_rows == 2 else docs
    chosen = [(d, t) for d, t in rows if t is None or len(t) < 100_000] if small is not docs else rows
    chosen = [(d, t) for d, t in chosen if t is not None or small is docs]
    got = []
    for r in suffix_dedup.suffix_dedup(small, sample, class_rows).collect():
        got.append(((r.doc_id is None, r.doc_id or 0), (r.n_bytes, sum(s["last"] - s["first"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())))
    want = brute.repeated_bytes([t for _, t in chosen])
    assert sorted(got) == sorted(((d is None, d or 0), w) for (d, _), w in zip(chosen, want))


def test_difference_cover():
    cover = suffix_dedup.difference_cover(suffix_dedup.PERIOD)
    assert {(a - b) % suffix_dedup.PERIOD for a in cover for b in cover} == set(range(suffix_dedup.PERIOD))


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_url_parts_and_rules(spark):
    cases = [
        (None, "", "", None), ("no scheme", "", "", None), ("http://A.NET/x?y#z", "a.net", "/x", "net/"), ("http://a.net", "a.net", "", None),
        ("x://www.example.net/en/1", "www.example.net", "/en/1", "example.net/en/"), ("http://example.net/enx", "example.net", "/enx", "net/"),
        ("http://badexample.com/de/", "badexample.com", "/de/", None), ("http://example.com/de/", "example.com", "/de/", "example.com/de/"),
        ("http://h.org/fr/a/?q=://b", "h.org", "/fr/a/", "org/fr/"), ("http://?x", "", "", None), ("://É.NET/", "É.net", "/", "net/"), ("a://b://c/d", "b:", "//c/d", None),
    ]
    rules = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
    df = spark.createDataFrame([(i, c[0], None) for i, c in enumerate(cases)], "page_id long, url string, good boolean")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.url_verdicts(df, rules).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert url_filter.url_verdicts(df.limit(0), rules).count() == 0


def test_url_templates(spark):
    rows = [(i, f"http://a.com/blog/post-{i}", True) for i in range(40)] + [(100 + i, f"http://a.com/spam/x{i}.html", False) for i in range(40)]
    rows += [(200 + i, f"http://b.com/{w}/p", None) for i, w in enumerate(f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop")]
    rows += [(300 + i, f"http://c.com/{'/'.join('abcdefghijkl')}/{i}", i % 2 == 0) for i in range(4)] + [(400, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    got = {r.page_id: r for r in url_filter.url_verdicts(df, ()).collect()}
    assert len(got) == len(rows)
    assert {got[i].verdict for i in range(40)} == {"allow"} and {got[100 + i].verdict for i in range(40)} == {"block"}
    assert {got[i].template for i in range(40)} == {"/blog/post-*"}
    assert {got[200 + i].template for i in range(64)} == {"/*/p"}
    assert got[300].template == "/a/b/c/d/e/f/g/**"
    # Shares by hand: 10 labelled pages' worth of the overall share.
    overall = 42 / 84
    assert abs(got[0].share - (40 + 10 * overall) / 50) < 1e-9 and abs(got[100].share - 10 * overall / 50) < 1e-9


def test_line_dedup(docs, rows, empty):
    got = line_dedup.line_dedup(docs)
    assert got.columns == docs.columns
    want = brute.line_dedup(rows)
    key = lambda d, t: (d is None, d or 0, t is None, t or "")
    assert sorted(key(r.doc_id, r.text) for r in got.collect()) == sorted(key(d, w) for (d, _), w in zip(rows, want))
    assert any(t != w for (_, t), w in zip(rows, want))
    assert line_dedup.line_dedup(empty).count() == 0


def test_run_dedup_finds_all_equal_runs(spark, empty):
    rnd = random.Random(8)
    passages = [[f"passage {p} line {i}" if i % 4 or rnd.random() < 0.5 else rnd.choice(["", " \t"]) for i in range(n)] for p, n in enumerate((1, 2, 2, 3, 4, 5, 9))]
    texts = []
    for d in range(60):
        lines = []
        for k in range(rnd.randrange(1, 4)):
            lines += [f"own line {d} {k} {i}" if rnd.random() < 0.7 else "" for i in range(rnd.randrange(3))] + rnd.choice(passages)
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "same\nsame\nsame\nsame\nsame", "a\nb\na\nb\na", "a\n\na\n\na\n\na\n\n", "\n\nx\ny\n\n", "z\n\nx\ny\n\n\n", "x\ny", "ñ\r\n漢\r", "q\nñ\r\n漢\r"]
    rows = [(d, t) for d, t in enumerate(texts)] + [(None, texts[4]), (None, texts[9]), (3, texts[3])]
    got = line_dedup.run_dedup(frame(spark, rows))
    key = lambda d, t: (d is None, d or 0, t is None, t or "")
    want = brute.run_dedup(rows)
    assert sorted(key(r.doc_id, r.text) for r in got.collect()) == sorted(key(d, w) for (d, _), w in zip(rows, want))
    # What the comparison of whole chunks leaves.
    assert sum(map(len, filter(None, want))) < sum(map(len, filter(None, brute.line_dedup(rows))))
    assert line_dedup.run_dedup(empty).count() == 0


def test_op6_removes_a_short_passage_between_other_lines(spark, tmp_path):
    shared = "the first shared line\nthe second shared line"
    texts = [f"head {d}\n{shared}\ntail {d}" for d in range(20)]
    spark.createDataFrame([(d, t, len(t)) for d, t in enumerate(texts)], "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_chars for r in queries.QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {d: len(t) if d == 0 else len(t) - len(shared) - 1 for d, t in enumerate(texts)}


def test_records(spark, docs, rows, empty):
    folder = tempfile.mkdtemp(prefix="run-")
    records.write(docs, folder, WORD_BPE)
    index = records.index(spark, folder)
    got = records.read(index, folder).orderBy("start").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    at = 0
    for r, (d, t) in zip(got, sorted(rows, key=key), strict=True):
        ids = [*brute.token_ids(WORD_BPE, t), 1]
        assert (r.doc_id, r.start, r.n_tokens, tokens.ids_of(r.ids).tolist()) == (d, at, len(ids), ids)
        at += len(ids)
    shuffled = records.read(index.orderBy(F.rand(1)).limit(40), folder).collect()
    assert len(shuffled) == 40 and {(r.start, r.ids) for r in shuffled} <= {(r.start, r.ids) for r in got}
    file = index.orderBy("file", "offset").first()
    with open(f"{folder}/{file.file}", "rb") as f:
        data = f.read()
    n = int.from_bytes(data[:8], "little")
    assert int.from_bytes(data[8:12], "little") == brute.masked(data[:8])
    assert int.from_bytes(data[12 + n : 16 + n], "little") == brute.masked(data[12 : 12 + n])
    with pytest.raises(ValueError):
        records.unframe(data[:12] + bytes([data[12] ^ 1]) + data[13:], [0], records.Checksums())
    none = tempfile.mkdtemp(prefix="run-")
    records.write(empty, none, WORD_BPE)
    assert records.read(records.index(spark, none), none).count() == 0


def test_checksums():
    sums, rnd = records.Checksums(), random.Random(4)
    data = [rnd.randbytes(n) for n in (0, 1, 2, 3, 4, 6, 7, 126, 128, 130, 1000, 4098, 256, 128)] + [b"123456789"]
    assert sums.crc(data).tolist() == [brute.crc32c(d) for d in data] and sums.crc(data)[-1] == 0xE3069283


def test_quality(docs, rows, empty):
    name = quality.verdict_column(docs)
    got = quality.quality_rules(docs).select("doc_id", "source", f"{name}.*").collect()
    want = brute.quality([t for _, t in rows])
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r.doc_id or -1, *(r[f] for f in fields)) for r in got) == sorted((d or -1, *w) for (d, _), w in zip(rows, want))
    hosts = defaultdict(list)
    for r in got:
        hosts[r.source].append(r.base_failed)
    a, b = quality.prior(len(hosts), len(got), sum(map(sum, hosts.values())), sum(len(h) * (sum(h) / len(h)) ** 2 for h in hosts.values()))
    for r in got:
        rate = (sum(hosts[r.source]) + a) / (len(hosts[r.source]) + a + b)
        assert abs(rate - r.host_rate) < 1e-9 and r.kept == (not r.base_failed and rate <= 0.5)
    assert quality.quality_rules(empty).count() == 0


def test_bad_hosts_go_and_small_ones_do_not(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "too short"
    rows = [(i, good, f"h{i % 20}") for i in range(2000)] + [(5000 + i, bad if i % 10 else good, "junk") for i in range(100)] + [(9000, good, None), (9001, bad, "tiny"), (9002, good, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.quality_rules(df).filter("quality_verdict.kept").collect()}
    assert kept == set(range(2000)) | {9000, 9002}


@pytest.mark.parametrize("limit", [3_000, 60_000, 10**9])
def test_shards(spark, docs, rows, empty, limit):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.shard, r.shard_bytes) for r in sharding.shards(docs, limit).collect())
    want = brute.shard_of(rows, limit)
    assert got == sorted((d is None, d or 0, len((t or "").encode()), *want[i]) for i, (d, t) in enumerate(rows))
    assert sharding.shards(empty, limit).count() == 0
    if limit == 60_000:
        folder = tempfile.mkdtemp(prefix="run-") + "/shards"
        sharding.write_shards(docs, limit, folder)
        back = spark.read.parquet(folder)
        assert back.count() == len(rows) and set(docs.columns) < set(back.columns)
        assert set(os.listdir(folder)) >= {f"shard_name={p or 'root'}" for p, _ in want.values()}


def test_op9_reads_what_it_wrote(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="run-")
    monkeypatch.setattr(queries, "shared_folder", lambda spark, name: folder)
    monkeypatch.setattr(queries, "SHARD_BYTES", 60_000)
    got = sorted(map(tuple, queries.QUERIES["op9_extendible_sharding"](spark, SF).collect()))
    documents = load(spark, SF, "documents")
    assert got == sorted(map(tuple, sharding.shards(documents, 60_000).collect())) and len({r[2] for r in got}) > 4
    assert spark.read.parquet(f"{folder}/shards").count() == documents.count()


def test_warc(spark):
    rnd = random.Random(7)
    same = "copy " * 400
    rows = [(i, f"http://h/{i}?q=é ü", rnd.choice([same, "short", None, "", f"page {i} " * rnd.randrange(1, 900)]), "x") for i in range(120)]
    rows += [(None, None, same, "x"), rows[-1], (500, "http://a/\r\nX: y", same, "x"), (500, "http://b", same, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    folder = tempfile.mkdtemp(prefix="run-")
    warc.write(warc.typed(pages), folder, file_bytes=4_000)
    manifest = spark.read.parquet(f"{folder}/manifest")
    want = []
    for p, _, h, _ in rows:
        data = (h or "").encode()
        last = max((q for q, _, g, _ in rows if g == h and q is not None), default=None) if len(data) >= 1000 else None
        revisit = last is not None and last != p
        want.append((p is None, p or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else -1))
    for split in (97, 1_000, 10**9):
        got = warc.read(manifest, folder, split).collect()
        assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == sorted(want)
        assert all(r.payload is None if r.record_type == "revisit" else hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    none = tempfile.mkdtemp(prefix="run-")
    warc.write(warc.typed(pages.limit(0)), none)
    assert warc.read(spark.read.schema("file string, bytes long").parquet(f"{none}/manifest"), none).count() == 0


def test_warc_reader_skips_magic_that_starts_no_record():
    class Source:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at : at + n]

    good = [warc.record(i, "http://h", bytes([i]) * 3000, "d", "response", None) for i in range(4)]
    fake = warc.MAGIC + b"\x00" * 40 + zlib.compress(b"x") + warc.MAGIC
    data = fake + good[0] + good[1] + fake + good[2] + good[3]
    for step in (13, 100, 10_000):
        found = [c for a in range(0, len(data), step) for c in warc.members(Source(data), a, a + step, len(data))]
        assert [warc.parse(c)[0]["WARC-Record-ID"] for c in found] == [f"<urn:page:{i}>" for i in range(4)]
