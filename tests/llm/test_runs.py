"""Lyndon arrays and runs next to their definitions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm import queries, runs
from clausemill.session import load
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def random_texts(rnd, n):
    """Lists of small numbers with repeats in them."""
    texts = []
    for _ in range(n):
        k = rnd.choice([1, 2, 2, 3, 5])
        unit = [rnd.randrange(1, k + 1) for _ in range(rnd.randrange(1, 6))]
        text = (unit * rnd.randrange(1, 9))[: rnd.randrange(0, 30)]
        texts.append(text + [rnd.randrange(1, k + 1) for _ in range(rnd.randrange(4))] + unit * rnd.choice([0, 0, 4]))
    return texts


def joined(texts):
    codes = [0]
    for t in texts:
        codes += [*t, 0]
    return np.array(codes)


def test_grouping_gives_lyndon_arrays():
    rnd = random.Random(1)
    for _ in range(300):
        texts = random_texts(rnd, 3)
        codes = joined(texts)
        assert runs.lyndon_lengths(codes)[codes > 0].tolist() == [x for t in texts for x in brute.lyndon_lengths(t)]


@pytest.mark.parametrize("min_length, min_copies", [(6, 4), (2, 2), (3, 3)])
def test_runs_are_all_found(min_length, min_copies):
    rnd = random.Random(2)
    for _ in range(1500):
        texts = random_texts(rnd, 3)
        expected, offset = [], 1
        for t in texts:
            expected += [(s + offset, length, p) for s, length, p in brute.runs(t, min_length, min_copies)]
            offset += len(t) + 1
        assert [tuple(r) for r in runs.runs_of(joined(texts), min_length, min_copies).tolist()] == expected


def test_words_that_no_run_holds_are_not_grouped():
    codes = joined([[1, 2, 3, 4, 5, 6, 7], [1, 2, 1, 2, 1, 2, 1, 2, 9], [7, 7, 7, 7]])
    assert runs.eligible(codes, 6, 4).tolist() == joined([[0] * 7, [1, 2, 1, 2, 1, 2, 1, 2, 0], [0] * 4]).tolist()


def test_common_extension():
    codes = np.array([0, 5] + [1, 2] * 100 + [3, 0])
    assert runs.common_extension(codes, 2, 4, 1) == 198
    assert runs.common_extension(codes, 199, 201, -1) == 198


def test_periodic_runs(spark):
    rnd = random.Random(3)
    texts = [None, "", " \t\n ", "a", "a " * 7, "A a " * 7, "b\tb\x0bb\x0cb\rb\nb", "x y z " * 4 + "x", "p q " * 20_000, "é\xa0ß " * 6, "u v u v u v u v " * 2 + "w w w w w w"]
    texts += [" ".join(map(str, t)) for t in random_texts(rnd, 200)] + [" ".join(str(rnd.randrange(9)) for _ in range(3000))]
    rows = [(i, t, "old", 1) for i, t in enumerate(texts)] + [(None, "k " * 9, "old", 2), (4, texts[4], "old", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, periodic_runs string, starts int").repartition(3)
    name = runs.runs_column(docs)
    assert name == "_periodic_runs"
    found = runs.periodic_runs(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        words = brute.words_of(r.text)
        expected = [(0, 40_000, 2)] if len(words) == 40_000 else brute.runs(words, 6, 4)
        assert [tuple(x) for x in r[name].runs] == expected
        assert r[name].n_words == len(words) and r[name].collapsed == brute.collapsed(words, expected)
        assert r.periodic_runs == "old"
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_strongest_run_is_exact_and_the_first(spark):
    a = [(0, 7, 3), (5, 14, 6), (30, 8, 2)]  # 14/6 = 7/3 < 8/2
    df = spark.createDataFrame([(a[:2],), (a,), ([],), ([(3, 8, 2), (1, 4, 1)],)], "r array<struct<start:long,length:long,period:long>>")
    best = [r[0] and tuple(r[0]) for r in df.select(runs.strongest(F.col("r"))).collect()]
    assert best == [(0, 7, 3), (30, 8, 2), None, (3, 8, 2)]


def test_op11(spark):
    texts = {r.doc_id: r.text for r in load(spark, SF, "documents").collect()}
    echoes = 0
    for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect():
        words = brute.words_of(texts[r.doc_id])
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if n > 1500:
            continue
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            echoes += 1
        found = brute.runs(words, 6, 4)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else (None, None, None)
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
        milli = 1000 * best[1] // best[2] if found else None
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (lines, brute.collapsed(words, found)))
        assert tuple(r) == (r.doc_id, len(found), *best, milli, *digests)
    assert echoes > 5
