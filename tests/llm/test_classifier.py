"""The byte network: gradients, coverage of whole texts, held-out accuracy, sampling."""

import random
import zlib

import numpy as np
import pytest

from clausemill.llm import classifier, queries
from clausemill.session import load

SMALL = classifier.Shape(chunk=32, step=20, width=4, filters=6, hidden=5, byte_dims=3, steps=30, sample_docs=20)


def test_chunks_cover_every_byte_and_overlap():
    s = SMALL
    for n in [0, 1, 31, 32, 33, 51, 52, 53, 72, 73, 500]:
        text = bytes(i % 250 for i in range(n))
        rows, first = classifier.chunks([b"before" * 20, text, b"after"], s)
        mine = rows[first[1] : first[2]]
        if n < s.chunk:
            assert len(mine) == 1 and mine[0].tolist() == [*text, *[classifier.PAD] * (s.chunk - n)]
            continue
        starts = [min(k * s.step, n - s.chunk) for k in range(len(mine))]
        assert [r.tolist() for r in mine] == [list(text[a : a + s.chunk]) for a in starts]
        assert starts[-1] == n - s.chunk and (np.diff(starts) > 0).all()


def test_gradients_by_differences():
    rnd = np.random.default_rng(1)
    net = classifier.Network.fresh(SMALL)
    net.weights = {k: (v + 0.1 * rnd.standard_normal(v.shape)).astype(np.float64) for k, v in net.weights.items()}
    texts = [bytes(rnd.integers(0, 256, n).astype(np.uint8)) for n in (0, 10, 32, 100, 77)]
    labels, weight = np.array([1.0, 0, 1, 0, 1]), np.ones(5)

    def loss():
        p = net.scores(texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = net.gradients(texts, labels, weight)
    for name, g in grads.items():
        flat = net.weights[name].reshape(-1)
        for i in rnd.integers(0, flat.size, 8):
            keep, eps = flat[i], 1e-5
            flat[i] = keep + eps
            high = loss()
            flat[i] = keep - eps
            low = loss()
            flat[i] = keep
            assert abs((high - low) / (2 * eps) - g.reshape(-1)[i]) < 1e-4, name


def test_a_bad_passage_anywhere_in_a_long_text_counts():
    rnd = random.Random(3)
    words = lambda n: " ".join("".join(rnd.choices("aeioulmnrst", k=rnd.randrange(2, 9))) for _ in range(n))
    good = [words(rnd.randrange(20, 200)) for _ in range(120)]
    bad = [f"{words(rnd.randrange(1, 100))} {'##$$ ' * 30}{words(rnd.randrange(1, 100))}" for _ in range(120)]
    texts = [t.encode() for t in good + bad]
    net = classifier.train(texts, np.repeat([1, 0], 120), classifier.Shape(steps=150))
    long = words(40_000)
    for at in (0, 150_000, len(long)):
        assert net.scores([(long[:at] + " ##$$" * 30 + long[at:]).encode()])[0] < 0.3
    assert net.scores([long.encode()])[0] > 0.5


def test_without_two_classes_scores_are_the_share():
    assert classifier.train([b"a", b"b"], np.array([1, 1]), SMALL, 0.8).scores([b"", b"x" * 99]) == pytest.approx([0.8, 0.8])
    assert classifier.train([], np.array([]), SMALL).scores([b"x"]) == pytest.approx([0.5])


def test_sample_is_bounded_and_whole(spark):
    rows = [(i, f"text {i} " * (i % 7 + 1), 0) for i in range(200)] + [(None, "no id", 0), (3, "again", 1), (500, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4)
    labels = spark.createDataFrame([(i, i % 3 > 0) for i in range(0, 300, 2)] + [(None, True), (8, None), (4, False), (4, True)], "doc_id long, good boolean")
    labels = labels.selectExpr("doc_id", "cast(good as int) label", "'x' text")
    sample, share = classifier.labelled_sample(docs, labels, SMALL)
    assert sample["label"].value_counts().to_dict() == {0: 20, 1: 20}
    known = {i: int(i % 3 > 0) for i in range(0, 200, 2)} | {4: 0}
    assert share == sum(known.values()) / len(known)
    texts = {t: i for i, t, _ in rows}
    assert all(known[texts[t]] == label for label, t in zip(sample["label"], sample["text"]))
    few = classifier.labelled_sample(docs, labels, classifier.Shape(sample_docs=20, sample_bytes=300))[0]
    assert 0 < sum(len(t) for t in few["text"]) <= 300 and set(few["text"]) <= set(sample["text"])


def test_score_of_odd_rows(spark):
    net = classifier.train([b"good text"] * 3 + [b"###"] * 3, np.array([1, 1, 1, 0, 0, 0]), SMALL)
    rows = [(1, None, "a"), (2, "", "b"), (None, "good text", "c"), (4, "漢字 " * 50_000, "d"), (4, "good text", "e"), (4, "good text", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score string")
    name = classifier.score_column(docs)
    got = classifier.score(docs, net).orderBy("quality_score").collect()
    assert [r.quality_score for r in got] == list("abcdee") and all(0 <= r[name] <= 1 for r in got)
    assert got[0][name] == got[1][name] and got[2][name] == got[4][name] == got[5][name]
    assert classifier.score(docs.limit(0), net).count() == 0


def test_op13_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in load(spark, sf, "labels").collect()}
    got = queries.QUERIES["op13_quality_classifier"](spark, sf).collect()
    assert len(got) == load(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    test = [(labels[r.doc_id], r) for r in got if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for label, r in test if label == c] for c in (1, 0))
    pairs = [(g > b) + 0.5 * (g == b) for g in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.95
    assert sum(label == r.predicted for label, r in test) / len(test) > 0.9
