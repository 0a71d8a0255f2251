"""Quality of texts by a small convolutional network over bytes, trained and applied in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Learned byte
vectors and filters give a response at every place of a chunk; the chunk keeps each
filter's greatest one. A dense layer reads which patterns a chunk has and lacks, its
outputs are max-pooled over the text's chunks, and a logistic unit makes one probability
of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from clausemill.llm.common import arrow_batches, free_name, text_of

PAD = 256  # stands after the end of texts shorter than a chunk
ROWS_AT_ONCE = 64  # chunks
CHARS_AT_ONCE = 500_000


@dataclass(frozen=True)
class Shape:
    """Sizes of the network and of its training sample."""

    chunk: int = 256
    step: int = 208
    width: int = 6
    stride: int = 2
    byte_dims: int = 6
    filters: int = 32
    hidden: int = 16
    sample_docs: int = 1_500
    """Labelled documents of each class to learn from, the first ones by a hash of their ids."""
    sample_bytes: int = 8_000_000
    """Documents of the sample beyond this are left out of learning, whole."""
    steps: int = 900
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


@dataclass
class Network:
    shape: Shape
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, shape: Shape) -> Network:
        rnd = np.random.default_rng(shape.seed)
        fan = shape.width * shape.byte_dims

        def normal(scale: float, *size: int) -> np.ndarray:
            return (scale * rnd.standard_normal(size)).astype(np.float32)

        return cls(shape, {
            "byte": normal(0.5, PAD + 1, shape.byte_dims),
            "filter": normal(2 / fan**0.5, fan, shape.filters),
            "filter_bias": np.zeros(shape.filters, dtype=np.float32),
            "dense": normal(shape.filters**-0.5, shape.filters, shape.hidden),
            "dense_bias": np.zeros(shape.hidden, dtype=np.float32),
            "out": normal(0.3, shape.hidden),
            "out_bias": np.zeros(1, dtype=np.float32),
        })

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Vectors of each window of bytes: (chunks, places, width * byte_dims)."""
        s = self.shape
        places = window_places(s)
        return self.weights["byte"][rows[:, places]].reshape(len(rows), len(places), -1)

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, each filter's best place in each chunk and its response there."""
        x = self.windows(rows)
        response = x @ self.weights["filter"]
        place = response.argmax(1)
        return x, place, np.take_along_axis(response, place[:, None], 1)[:, 0] + self.weights["filter_bias"]

    def chunk_outputs(self, rows: np.ndarray) -> np.ndarray:
        """The dense layer's outputs of each chunk; the training path without what only it needs."""
        w, out = self.weights, []
        for lo in range(0, len(rows), ROWS_AT_ONCE):
            # One small product per chunk: it stays in the cache and on the task's one core.
            best = (self.windows(rows[lo : lo + ROWS_AT_ONCE]) @ w["filter"]).max(1)
            out.append(np.maximum(np.maximum(best + w["filter_bias"], 0) @ w["dense"] + w["dense_bias"], 0))
        return np.concatenate(out)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows, first = chunks(texts, self.shape)
        if not len(texts):
            return np.empty(0)
        best = np.maximum.reduceat(self.chunk_outputs(rows), first, axis=0)
        logit = best.astype(np.float64) @ self.weights["out"] + float(self.weights["out_bias"][0])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def gradients(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean logistic loss of a batch."""
        w, s = self.weights, self.shape
        rows, first = chunks(texts, s)
        x, place, best = self.pooled(rows)
        active = np.maximum(best, 0)
        dense = np.maximum(active @ w["dense"] + w["dense_bias"], 0)
        top = np.empty((len(texts), s.hidden), dtype=np.int64)
        for i, (a, b) in enumerate(zip(first, [*first[1:], len(rows)])):
            top[i] = a + dense[a:b].argmax(0)
        h = np.arange(s.hidden)
        doc = dense[top, h]
        p = 1 / (1 + np.exp(-np.clip(doc @ w["out"] + w["out_bias"][0], -30, 30)))
        d_logit = ((p - labels) * weight / weight.sum()).astype(np.float32)
        grads = {"out": doc.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
        d_dense = np.zeros_like(dense)
        np.add.at(d_dense, (top, np.broadcast_to(h, top.shape)), d_logit[:, None] * w["out"])
        d_dense *= dense > 0
        grads["dense"], grads["dense_bias"] = active.T @ d_dense, d_dense.sum(0)
        d_best = (d_dense @ w["dense"].T) * (best > 0)
        grads["filter_bias"] = d_best.sum(0)
        hit = np.take_along_axis(x, place[:, :, None], 1)  # chunk, filter, window vector
        grads["filter"] = np.einsum("cf,cfk->kf", d_best, hit, optimize=True)
        d_hit = d_best[:, :, None] * w["filter"].T[None]
        codes = rows[np.arange(len(rows))[:, None, None], window_places(s)[place]]
        d_byte = d_hit.reshape(-1, s.byte_dims)
        grads["byte"] = np.stack(
            [np.bincount(codes.ravel(), d_byte[:, j], PAD + 1) for j in range(s.byte_dims)], axis=1
        ).astype(np.float32)
        return grads


def window_places(s: Shape) -> np.ndarray:
    """Byte places of each window in a chunk."""
    return np.arange(0, s.chunk - s.width + 1, s.stride)[:, None] + np.arange(s.width)


def chunks(texts: list[bytes], s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Rows of byte codes and each text's first row.

    Every byte of a text is in a chunk: they start ``step`` apart, and the last one ends with
    the text. A text shorter than a chunk is one, filled up with PAD; so is an empty one.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n = 1 + np.maximum(0, -((s.chunk - sizes) // s.step))
    first = np.cumsum(n) - n
    codes = np.full(sizes.sum() + s.chunk, PAD, dtype=np.int16)
    codes[: sizes.sum()] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    k = np.arange(n.sum()) - np.repeat(first, n)
    start = np.repeat(begin, n) + np.minimum(k * s.step, np.repeat(np.maximum(sizes - s.chunk, 0), n))
    rows = codes[start[:, None] + np.arange(s.chunk)]
    short = np.flatnonzero(sizes < s.chunk)
    rows[first[short]] = np.where(np.arange(s.chunk) < sizes[short, None], rows[first[short]], PAD)
    return rows, first


def train(texts: list[bytes], labels: np.ndarray, shape: Shape = Shape(), share: float | None = None) -> Network:
    """A network fitted by Adam steps on balanced batches, its bias then set to the classes' real share.

    ``share`` is the share of label 1 among all labelled rows; the sample's own by default.
    Without both classes to learn from every text scores that share.
    """
    net = Network.fresh(shape)
    labels = np.asarray(labels, dtype=np.float32)
    share = float(labels.mean()) if share is None and len(labels) else 0.5 if share is None else share
    share = min(max(share, 1e-3), 1 - 1e-3)
    by_class = [np.flatnonzero(labels == c) for c in (0, 1)]
    prior = np.float32(np.log(share / (1 - share)))
    if not len(by_class[0]) or not len(by_class[1]):
        net.weights["out"][:] = 0
        net.weights["out_bias"][:] = prior
        return net
    rnd = np.random.default_rng(shape.seed)
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for t in range(1, shape.steps + 1):
        picked = np.concatenate([rnd.choice(c, shape.batch // 2) for c in by_class])
        grads = net.gradients([texts[i] for i in picked], labels[picked], np.ones(len(picked), dtype=np.float32))
        rate = shape.rate * min(1.0, t / 50) * 0.5 * (1 + np.cos(np.pi * t / shape.steps))
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            step = (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-6)
            net.weights[k] = (net.weights[k] - rate * (step + shape.decay * net.weights[k])).astype(np.float32)
    net.weights["out_bias"] = net.weights["out_bias"] + prior
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, shape: Shape, text: str = "text") -> tuple[pd.DataFrame, float]:
    """``(label, text)`` of at most ``sample_docs`` documents per class and ``sample_bytes`` in all, and the share of label 1.

    ``labels`` has rows (doc_id, label); null ids and labels are left out, of several labels
    of an id the least counts, and of several texts of an id the least. Which documents are
    taken depends on a hash of their ids only. The share is counted over all labelled documents.
    """
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull())
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id").agg(F.min(F.col("label").cast("int")).alias("label")).join(ids, "doc_id", "left_semi")
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    first = [known.filter(F.col("label") == c).orderBy(*order).limit(shape.sample_docs) for c in (0, 1)]
    chosen = first[0].unionByName(first[1])  # at most 2 * sample_docs narrow rows
    texts = docs.select("doc_id", text_of(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("label").orderBy(*order))
    rows = texts.withColumn("so_far", so_far).filter(F.col("so_far") <= shape.sample_bytes // 2)
    sample = rows.orderBy(*order).select("label", "text").toPandas()
    total = sum(counts.values())
    return sample, counts.get(1, 0) / total if total else 0.5


def fit(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), text: str = "text") -> Network:
    """A network learned on a bounded sample of the labelled documents (see :func:`labelled_sample`)."""
    sample, share = labelled_sample(docs, labels, shape, text)
    return train([t.encode("utf-8", "replace") for t in sample["text"]], sample["label"].to_numpy(), shape, share)


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1 in a double column named by :func:`score_column`.

    Each row is scored for itself by all of its text: repeated rows get equal scores, null ids and
    extra columns with whatever names need no care, and a null text counts as empty, which is
    scored like any other. No rows give no rows.
    """

    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            done, some, chars = [], [], 0
            for t in texts:
                some.append(t.encode("utf-8", "replace"))
                chars += len(t)
                if chars > CHARS_AT_ONCE:
                    done.append(net.scores(some))
                    some, chars = [], 0
            done.append(net.scores(some))
            yield pd.Series(np.concatenate(done))

    arrow_batches(docs.sparkSession)
    return docs.withColumn(score_column(docs), F.pandas_udf(of, "double")(text_of(text)))


def score_column(docs: DataFrame) -> str:
    return free_name(docs, "quality_score")
