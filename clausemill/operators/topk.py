"""Exact top-k of a corpus for many queries at once.

Every query meets every corpus row, but no pair is ever a row of a shuffle: a task
scores Arrow batches against the query block with numpy and sends on only its own
``k`` best per query. The final ranking sees ``tasks * k`` rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

MAX_QUERIES = 2_000
ROWS_PER_SLICE = 100_000
STEP_BYTES = 4 << 20  # of corpus rows that a task turns into pandas at once
MATRIX_CELLS = 1 << 20  # of one numpy matrix of rows by query grams

# (corpus batch, prepared queries, k) -> score matrix rows x queries, higher is better;
# cells that cannot be among the k best may hold -inf.
Scorer = Callable[[pd.DataFrame, object], np.ndarray]


class _Best:
    """The k best rows per query seen so far by one task; ties go to the lower key."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0) for _ in range(n_queries)]
        self.keys = [np.empty(0, dtype=np.int64) for _ in range(n_queries)]

    def add(self, keys: np.ndarray, matrix: np.ndarray) -> None:
        for q in range(matrix.shape[1]):
            column = matrix[:, q]
            bar = self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf
            take = np.flatnonzero((column >= bar) & (column > -np.inf))
            if not len(take):
                continue
            if len(take) > 4 * self.k:
                kth = np.partition(column[take], len(take) - self.k)[len(take) - self.k]
                take = take[column[take] >= kth]
            scores = np.concatenate([self.scores[q], column[take]])
            ids = np.concatenate([self.keys[q], keys[take]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores[q], self.keys[q] = scores[order], ids[order]

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        sizes = [len(s) for s in self.scores]
        return pd.DataFrame(
            {
                "query_id": np.repeat(query_ids, sizes),
                "key": np.concatenate(self.keys) if self.keys else np.empty(0, dtype=np.int64),
                "score": np.concatenate(self.scores) if self.scores else np.empty(0),
            }
        )


def score_topk(
    corpus: DataFrame,
    key: str,
    payload: str,
    queries: DataFrame,
    query_payload: str,
    prepare: Callable[[pd.DataFrame], object],
    scorer: Scorer,
    k: int,
    max_queries: int = MAX_QUERIES,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``(query_id, key, score, rank)``: the ``k`` best corpus rows of each query, ties by key.

    Up to ``max_queries`` queries travel to the tasks as one block. More are cut
    into blocks, and each task takes one block and one slice of the corpus; the
    answer is the same. Without queries there are no rows.
    """
    spark = corpus.sparkSession
    rows = corpus.select(F.col(key).cast("long").alias("key"), F.col(payload).alias("payload"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(query_payload).alias("payload"))
    head = asked.limit(max_queries + 1).toPandas()  # bounded, and the only run when the queries fit
    schema = "query_id long, key long, score double"
    if head.empty:
        local = spark.createDataFrame([], schema)
    elif len(head) <= max_queries:
        block = spark.sparkContext.broadcast(head.sort_values("query_id", ignore_index=True))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = prepare(block.value)
            best = _Best(len(block.value), k)
            for batch in batches:
                step = max(1, len(batch) * STEP_BYTES // max(1, batch.get_total_buffer_size()))
                for lo in range(0, len(batch), step):
                    some = batch.slice(lo, step).to_pandas()
                    best.add(some["key"].to_numpy(), scorer(some, ready))
            yield pa.RecordBatch.from_pandas(best.frame(block.value["query_id"].to_numpy()), preserve_index=False)

        local = rows.mapInArrow(scan, schema)
    else:
        n_blocks = math.ceil(2 * asked.count() / max_queries)
        n_slices = max(1, math.ceil(2 * rows.count() / rows_per_slice))

        def pair(corpus_part: pd.DataFrame, query_part: pd.DataFrame) -> pd.DataFrame:
            if not len(corpus_part) or not len(query_part):
                return pd.DataFrame({"query_id": [], "key": [], "score": []})
            best = _Best(len(query_part), k)
            best.add(corpus_part["key"].to_numpy(), scorer(corpus_part, prepare(query_part)))
            return best.frame(query_part["query_id"].to_numpy())

        blocks = F.sequence(F.lit(0), F.lit(n_blocks - 1))
        slices = F.sequence(F.lit(0), F.lit(n_slices - 1))
        left = rows.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(n_slices)).cast("int")).withColumn(
            "block", F.explode(blocks)
        )
        right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")).withColumn(
            "slice", F.explode(slices)
        )
        local = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(pair, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def stack_vectors(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64).reshape(len(values), -1)


def l2_scorer(k: int) -> tuple[Callable, Scorer]:
    """Negative squared L2. A matrix product picks candidates, exact differences score them."""

    def prepare(queries: pd.DataFrame) -> np.ndarray:
        return stack_vectors(queries["payload"])

    def scorer(batch: pd.DataFrame, q: np.ndarray) -> np.ndarray:
        x = stack_vectors(batch["payload"])
        square = (x * x).sum(1)[:, None] + (q * q).sum(1)[None, :]
        rough = square - 2.0 * (x @ q.T)
        out = np.full(rough.shape, -np.inf)
        slack = 1e-9 * (1.0 + np.abs(square).max(0))
        for j in range(q.shape[0]):
            near = rough[:, j]
            bar = np.partition(near, k - 1)[k - 1] if len(near) > k else np.inf
            take = np.flatnonzero(near <= bar + slack[j])
            out[take, j] = -np.round(((x[take] - q[j]) ** 2).sum(1), 9)
        return out

    return prepare, scorer


def cosine_scorer() -> tuple[Callable, Scorer]:
    """Cosine similarity; a zero vector is similar to nothing (0)."""

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def prepare(queries: pd.DataFrame) -> np.ndarray:
        return unit(stack_vectors(queries["payload"]))

    def scorer(batch: pd.DataFrame, q: np.ndarray) -> np.ndarray:
        return np.round(unit(stack_vectors(batch["payload"])) @ q.T, 9) + 0.0

    return prepare, scorer


_SHIFT = np.uint64(21)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points and code-point pairs of a text as numbers; pairs are above all single points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return points, ((points[:-1] + np.uint64(1)) << _SHIFT) | points[1:]


def string_match_scorer(char_weight: int = 1, pair_weight: int = 3) -> tuple[Callable, Scorer]:
    """Query positions whose character (weight 1) or character pair (weight 3) occurs in the text."""

    def prepare(queries: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        per_query = [_grams(t or "") for t in queries["payload"]]
        grams = np.unique(np.concatenate([g for pair in per_query for g in pair]))
        weights = np.zeros((len(grams), len(per_query)))
        for j, (points, pairs) in enumerate(per_query):
            np.add.at(weights[:, j], np.searchsorted(grams, points), char_weight)
            np.add.at(weights[:, j], np.searchsorted(grams, pairs), pair_weight)
        return grams, weights

    def scorer(batch: pd.DataFrame, ready: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        grams, weights = ready
        scores = np.zeros((len(batch), weights.shape[1]))
        step = max(1, MATRIX_CELLS // max(1, len(grams)))
        for lo in range(0, len(batch) if len(grams) else 0, step):
            texts = batch["payload"].iloc[lo : lo + step]
            present = np.zeros((len(texts), len(grams)))
            for i, text in enumerate(texts):
                for codes in _grams(text or ""):
                    at = np.searchsorted(grams, codes)
                    at[at == len(grams)] = 0
                    present[i, at[grams[at] == codes]] = 1.0
            scores[lo : lo + step] = present @ weights
        return np.where(scores > 0, scores, -np.inf)

    return prepare, scorer
