"""Okapi BM25 from an inverted index whose blocks know the largest score they can give.

The chunks are dealt to slices of bounded size and like lengths. The index has one row per
term and slice: the chunks there that hold the term, the part of a score it gives each of
them, and the largest such part. A search reads rows of asked terms only. The largest parts
bound what a query can reach in a slice; the slices of highest bounds are scored first, which
gives every query a score that its k-th best chunk has at least, and slices whose bound stays
below that are skipped. Slices are scored side by side, by array operations over their rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clausemill.functions.terms import tokenize
from clausemill.session import cut_lineage

K1, B, EPSILON = 1.5, 0.75, 0.25
SCORE_DIGITS = 9
SLICE_CHUNKS = 8_192  # expected chunks of a slice at most
LENGTH_RATIO = 1.25  # chunks of one slice differ in length by less
FIRST_SLICES = 2  # of each query, scored for its bar
QUERY_TERMS = 50_000  # distinct terms, summed over queries, that go to the tasks at once
CELLS = 1 << 22  # of one array of queries by chunks
ENTRIES = 1 << 21  # of postings that some queries score at once
TASK_BYTES = 8 << 20  # text whose tokens one task counts
_SLACK = 1e-6  # far above rounding, so that no chunk is lost to the order of a sum

_TERMS = "term string, df long, cf long, idf double"
_POSTINGS = "slice int, term string, top double, chunks array<long>, parts array<double>"
_HITS = "query_id long, chunk long, score double"


@dataclass(frozen=True)
class PostingIndex:
    """``terms(term, df, cf, idf)``, ``postings(slice, term, top, chunks, parts)`` and the corpus totals."""

    terms: DataFrame
    postings: DataFrame
    n: int
    mean_len: float


def build_index(
    chunks: DataFrame, key: str, text: str, path: str, slice_chunks: int = SLICE_CHUNKS, k1: float = K1, b: float = B, task_bytes: int = TASK_BYTES
) -> PostingIndex:
    """Write the index of ``chunks`` below ``path``. Null and empty texts count as chunks without terms."""
    spark = chunks.sparkSession
    # All tokens of a chunk lie in its partition, so they are counted there without another exchange. Their counts
    # take many times the room of the text, so the partitions are counted by the text's bytes.
    texts = chunks.select(F.col(key).cast("long").alias("chunk"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    words = texts.repartition(max(1, -(-n_bytes // task_bytes), min(spark.sparkContext.defaultParallelism, n_bytes >> 16)), "chunk")
    words = words.select("chunk", tokenize(F.col("text")).alias("words")).select("chunk", F.size("words").alias("doc_len"), "words")
    # The null in front stands for the chunk itself.
    term = F.explode(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("term")
    counted = words.select("chunk", "doc_len", term).groupBy("chunk", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted.write.parquet(f"{path}/counts")
    counted = spark.read.schema(counted.schema).parquet(f"{path}/counts")
    held = counted.filter("term is not null")
    whole = counted.filter("term is null")
    band = F.floor(F.log(F.greatest("doc_len", F.lit(1))) / math.log(LENGTH_RATIO)).cast("int")
    # One row per band of lengths, so a few hundred at most.
    bands = whole.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("len")).orderBy("band").collect()
    n = sum(r["n"] for r in bands)
    mean_len = sum(r["len"] for r in bands) / n if n else 0.0
    spark.createDataFrame([(n, mean_len)], "n long, mean_len double").write.parquet(f"{path}/totals")
    raw = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).withColumn("raw", raw)
    mean = terms.agg(F.avg("raw").alias("mean")).scalar()
    idf = F.when(F.col("raw") < 0, mean * EPSILON).otherwise(F.col("raw"))
    terms.select("term", "df", "cf", idf.alias("idf")).write.parquet(f"{path}/terms")
    sizes = [-(-r["n"] // slice_chunks) for r in bands]
    begins = np.cumsum([0, *sizes]).tolist()
    first = F.create_map(*[F.lit(x) for r, at, s in zip(bands, begins, sizes) for x in (r["band"], at * (1 << 32) + s)]) if bands else None
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / max(mean_len, 1e-9)))
    place = F.element_at(first, band) if bands else F.lit(1)
    slice_no = F.shiftright(place, 32) + F.pmod(F.xxhash64("chunk"), place.bitwiseAND((1 << 32) - 1))
    rows = held.select(slice_no.cast("int").alias("slice"), "term", "chunk", part.alias("part")).groupBy("slice", "term").agg(
        F.max("part").alias("top"), F.collect_list(F.struct("chunk", "part")).alias("entries")
    )
    rows = rows.select("slice", "term", "top", F.col("entries")["chunk"].alias("chunks"), F.col("entries")["part"].alias("parts"))
    # By term, so that a file's parts without an asked term are skipped by their statistics.
    rows.sortWithinPartitions("term", "slice").write.parquet(f"{path}/postings")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> PostingIndex:
    totals = spark.read.schema("n long, mean_len double").parquet(f"{path}/totals").first()
    return PostingIndex(
        spark.read.schema(_TERMS).parquet(f"{path}/terms"), spark.read.schema(_POSTINGS).parquet(f"{path}/postings"),
        totals["n"], totals["mean_len"],
    )


def asked_terms(index: PostingIndex, queries: DataFrame, query: str) -> DataFrame:
    """``(query_id, term, w)`` of the terms that the index holds; ``w`` is the idf times the term's count in the query."""
    words = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(tokenize(F.col(query))).alias("term"))
    counted = words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    return counted.join(index.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))


@dataclass(frozen=True)
class _Asked:
    """A block of queries: per term code its queries and weights, per query its id and bar."""

    ends: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    bars: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame) -> tuple[_Asked, list[str]]:
        code, terms = pd.factorize(rows["term"])
        query, ids = pd.factorize(rows["query_id"])
        order = np.argsort(code, kind="stable")
        ends = np.searchsorted(code[order], np.arange(len(terms) + 1))
        return cls(ends, query[order], rows["w"].to_numpy()[order], np.asarray(ids), np.full(len(ids), -np.inf)), list(terms)

    def with_bars(self, bars: dict[int, float]) -> _Asked:
        found = np.array([bars.get(i, -np.inf) for i in self.ids.tolist()])
        # Bounds need weights that only add: a query with a negative one, as tiny corpora may have, keeps all slices.
        found[self.query[self.weight < 0]] = -np.inf
        return _Asked(self.ends, self.query, self.weight, self.ids, found)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def _steps(entries: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``most`` queries and ``ENTRIES`` postings; a query of more is alone."""
    upto = np.cumsum(entries)
    lo = 0
    while lo < len(entries):
        fits = int(np.searchsorted(upto, upto[lo] - entries[lo] + ENTRIES, "right"))
        hi = max(lo + 1, min(lo + most, fits))
        yield lo, hi
        lo = hi


def _score_slice(asked: _Asked, k: int):
    """The k best chunks of a slice for each query whose bound there reaches its bar."""

    def score(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        code, top = rows["code"].to_numpy(), rows["top"].to_numpy()
        n = asked.ends[code + 1] - asked.ends[code]
        at = _ragged(asked.ends[code], n)
        row, query, weight = np.repeat(np.arange(len(code)), n), asked.query[at], asked.weight[at]
        bound = np.bincount(query, weight * top[row], len(asked.ids))
        seen = np.bincount(query, minlength=len(asked.ids)) > 0
        mine = np.flatnonzero((seen & (bound + _SLACK >= asked.bars))[query])
        mine = mine[np.argsort(query[mine], kind="stable")]
        row, query, weight = row[mine], query[mine], weight[mine]
        lists = rows["chunks"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        begin = np.cumsum(sizes) - sizes
        chunks, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        parts = rows["parts"].combine_chunks().flatten().to_numpy()
        found = []
        asked_here, number = np.unique(query, return_inverse=True)
        for lo, hi in _steps(np.bincount(number, sizes[row]), max(1, CELLS // max(1, len(chunks)))):
            a, b = np.searchsorted(number, [lo, hi])
            some = asked_here[lo:hi]
            entry = _ragged(begin[row[a:b]], sizes[row[a:b]])
            cell = np.repeat(number[a:b] - lo, sizes[row[a:b]]) * len(chunks) + place[entry]
            value = np.repeat(weight[a:b], sizes[row[a:b]]) * parts[entry]
            total = np.round(np.bincount(cell, value, len(some) * len(chunks)), SCORE_DIGITS)
            there = np.bincount(cell, minlength=len(total)) > 0
            keep = np.flatnonzero(there & (total + _SLACK >= np.repeat(asked.bars[some], len(chunks))))
            q, c = np.divmod(keep, len(chunks))
            order = np.lexsort((c, -total[keep], q))
            q, c, kept = q[order], c[order], total[keep][order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            found.append((asked.ids[some[q[first]]], chunks[c[first]], kept[first]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)]
        return pa.table(dict(zip(("query_id", "chunk", "score"), columns)))

    return score


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bar_rows(asked: DataFrame, postings: DataFrame, block: _Asked, k: int) -> dict[int, float]:
    """The k-th best score of each query in its slices of highest bounds."""
    bounds = postings.select("slice", "term", "top").join(asked, "term").groupBy("query_id", "slice").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "slice"))
    first = bounds.withColumn("place", place).filter(F.col("place") <= FIRST_SLICES).select("slice").distinct()
    hits = postings.join(first, "slice", "left_semi").groupBy("slice").applyInArrow(_score_slice(block, k), _HITS)
    return {r["query_id"]: r["score"] for r in _best(hits, k).filter(F.col("rank") == k).collect()}  # a row per query at most


def bm25_topk(
    index: PostingIndex, key: str, queries: DataFrame, query: str, k: int = 50, query_terms: int = QUERY_TERMS
) -> DataFrame:
    """``(query_id, key, score, rank)`` by Okapi BM25; chunks without a query term are left out, ties go to the lower key.

    Queries go to the tasks in blocks of about ``query_terms`` terms; one block is the rule.
    """
    spark = queries.sparkSession
    asked = cut_lineage(asked_terms(index, queries, query))
    n_blocks = math.ceil(asked.count() / query_terms)
    hits = spark.createDataFrame([], _HITS)
    for number in range(n_blocks):
        mine = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == number)
        rows = mine.orderBy("query_id", "term").toPandas()
        if rows.empty:
            continue
        block, terms = _Asked.of(rows)
        codes = spark.createDataFrame(pd.DataFrame({"term": terms, "code": np.arange(len(terms), dtype=np.int64)}), "term string, code long")
        postings = cut_lineage(index.postings.join(codes, "term"))  # rows of asked terms only
        block = block.with_bars(bar_rows(mine, postings, block, k))
        hits = hits.unionByName(postings.groupBy("slice").applyInArrow(_score_slice(block, k), _HITS))
    return _best(hits, k).select("query_id", F.col("chunk").alias(key), "score", "rank")
