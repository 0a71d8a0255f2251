"""Ranked lexical search over an index whose strata are documents of equal length normaliser.

A document's score adds up, over the query's terms, ``w * impact`` with the integer
``impact = (1000000000 * tf) div (1000 * tf + 8 * m)``. The normaliser ``m`` is one
number for all documents of a stratum, so a term's impact there depends on its ``tf``
alone and is worked out once per ``tf``; the postings of a term lie by ``tf``, greatest
first. A stratum is kept in blocks of bounded size, each a row of the index, and a block
is never read in part: what it holds of a query's terms gives the whole score of its
documents and, from each term's greatest ``tf``, a bound that no document there exceeds.

A search first reads the bounds alone, then visits each query's strata of highest bounds,
and at last all blocks whose bound reaches the k-th score found there. Every task sends
on only its own best per query. Queries go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from clausemill.llm.common import shared_folder, text_of

BYTES_AT_ONCE = 4 << 20
BLOCK_POSTINGS = 200_000
"""A block ends with the document that reaches this many postings."""
QUERY_TERMS = 50_000
"""Queries are searched in blocks of about this many distinct terms, summed over queries."""
PAIRS_AT_ONCE = 4_000_000
FIRST_VISITS = 4

_VECTORS = "doc_id long, n int, terms array<binary>, tfs array<int>"
_BLOCKS = (
    "m long, docs array<long>, terms array<binary>, dfs array<int>, top_tfs array<int>, "
    "n_groups array<int>, tfs array<int>, sizes array<int>, places array<int>"
)
_HITS = "query int, doc_id long, score long"

# What each byte stands for in a term: itself, its lower case, or (0) the end of a term.
_TERM_BYTE = np.arange(256, dtype=np.uint8)
_TERM_BYTE[:0x80] = [c if chr(c).isalnum() else 0 for c in range(0x80)]
_TERM_BYTE[0x41:0x5B] += 0x20


def _array(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values.astype(kind.to_pandas_dtype(), copy=False))


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of texts without nulls: terms with repeats per text, ends of the lists, distinct terms, their counts."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    codes = _TERM_BYTE[np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]] if data else np.empty(0, dtype=np.uint8)
    begin = ends[:-1] - ends[0]
    inside = codes > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    at = begin[begin < len(codes)]
    opens[at] = inside[at]
    opened = np.flatnonzero(opens)
    letters = codes[inside]
    cuts = np.append(np.flatnonzero(opens[inside]), len(letters)).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(opened), [None, pa.py_buffer(cuts), pa.py_buffer(letters)])
    known = tokens.dictionary_encode()
    size = max(1, len(known.dictionary))
    text = np.searchsorted(begin, opened, side="right") - 1
    pairs, counts = np.unique(text * size + known.indices.to_numpy(zero_copy_only=False), return_counts=True)
    lists = np.searchsorted(pairs, np.arange(n + 1) * size)
    return np.bincount(text, minlength=n), lists, known.dictionary.take(pa.array(pairs % size)), counts


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            done = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, done + BYTES_AT_ONCE, side="right")))
            n, ends, terms, counts = term_counts(texts.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), _array(n, pa.int32()), _lists(ends, terms), _lists(ends, _array(counts, pa.int32()))],
                ["doc_id", "n", "terms", "tfs"],
            )
            lo = hi


def term_vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of rows that have a key: terms with repeats, distinct terms and their counts."""
    keyed = rows.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).filter("doc_id is not null")
    return keyed.mapInArrow(_vectors, _VECTORS)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Ends of a batch's lists, from 0, and their values."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], column.values.slice(ends[0], ends[-1] - ends[0])


def _blocks_of(m: np.ndarray, docs: np.ndarray, ends: np.ndarray, terms: pa.Array, tfs: np.ndarray) -> pa.RecordBatch:
    """Blocks of documents that follow each other by ``m``."""
    first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    block_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(m))))
    row = np.repeat(np.arange(len(m)), np.diff(ends))
    known = terms.dictionary_encode()
    code = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = row - first[block_of[row]]
    order = np.lexsort((place, -tfs, code, block_of[row]))
    block, code, tfs, place = block_of[row][order], code[order], tfs[order], place[order]
    new_term = np.append(True, (block[1:] != block[:-1]) | (code[1:] != code[:-1]))
    new_group = new_term | np.append(True, tfs[1:] != tfs[:-1])
    term_at, group_at = np.flatnonzero(new_term), np.flatnonzero(new_group)
    number = np.arange(len(first) + 1)
    by_term, by_group = (np.searchsorted(block[at], number) for at in (term_at, group_at))
    columns = {
        "m": _array(m[first], pa.int64()),
        "docs": _lists(np.append(first, len(m)), _array(docs, pa.int64())),
        "terms": _lists(by_term, known.dictionary.take(pa.array(code[term_at]))),
        "dfs": _lists(by_term, _array(np.diff(np.append(term_at, len(code))), pa.int32())),
        "top_tfs": _lists(by_term, _array(tfs[term_at], pa.int32())),
        "n_groups": _lists(by_term, _array(np.diff(np.append(np.searchsorted(group_at, term_at), len(group_at))), pa.int32())),
        "tfs": _lists(by_group, _array(tfs[group_at], pa.int32())),
        "sizes": _lists(by_group, _array(np.diff(np.append(group_at, len(code))), pa.int32())),
        "places": _lists(np.searchsorted(block, number), _array(place, pa.int32())),
    }
    return pa.RecordBatch.from_pydict(columns)


def _invert(block_postings: int):
    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends, terms = _flat(batch.column(2))
            tfs = _flat(batch.column(3))[1].to_numpy(zero_copy_only=False).astype(np.int64)
            lo = 0
            while lo < len(m):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + block_postings, side="right")) - 1)
                a, b = ends[lo], ends[hi]
                yield _blocks_of(m[lo:hi], docs[lo:hi], ends[lo : hi + 1] - a, terms.slice(a, b - a), tfs[a:b])
                lo = hi

    return invert


@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", block_postings: int = BLOCK_POSTINGS) -> Index:
    """Index of all ``docs``, written below ``path``.

    Documents without a term, as null and empty texts are, and rows without a key are not in it
    and not counted. Repeated rows are documents of their own. Other columns aren't read. The
    documents of one stratum may be any number: they are dealt by stratum, oversize shares are
    split between tasks, and a task cuts a stratum into blocks.
    """
    spark = docs.sparkSession
    term_vectors(docs, key, text).filter("n > 0").write.parquet(f"{path}/vectors")
    vectors = spark.read.schema(_VECTORS).parquet(f"{path}/vectors")
    totals = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = totals["n"], totals["terms"]
    # Integer division of longs.
    m = F.expr(f"25 + (75L * n * {n_docs}L) div {max(1, n_terms)}L").cast("long")
    by_stratum = vectors.select(m.alias("m"), "doc_id", "terms", "tfs").hint("rebalance", "m").sortWithinPartitions("m", "doc_id")
    by_stratum.mapInArrow(_invert(block_postings), _BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return Index(spark.read.schema(_BLOCKS).parquet(f"{path}/blocks"), n_docs, n_terms)


def exact_sums(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of non-negative 64-bit integers by key; by halves where doubles might not be exact."""
    if values.sum(dtype=np.float64) < 2.0**52:
        return np.bincount(keys, values, size).astype(np.int64)
    low = values & 0xFFFFFF
    return exact_sums(keys, low, size) + (exact_sums(keys, values >> 24, size) << 24)


def impacts(tfs: np.ndarray, m: int) -> np.ndarray:
    tfs = tfs.astype(np.int64)
    return 1_000_000_000 * tfs // (1_000 * tfs + 8 * m)


class _Best:
    """The k best (score, key) per query so far, ties to the lower key, and the score that a new one must reach."""

    def __init__(self, bars: np.ndarray, k: int):
        self.bars, self.k = np.maximum(bars, 1), k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, query: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        self.parts.append((query, score, key))
        self.held += len(query)
        if self.held > 4 * self.k * len(self.bars) + 100_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        empty = np.empty(0, dtype=np.int64)
        query, score, key = (np.concatenate(x) for x in zip((empty, empty, empty), *self.parts))
        order = np.lexsort((key, -score, query))
        query, score, key = query[order], score[order], key[order]
        number = np.arange(len(query)) - np.searchsorted(query, query)
        self.bars[query[number == self.k - 1]] = score[number == self.k - 1]
        keep = number < self.k
        self.parts, self.held = [(query[keep], score[keep], key[keep])], int(keep.sum())
        return self.parts[0]


@dataclass(frozen=True)
class Asked:
    """The distinct terms of a block of queries, and for each term its queries with ``times * w``."""

    terms: pa.Array
    ends: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    n_queries: int

    def places(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of each index row's terms in a batch and the number of each asked term, -1 for others."""
        ends, flat = _flat(column)
        return ends, pc.fill_null(pc.index_in(flat, value_set=self.terms), -1).to_numpy(zero_copy_only=False)

    def entries(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query that has one of the terms: which of ``codes``, its query and weight."""
        sizes = self.ends[codes + 1] - self.ends[codes]
        at = _ragged(self.ends[codes], sizes)
        return np.repeat(np.arange(len(codes)), sizes), self.query[at], self.weight[at]


def _strata_bounds(asked: Asked, keep: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(np.zeros(asked.n_queries, dtype=np.int64), keep)
        for batch in batches:
            ends, codes = asked.places(batch.column(1))
            tops = _flat(batch.column(2))[1].to_numpy(zero_copy_only=False)
            for r, m in enumerate(batch.column(0).to_pylist()):
                here = np.arange(ends[r], ends[r + 1])[codes[ends[r] : ends[r + 1]] >= 0]
                which, query, weight = asked.entries(codes[here])
                bound = exact_sums(query, weight * impacts(tops[here], m)[which], asked.n_queries)
                reach = np.flatnonzero(bound >= best.bars)
                best.add(reach, bound[reach], np.full(len(reach), m))
        yield _hits(best)

    return scan


def _hits(best: _Best) -> pa.RecordBatch:
    query, score, key = best.settle()
    return pa.RecordBatch.from_arrays(
        [_array(query, pa.int32()), _array(key, pa.int64()), _array(score, pa.int64())], ["query", "doc_id", "score"]
    )


def _scored(asked: Asked, bars: np.ndarray, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(bars, k)
        for batch in batches:
            ends, codes = asked.places(batch.column("terms"))
            lists = {c: _flat(batch.column(c)) for c in ("docs", "dfs", "top_tfs", "n_groups", "tfs", "sizes", "places")}
            lists = {c: (e, v.to_numpy(zero_copy_only=False)) for c, (e, v) in lists.items()}
            for r, m in enumerate(batch.column("m").to_pylist()):
                here = np.flatnonzero(codes[ends[r] : ends[r + 1]] >= 0)
                if len(here):
                    row = {c: v[e[r] : e[r + 1]] for c, (e, v) in lists.items()}
                    _visit(asked, best, m, here, codes[ends[r] + here], row)
        yield _hits(best)

    return scan


def _visit(asked: Asked, best: _Best, m: int, here: np.ndarray, codes: np.ndarray, row: dict[str, np.ndarray]) -> None:
    """Score a block's documents for the queries whose bar its bound reaches."""
    which, query, weight = asked.entries(codes)
    bound = exact_sums(query, weight * impacts(row["top_tfs"][here], m)[which], asked.n_queries)
    visited = bound >= best.bars
    mine = np.flatnonzero(visited[query])
    if not len(mine):
        return
    mine = mine[np.argsort(query[mine], kind="stable")]
    which, query, weight = which[mine], query[mine], weight[mine]
    impact = np.repeat(impacts(row["tfs"], m), row["sizes"])  # once per tf of a term, then for its documents
    first, n = (np.cumsum(row["dfs"]) - row["dfs"])[here].astype(np.int64), row["dfs"][here].astype(np.int64)
    pairs, n_docs = np.cumsum(n[which]), len(row["docs"])
    lo = 0
    while lo < len(which):
        done = pairs[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(pairs, done + PAIRS_AT_ONCE, side="right")))
        hi = int(np.searchsorted(query, query[hi - 1], side="right"))  # whole queries
        some, number = np.unique(query[lo:hi], return_inverse=True)
        at, sizes = _ragged(first[which[lo:hi]], n[which[lo:hi]]), n[which[lo:hi]]
        value = np.repeat(weight[lo:hi], sizes) * impact[at]
        score = exact_sums(np.repeat(number, sizes) * n_docs + row["places"][at], value, len(some) * n_docs)
        score = score.reshape(len(some), n_docs)
        q, d = np.nonzero(score >= best.bars[some, None])
        best.add(some[q], score[q, d], row["docs"][d])
        lo = hi


def _frequencies(asked: pa.Array):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            codes = pc.fill_null(pc.index_in(_flat(batch.column(0))[1], value_set=asked), -1).to_numpy(zero_copy_only=False)
            dfs = _flat(batch.column(1))[1].to_numpy(zero_copy_only=False)
            total += np.bincount(codes[codes >= 0], dfs[codes >= 0], len(asked)).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([_array(there, pa.int32()), _array(total[there], pa.int64())], ["term", "df"])

    return scan


def _asked(index: Index, rows: list) -> Asked:
    """Terms and weights of a block of queries; document frequencies are counted over the whole index."""
    known: dict[bytes, int] = {}
    numbers = np.array([known.setdefault(bytes(t), len(known)) for r in rows for t in r["terms"]], dtype=np.int64)
    times = np.array([n for r in rows for n in r["tfs"]], dtype=np.int64)
    query = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
    terms = pa.array(list(known), type=pa.binary())
    found = index.blocks.select("terms", "dfs").mapInArrow(_frequencies(terms), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = np.zeros(len(known), dtype=np.int64)
    for r in found.collect():  # as many rows as asked terms at most
        weight[r["term"]] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r["df"] + 1)))
    order = np.argsort(numbers, kind="stable")
    ends = np.searchsorted(numbers[order], np.arange(len(known) + 1))
    return Asked(terms, ends, query[order], (times * weight[numbers])[order], len(rows))


def _first(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bars_of(index: Index, asked: Asked, k: int) -> np.ndarray:
    """Per query the k-th best score in its strata of highest bounds: what a document must reach."""
    bounds = index.blocks.select("m", "terms", "top_tfs").mapInArrow(_strata_bounds(asked, FIRST_VISITS), _HITS)
    strata = _first(bounds, FIRST_VISITS).select("doc_id").distinct().collect()  # FIRST_VISITS per query at most
    first = index.blocks.filter(F.col("m").isin([r["doc_id"] for r in strata]))
    found = _first(first.mapInArrow(_scored(asked, np.zeros(asked.n_queries, dtype=np.int64), k), _HITS), k)
    bars = np.zeros(asked.n_queries, dtype=np.int64)
    for r in found.filter(F.col("rank") == k).collect():  # a row per query at most
        bars[r["query"]] = r["score"]
    return bars


def search(index: Index, queries: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """``(key, rank, doc_id, score)``: the ``k`` best documents of each query with a score above 0, ties by ascending doc_id.

    Each row with a key is a query of its own, so repeated rows have repeated answers; rows without
    one, and queries without a term that the index holds, have none. Terms are maximal stretches of
    ASCII letters, digits and all characters beyond ASCII, with only A to Z lower-cased.
    """
    spark = queries.sparkSession
    vectors = term_vectors(queries, key, text).filter("n > 0").withColumn("size", F.size("terms"))
    path = f"{shared_folder(spark, 'queries')}/vectors"
    vectors.write.parquet(path)
    vectors = spark.read.schema(vectors.schema).parquet(path)
    total = vectors.agg(F.sum("size").cast("long").alias("terms")).first()["terms"] or 0
    kind = queries.schema[key].dataType
    answers = spark.createDataFrame([], "query int, doc_id long, score long, rank int, item long")
    n_parts = math.ceil(total / query_terms)
    for part in range(n_parts):
        mine = F.pmod(F.xxhash64("doc_id", "terms"), F.lit(n_parts)) == part
        rows = vectors.filter(mine).orderBy("doc_id").collect()  # about query_terms terms
        if not rows:
            continue
        asked = _asked(index, rows)
        hits = index.blocks.mapInArrow(_scored(asked, bars_of(index, asked, k), k), _HITS)
        names = spark.createDataFrame([(q, r["doc_id"]) for q, r in enumerate(rows)], "query int, item long")
        answers = answers.unionByName(_first(hits, k).join(F.broadcast(names), "query"))
    return answers.select(F.col("item").cast(kind).alias(key), "rank", "doc_id", "score")
