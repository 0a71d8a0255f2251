"""Removal of repeated runs of lines.

:func:`run_dedup` removes every run of lines, at least two of them with text, that has occurred before. Each such run is
made of pairs of neighbouring lines with text (blank lines between them belong to the pair) and of blank
lines at its two ends. So it is enough to look up each pair, and each pair with the blank lines before or after
it one by one; all runs are found with their real ends, and the work grows with the number of lines.

:func:`line_dedup`, which the pipeline still uses, finds less: it compares whole chunks only, so the ends of a repeated
passage and most short passages stay. A chunk ends after a line where the hash of the last lines' hashes
hits a fixed residue, so boundaries depend on nearby lines only and move along with text that is shifted.
Chunks of two or more lines with text that occur again anywhere are compared byte by byte;
the first occurrence (by doc_id, then position) stays and the others are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clausemill.functions.binding import let
from clausemill.llm.common import arrow_batches, free_name, small_side, stored, text_of

DIVISOR = 3
MIN_LINES = 2
_LINE = 1 << 32


def _codes(lines: Column) -> Column:
    """Chunks of a text as numbers: first line times 2 ** 32 plus the number of lines."""

    def cut(hashes: Column) -> Column:
        n = F.size(hashes)
        rolled = lambda i: F.xxhash64(hashes[i - 1], hashes[i])
        ends = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | ((i > 0) & (F.pmod(rolled(i), F.lit(DIVISOR)) == 0))
        )

        def code(ends: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: e + 1))
            return F.zip_with(starts, ends, lambda a, e: a.cast("long") * _LINE + (e - a + 1).cast("long"))

        return let(ends, code)

    return let(F.transform(lines, lambda x: F.xxhash64(x)), cut)


def _lines_of(lines: Column, code: Column) -> Column:
    return F.slice(lines, (F.shiftright(code, 32) + 1).cast("int"), code.bitwiseAND(F.lit(_LINE - 1)).cast("int"))


def _key() -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_of()))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, code, chunk)``: chunks of at least ``MIN_LINES`` lines that aren't blank."""
    both = let(
        F.split(text_of(), "\n", -1),
        lambda lines: F.transform(_codes(lines), lambda c: F.struct(c.alias("code"), F.array_join(_lines_of(lines, c), "\n").alias("chunk"))),
    )
    rows = docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.explode(both).alias("c")).select(
        "key", "doc_id", "c.code", "c.chunk"
    )
    # Two lines with text; anchored, so that a long line is scanned once.
    return rows.filter(F.col("chunk").rlike(r"(?s)^\s*\S[^\n]*\n.*\S"))


def repeats(docs: DataFrame) -> DataFrame:
    """``(key, gone)``: per document (id and text) the codes of its chunks that occurred before."""
    rows = chunk_rows(docs)
    # Hashes alone are counted first, so that only chunks which may be repeated are moved.
    several = rows.groupBy(F.xxhash64("chunk").alias("hash")).count().filter("count > 1").select("hash")
    found = stored(rows.withColumn("hash", F.xxhash64("chunk")).join(several, "hash", "left_semi"), "chunks")
    here = F.struct("doc_id", "key", "code")
    first = found.groupBy("hash", "chunk").agg(F.min(here).alias("first"))
    later = found.join(first, ["hash", "chunk"]).filter(~here.eqNullSafe(F.col("first")))
    return later.groupBy("key").agg(F.collect_set("code").alias("gone"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the later occurrences of repeated chunks cut out of ``text``; ``n_chars`` follows if present.

    Every row stays, with its other columns as they are; a text may become empty. Texts
    without repeats, null texts among them, are unchanged. Null ids come first. Rows that repeat
    both id and text are one document and get the same text. No rows give no rows.
    """

    def kept(lines: Column, gone: Column) -> Column:
        return F.flatten(F.transform(F.array_except(_codes(lines), gone), lambda c: _lines_of(lines, c)))

    return _without(docs, repeats(docs), kept)


def _without(docs: DataFrame, found: DataFrame, kept: Callable[[Column, Column], Column]) -> DataFrame:
    """``docs`` with texts of the lines ``kept(lines, gone)`` where ``found (key, gone)`` has the document."""
    key, gone = free_name(docs, "dedup_key"), free_name(docs, "dedup_gone")
    marks = found.select(F.col("key").alias(key), F.col("gone").alias(gone))
    rows = docs.withColumn(key, _key()).join(marks, key, "left")
    text = let(F.split(text_of(), "\n", -1), lambda lines: F.array_join(kept(lines, F.col(gone)), "\n"))
    rows = rows.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)
        ))
    return rows.select(*docs.columns)


def runs(text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """``(start, n, code, digest)`` of the runs to look up: each pair of neighbouring lines with text, and with blank lines at one end.

    ``code`` has the lines that go with a run: those of the pair, or else the outermost blank line, since the
    others go with the shorter runs. Equal digests mean equal lines (SHA-256).
    """
    lines = text.split(b"\n")
    full = [i for i, line in enumerate(lines) if line.strip()]
    ends = [-1, *full, len(lines)]
    for k, (i, j) in enumerate(zip(full, full[1:])):
        pair = hashlib.sha256(b"=" + b"\n".join(lines[i : j + 1])).digest()
        yield i, j - i + 1, i * _LINE + j - i + 1, pair
        digest = pair
        for at in range(i - 1, ends[k], -1):
            digest = hashlib.sha256(b"<" + digest + lines[at]).digest()
            yield at, j - at + 1, at * _LINE + 1, digest
        digest = pair
        for at in range(j + 1, ends[k + 3]):
            digest = hashlib.sha256(b">" + digest + lines[at]).digest()
            yield i, at - i + 1, at * _LINE + 1, digest


def run_rows(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, start, n, code, digest)`` of all :func:`runs`."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                found = list(runs(text))
                rows += found
                of += [k] * len(found)
            start, n, code, digest = zip(*rows) if rows else ((), (), (), ())
            at = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(n, pa.int32()),
                 pa.array(code, pa.int64()), pa.array(digest, pa.binary())],
                ["key", "doc_id", "start", "n", "code", "digest"],
            )

    texts = docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return texts.mapInArrow(find, "key string, doc_id long, start int, n int, code long, digest binary")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``(key, gone)``: per document (id and text) the lines of runs that occurred before, as codes."""
    arrow_batches(docs.sparkSession)
    rows = stored(run_rows(docs), "runs")
    here = F.struct("doc_id", "key", "start")
    first = rows.groupBy("digest").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    # A run may not be its own first occurrence in part; if it meets the first one it meets all before it.
    apart = (F.col("key") != F.col("first.key")) | (F.col("first.start") + F.col("n") <= F.col("start"))
    later = rows.join(small_side(stored(first.select("digest", "first"), "first")), "digest").filter(apart)
    return later.groupBy("key").agg(F.collect_set("code").alias("gone"))


def run_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the later occurrences of repeated runs of lines in ``text``; else like :func:`line_dedup`.

    A line goes if it lies in a run of lines, at least two of them with text, that equals a run at an earlier place
    (by doc_id, then position) and doesn't overlap it. Of each line with text the first occurrence stays.
    """

    def kept(lines: Column, gone: Column) -> Column:
        first = lambda c: F.shiftright(c, 32)
        cut = F.flatten(F.transform(gone, lambda c: F.sequence(first(c), first(c) + c.bitwiseAND(F.lit(_LINE - 1)) - 1)))
        all_lines = F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1)
        return F.transform(F.array_except(all_lines, cut), lambda i: lines[i])

    return _without(docs, repeated_runs(docs), kept)
