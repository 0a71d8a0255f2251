"""Packing of tokenized documents into training sequences by the sum-of-squares rule.

Documents longer than a sequence are cut into full pieces, of which only the first may be
shorter; every full piece is a sequence of its own. The rest is packed piece by piece:
among the open bins that have room each goes where the sum of the squared counts of open
bins per residual gap becomes smallest, the smallest gap among equals; a new bin is opened
only when none has room (README has the figures for that and for longest first).

Only lengths matter for that. They are dealt at random into groups of a bounded number of
pieces, so that groups have the same mix of lengths and a task packs one group whatever
the size of the corpus; a group leaves a few bins unfilled, which its size makes negligible.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausemill.llm.common import arrow_batches, stored, text_of
from clausemill.llm.tokens import BYTE_LEVEL_PARTS, encoder

PIECES_PER_GROUP = 150_000

_PIECE_SCHEMA = "piece_key long, doc_id long, piece int, start long, length long, ids binary"


@dataclass
class Packed:
    """``pieces`` (piece_key, doc_id, piece, start, length, ids) and ``places`` (piece_key, sequence_id, offset)."""

    pieces: DataFrame
    places: DataFrame

    def sequences(self) -> DataFrame:
        """``(sequence_id, length, ids)``: the assembled sequences, ids as little-endian 32-bit bytes."""
        rows = self.pieces.join(self.places, "piece_key")
        parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
        return rows.groupBy("sequence_id").agg(
            F.sum("length").alias("length"),
            F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        )


def pieces(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, end_id: int = 2,
    parts: str = BYTE_LEVEL_PARTS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Token pieces of every document, not yet stored. ``ids`` are little-endian unsigned 32-bit bytes.

    A null or empty text is the end id alone. Rows that repeat a document or have a null id
    are documents of their own; ``piece_key`` tells their pieces apart. No rows give no pieces.
    """
    arrow_batches(docs.sparkSession)
    width = 4 * max_tokens
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer_path, parts).encode
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, data in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                data += end
                first = len(data) % width or width
                bounds = [0, *range(first, len(data) + 1, width)]
                for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for column, value in zip(out, (key, doc, n, a // 4, (b - a) // 4, data[a:b])):
                        column.append(value)
                    key += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ["piece_key", "doc_id", "piece", "start", "length", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return chosen.mapInArrow(cut, _PIECE_SCHEMA)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (all below ``capacity``), placed in the order given."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins per residual gap; full and new bins count nothing
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        before, after = count[size:], count[: capacity + 1 - size]
        change = 2 * (after - before) + 2
        change[before == 0] = np.iinfo(np.int64).max
        change[0] -= before[0] > 0  # a bin that becomes full isn't open any more
        gap = size + int(change.argmin())  # the new bin, which comes last, only if no open one has room
        if before[gap - size] == 0:
            gap = capacity
        if gap == capacity:
            place, made = made, made + 1
        else:
            place = open_bins[gap].pop()
            count[gap] -= 1
        left = gap - size
        if left:
            open_bins[left].append(place)
            count[left] += 1
        bins[i], offsets[i] = place, capacity - gap
    return bins, offsets


def place(kept_pieces: DataFrame, max_tokens: int = 1024, pieces_per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """``(piece_key, sequence_id, offset)`` for stored pieces.

    Within a group longer pieces come first, equal lengths by key; the result depends on nothing else.
    """
    lengths = kept_pieces.select("piece_key", "length")
    full = lengths.filter(F.col("length") == max_tokens).select(
        "piece_key", (F.col("piece_key") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = lengths.filter(F.col("length") < max_tokens)
    groups = max(1, math.ceil(rest.count() / pieces_per_group))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "piece_key"], ascending=[False, True])
        bins, offsets = sum_of_squares(group["length"].to_numpy(), max_tokens)
        number = (group["group"].iloc[0] << 32) + bins
        return pd.DataFrame({"piece_key": group["piece_key"].to_numpy(), "sequence_id": 2 * number + 1, "offset": offsets})

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("piece_key"), F.lit(groups)))
    return full.unionByName(dealt.groupBy("group").applyInPandas(pack, "piece_key long, sequence_id long, offset long"))


def pack(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, end_id: int = 2,
    parts: str = BYTE_LEVEL_PARTS, pieces_per_group: int = PIECES_PER_GROUP,
) -> Packed:
    """Tokenize ``docs`` once into stored pieces and place them."""
    kept = stored(pieces(docs, tokenizer_path, max_tokens, end_id, parts), "pieces")
    return Packed(kept, place(kept, max_tokens, pieces_per_group))


def packed_rows(docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, end_id: int = 2) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: where each piece lies, with a checksum of its ids."""
    packed = pack(docs, tokenizer_path, max_tokens, end_id)
    rows = packed.pieces.select("piece_key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return rows.join(packed.places, "piece_key").drop("piece_key")
