"""Token ids as length-delimited binary records with a separate offset index.

A record is: length of the data (unsigned 64-bit little-endian), masked CRC-32C of these
eight bytes (32-bit), the data, masked CRC-32C of the data (32-bit). The mask rotates the
checksum right by 15 bits and adds a constant, so that data that hold checksums stay safe.
The data are the ids of one document as little-endian integers of 2 bytes if the
vocabulary allows it, else 4.

Files follow each other in ascending document order. The index, a Parquet table, has a row
per record (file, byte offset, data length, ids before it), so readers may take records in any order.
A lost or repeated task leaves a file that no index row names; the index alone says what counts.
"""

from __future__ import annotations

import uuid

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clausemill.llm.common import arrow_batches, open_folder, small_side, text_of
from clausemill.llm.tokens import WORD_PARTS, encoder

# Fixed values of the format: the reflected polynomial of CRC-32C, the mask's rotation and constant.
POLYNOMIAL = 0x82F63B78
MASK_ROTATION = 15
MASK_DELTA = 0xA282EAD8

_LANE = 64  # 16-bit words that are checked side by side


def _table() -> np.ndarray:
    """Register after 16 zero bits, by the register's low 16 bits."""
    r = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        r = np.where(r & 1, (r >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), r >> np.uint32(1)).astype(np.uint32)
    return r


def _shift_tables(table: np.ndarray) -> np.ndarray:
    """Register after a lane of zero bits, by each half of the register."""
    halves = np.stack([np.arange(1 << 16, dtype=np.uint32), np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)])
    for _ in range(_LANE):
        halves = (halves >> np.uint32(16)) ^ table[halves & np.uint32(0xFFFF)]
    return halves


class Checksums:
    """CRC-32C of many byte strings at once: equal-length lanes of all strings advance together."""

    def __init__(self) -> None:
        self.table = _table()
        self.shift = _shift_tables(self.table)

    def crc(self, data: list[bytes]) -> np.ndarray:
        """Checksums of strings of an even number of bytes, 4 at least (others are done one by one)."""
        out = np.zeros(len(data), dtype=np.uint32)
        plain = [i for i, d in enumerate(data) if len(d) < 4 or len(d) % 2]
        for i in plain:
            out[i] = self._single(data[i])
        rest = [i for i, d in enumerate(data) if not (len(d) < 4 or len(d) % 2)]
        if not rest:
            return out
        words = np.array([len(data[i]) // 2 for i in rest], dtype=np.int64)
        lanes = -(-words // _LANE)
        first_lane = np.cumsum(lanes) - lanes
        flat = np.zeros((int(lanes.sum()), _LANE), dtype=np.uint16)
        line = flat.reshape(-1)
        for i, n, lane, lead in zip(rest, words.tolist(), first_lane.tolist(), (lanes * _LANE - words).tolist()):
            at = lane * _LANE + lead  # zeros in front don't change a register that starts at zero
            line[at : at + n] = np.frombuffer(data[i], dtype="<u2")
            line[at : at + 2] ^= np.uint16(0xFFFF)  # the register's start, all ones, folded into the data
        register = np.zeros(len(flat), dtype=np.uint32)
        for column in np.ascontiguousarray(flat.T):
            register = (register >> np.uint32(16)) ^ self.table[(register ^ column) & np.uint32(0xFFFF)]
        order = np.argsort(-lanes, kind="stable")
        total = np.zeros(len(rest), dtype=np.uint32)
        alive = len(rest)
        for step in range(int(lanes.max())):
            while lanes[order[alive - 1]] <= step:
                alive -= 1
            some = order[:alive]
            t = total[some]
            total[some] = self.shift[0][t & np.uint32(0xFFFF)] ^ self.shift[1][t >> np.uint32(16)] ^ register[first_lane[some] + step]
        out[rest] = total ^ np.uint32(0xFFFFFFFF)
        return out

    def masked(self, data: list[bytes]) -> np.ndarray:
        c = self.crc(data)
        return ((c >> np.uint32(MASK_ROTATION)) | (c << np.uint32(32 - MASK_ROTATION))) + np.uint32(MASK_DELTA)

    @staticmethod
    def _single(data: bytes) -> int:
        r = 0xFFFFFFFF
        for byte in data:
            r ^= byte
            for _ in range(8):
                r = (r >> 1) ^ (POLYNOMIAL if r & 1 else 0)
        return r ^ 0xFFFFFFFF


def frame(payloads: list[bytes], sums: Checksums) -> list[bytes]:
    """Records of the given data."""
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    head_sums, data_sums = sums.masked(heads).tolist(), sums.masked(payloads).tolist()
    return [
        h + a.to_bytes(4, "little") + p + b.to_bytes(4, "little")
        for h, a, p, b in zip(heads, head_sums, payloads, data_sums)
    ]


def unframe(buffer: bytes, offsets: list[int], sums: Checksums) -> list[bytes]:
    """Data of the records that start at ``offsets``; a length or checksum that is wrong is an error."""
    heads = [buffer[o : o + 8] for o in offsets]
    lengths = [int.from_bytes(h, "little") for h in heads]
    ends = [o + 12 + n for o, n in zip(offsets, lengths)]
    payloads = [buffer[o + 12 : e] for o, e in zip(offsets, ends)]
    said = [int.from_bytes(buffer[o + 8 : o + 12], "little") for o in offsets]
    if said != sums.masked(heads).tolist():
        raise ValueError("a record's length doesn't match its checksum")
    if [int.from_bytes(buffer[e : e + 4], "little") for e in ends] != sums.masked(payloads).tolist():
        raise ValueError("a record's data don't match their checksum")
    return payloads


_INDEX = "part int, file string, row long, doc_id long, offset long, data_bytes long, n_tokens long"
_FLUSH_BYTES = 8_000_000


def write(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, width: int = 2,
    parts: str = WORD_PARTS, doc_id: str = "doc_id", text: str = "text",
) -> None:
    """Encode ``docs`` in ascending id order into ``folder/data-*`` and ``folder/index``.

    Null text counts as empty (the end id alone); null ids come first; rows with equal ids
    follow each other in order of their texts. No rows give an empty index. An id that
    doesn't fit ``width`` bytes is an error.
    """
    arrow_batches(docs.sparkSession)
    kind = {2: "<u2", 4: "<u4"}[width]
    end = int(end_id).to_bytes(4, "little")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, sums = encoder(tokenizer_path, parts).encode, Checksums()
        part = TaskContext.get().partitionId()
        name = f"data-{part:06d}-{uuid.uuid4().hex}"
        files, root = open_folder(folder)
        sink, at, row = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                sink = files.open_output_stream(f"{root}/{name}", compression=None)
            payloads, counts = [], []
            for data in encode(batch.column(1).to_pylist()):
                ids = np.frombuffer(data + end, dtype="<u4")
                if width == 2 and ids.max() > 0xFFFF:
                    raise ValueError("ids over 65535 need a width of 4 bytes")
                payloads.append(ids.astype(kind).tobytes())
                counts.append(len(ids))
            offsets = []
            for record in frame(payloads, sums):
                offsets.append(at)
                sink.write(record)
                at += len(record)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(range(row, row + n), pa.int64()),
                    batch.column(0), pa.array(offsets, pa.int64()),
                    pa.array([len(p) for p in payloads], pa.int64()), pa.array(counts, pa.int64()),
                ],
                ["part", "file", "row", "doc_id", "offset", "data_bytes", "n_tokens"],
            )
            row += n
        if sink is not None:
            sink.close()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    ordered = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    ordered.mapInArrow(store, _INDEX).write.parquet(f"{folder}/records")
    _finish_index(docs.sparkSession, folder)


def _finish_index(spark: SparkSession, folder: str) -> None:
    """Add the number of ids before each record: sums per file (few rows) plus sums within a file."""
    rows = spark.read.schema(_INDEX).parquet(f"{folder}/records")
    per_file = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = per_file.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    rows.withColumn("within", within).join(small_side(before), "part").select(
        "file", "row", "doc_id", "offset", "data_bytes", "n_tokens", (F.col("before") + F.col("within")).alias("start")
    ).write.parquet(f"{folder}/index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, row, doc_id, offset, data_bytes, n_tokens, start)`` of all records."""
    return spark.read.parquet(f"{folder}/index")


def read(records: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of index rows in whatever order and choice they come.

    ``ids`` are little-endian unsigned 32-bit bytes. Both checksums of every record are verified.
    """
    arrow_batches(records.sparkSession)
    kind = {2: "<u2", 4: "<u4"}[width]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, (files, root) = Checksums(), open_folder(folder)
        opened: dict = {}
        for batch in batches:
            rows = batch.to_pylist()
            ids: list[bytes] = []
            for group in _neighbours(rows):
                if group[0]["file"] not in opened:
                    for old in opened.values():
                        old.close()
                    opened = {group[0]["file"]: files.open_input_file(f"{root}/{group[0]['file']}")}
                first, last = group[0]["offset"], group[-1]["offset"] + group[-1]["data_bytes"] + 16
                buffer = opened[group[0]["file"]].read_at(last - first, first)
                data = unframe(buffer, [r["offset"] - first for r in group], sums)
                ids += [np.frombuffer(d, dtype=kind).astype("<u4").tobytes() for d in data]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(ids, pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"],
            )

    chosen = records.select("file", "doc_id", "offset", "data_bytes", "n_tokens", "start")
    return chosen.mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")


def _neighbours(rows: list[dict]) -> Iterator[list[dict]]:
    """Runs of rows whose records touch in one file, of a bounded number of bytes."""
    run: list[dict] = []
    for r in rows:
        if run and (
            r["file"] != run[-1]["file"]
            or r["offset"] != run[-1]["offset"] + run[-1]["data_bytes"] + 16
            or r["offset"] - run[0]["offset"] > _FLUSH_BYTES
        ):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


