"""WARC archives: a writer that stores equal payloads once and a reader that splits files.

Every record is a gzip member. A reading task gets a byte range of a file, looks there for
the magic bytes of gzip, and accepts a candidate only if it decompresses to a WARC header;
a task owns the records that start in its range and reads the last of them past its end.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausemill.llm.common import arrow_batches, open_folder, text_of

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 1_000
FILE_BYTES = 256_000_000
SPLIT_BYTES = 32_000_000
WARC_DATE = "2024-01-01T00:00:00Z"

_READ_BYTES = 1_000_000
_PIECE_BYTES = 8_000


def typed(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, payload, payload_digest, record_type, refers_to)``.

    Of equal payloads of at least ``min_bytes`` the one with the largest page_id is the
    response, the others refer to it. Rows that repeat this page_id as well are responses
    too; a null page_id is below all others. Null html is an empty payload.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(text_of("html"), "UTF-8").alias("payload"),
    )
    digest = F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload"))
    # Only payloads that occur more than once meet in a join; their table is one narrow row each.
    several = (
        rows.select("page_id", digest.alias("digest")).filter(F.col("digest").isNotNull()).groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response")).filter("n > 1").drop("n")
    )
    both = rows.withColumn("digest", digest).join(several, "digest", "left")
    revisit = F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id"))
    return both.select(
        "page_id", "url", "payload", F.sha1("payload").alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response")).alias("refers_to"),
    )


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit holds no payload but names its length and digest."""
    body = b"" if kind == "revisit" else payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": WARC_DATE,
        "WARC-Target-URI": None if url is None else urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": len(payload),
        "WARC-Profile": REVISIT_PROFILE if kind == "revisit" else None,
        "WARC-Refers-To": _urn(refers_to) if kind == "revisit" else None,
        "Content-Type": "text/html",
        "Content-Length": len(body),
    }
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items() if v is not None), b"", b""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(b"\r\n".join(lines) + body + b"\r\n\r\n") + squeeze.flush()


def write(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Write rows of :func:`typed` as ``folder/*.warc.gz`` and their names and sizes as ``folder/manifest``.

    The manifest says which files count: what a lost or repeated attempt has written is in none of its rows.
    """
    arrow_batches(records.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        sink, name, size, done = None, "", 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = files.open_output_stream(f"{root}/{name}", compression=None)
                data = record(*row)
                sink.write(data)
                size += len(data)
                if size >= file_bytes:
                    sink.close()
                    sink = None
                    done.append((name, size))
        if sink is not None:
            sink.close()
            done.append((name, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "bytes"]
        )

    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    rows = records.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    rows.mapInArrow(store, "file string, bytes long").write.parquet(f"{folder}/manifest")


class _Window:
    """Bytes of a file from a growing position on, read in blocks."""

    def __init__(self, source, start: int, size: int):
        self.source, self.size = source, size
        self.data, self.base, self.used = b"", start, 0  # file position of the data, bytes of them that are done

    @property
    def at(self) -> int:
        return self.base + self.used

    def more(self) -> bool:
        self.base, self.data, self.used = self.at, self.data[self.used :], 0
        got = self.source.read_at(min(_READ_BYTES, self.size - self.base - len(self.data)), self.base + len(self.data))
        self.data += got
        return bool(got)

    def piece(self, ahead: int) -> bytes:
        """Some bytes that begin ``ahead`` of the position; none at the end of the file."""
        if self.used + ahead >= len(self.data):
            self.more()
        return self.data[self.used + ahead : self.used + ahead + _PIECE_BYTES]


def _member(window: _Window) -> tuple[bytes, int] | None:
    """Content and size of the gzip member at the window's position; None if it isn't a WARC record."""
    inflate, content, size = zlib.decompressobj(31), bytearray(), 0
    try:
        while not inflate.eof:
            piece = window.piece(size)
            if not piece:
                return None
            content += inflate.decompress(piece)
            size += len(piece) - len(inflate.unused_data)
            if len(content) >= len(VERSION) and not content.startswith(VERSION):
                return None
    except zlib.error:
        return None
    return (bytes(content), size) if content.startswith(VERSION) else None


def members(source, start: int, end: int, size: int) -> Iterator[bytes]:
    """Contents of the records that start in ``[start, end)``."""
    window = _Window(source, start, size)
    while window.at < end:
        found = window.data.find(MAGIC, window.used)
        if found < 0:
            window.used = max(window.used, len(window.data) - len(MAGIC) + 1)
            if not window.more():
                return
            continue
        window.used = found
        if window.at >= end:
            return
        member = _member(window)
        if member is None:
            window.used += 1
        else:
            yield member[0]
            window.used += member[1]


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(urn: str | None) -> int | None:
    number = (urn or "").rpartition(":")[2].rstrip(">")
    return int(number) if number else None


_RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the manifest's files; a task reads byte ranges of at most ``split_bytes``.

    A revisit's payload is null. A response whose payload differs from its digest is an error.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = manifest.filter("bytes > 0").select("file", "bytes", F.explode(starts).alias("start"))
    tasks = max(1, min(ranges.count(), 100_000))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        for batch in batches:
            for span in batch.to_pylist():
                with files.open_input_file(f"{root}/{span['file']}") as source:
                    rows, held = [], 0
                    for content in members(source, span["start"], span["start"] + split_bytes, span["bytes"]):
                        rows.append(_row(content))
                        held += len(content)
                        if held > 4 * _READ_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return ranges.repartition(tasks, "file", "start").mapInArrow(load, _RECORD)


def _row(content: bytes) -> tuple:
    fields, body = parse(content)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    url = fields.get("WARC-Target-URI")
    return (
        _page(fields["WARC-Record-ID"]), url,
        None if kind == "revisit" else body, int(fields["WARC-Payload-Length"]), digest, kind,
        _page(fields.get("WARC-Refers-To")),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
