"""Files, object listings and artefact stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clausemill.functions import urls

CHUNK_SCHEMA = "index string, page_content string, metadata map<string,string>"
ARTEFACT_KINDS = ("catalog", "parsed", "chunks", "metadata")
SHELVES = 64  # folders of a kind in the artefact store
# Content types by file name ending; anything else is plain bytes.
CONTENT_TYPES = {
    "html": "text/html", "htm": "text/html", "md": "text/markdown", "txt": "text/plain", "json": "application/json",
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
}
PLAIN_BYTES = "application/octet-stream"


def read_chunks(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Chunk records from JSON arrays; an object that is no list of chunks is an error.

    ``multi_line=False`` reads one array per line, which Spark can split.
    """
    rows = spark.read.schema(CHUNK_SCHEMA).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    is_record = F.col("index").isNotNull() | F.col("page_content").isNotNull()
    return rows.filter(F.when(is_record, True).otherwise(F.raise_error(F.lit("not a list of chunk records")).cast("boolean")))


def chunk_key(rows: DataFrame) -> DataFrame:
    """``"5_0"`` style indexes to ``(original_index, split_part)``; parts count from 1, whole chunks are 0."""
    pieces = F.split("index", "_", 2)
    return rows.select(
        pieces[0].cast("int").alias("original_index"),
        F.coalesce(F.try_element_at(pieces, F.lit(2)).cast("int") + 1, F.lit(0)).alias("split_part"),
        "page_content",
        "metadata",
    )


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row ``(path, text)``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File bytes with name, size and time."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", F.col("_metadata.file_name").alias("file_name"), "length", "modificationTime", "content")
    )


def pdf_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)``: PDFs with a URL, and the rest with a reason."""
    has_url = F.coalesce(F.col("file_url"), F.lit("")) != ""
    is_pdf = F.coalesce(F.col("file_format"), F.lit("")) == "application/pdf"
    reason = F.when(~has_url, "no url").when(~is_pdf, "not a pdf")
    return files.filter(is_pdf & has_url), files.filter(~(is_pdf & has_url)).withColumn("reason", reason)


def list_by_substring(objects: DataFrame, name: str, prefix: str, substring: str, suffix: str = "") -> DataFrame:
    """Names below a prefix that contain a substring and end in a suffix."""
    test = F.col(name).startswith(prefix) & F.contains(F.col(name), F.lit(substring))
    return objects.filter(test & F.col(name).endswith(suffix)) if suffix else objects.filter(test)


def list_subdirs(objects: DataFrame, name: str, prefix: str) -> DataFrame:
    """Distinct first path level below a prefix, sorted."""
    base = prefix if prefix.endswith("/") else prefix + "/"
    rest = F.substr(F.col(name), F.lit(len(base) + 1))
    return (
        objects.filter(F.col(name).startswith(base) & F.contains(rest, F.lit("/")))
        .select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("subdir"))
        .filter("subdir <> ''")
        .distinct()
        .orderBy("subdir")
    )


def prefix_exists(objects: DataFrame, name: str, prefix: str) -> bool:
    return not objects.filter(F.col(name).startswith(prefix)).isEmpty()


def existing_prefixes(prefixes: DataFrame, prefix: str, objects: DataFrame, name: str) -> DataFrame:
    """The prefixes some object lies under. Prefixes end at a path level, so this is a hash join."""
    parts = F.split(name, "/", -1)
    levels = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))
    )
    known = objects.select(F.explode(levels).alias(prefix)).distinct()
    return prefixes.join(known, prefix, "left_semi")


def content_type(key: Column) -> Column:
    """Type of an object by the ending of its key, whatever its letter case."""
    ending = F.lower(F.regexp_extract(key, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(ending == e, F.lit(t)) for e, t in CONTENT_TYPES.items()], F.lit(PLAIN_BYTES))


def object_meta(objects: DataFrame, url: str, content: str, modified: Column | None = None) -> DataFrame:
    """Key, etag, type, length and time of change of objects; the etag is the content hash, its quotes stripped.

    ``modified`` is a timestamp of the listing (``_metadata.file_modification_time`` for files); null without one.
    """
    quoted = F.concat(F.lit('"'), F.md5(content), F.lit('"'))
    key = urls.object_key(F.col(url))
    return objects.withColumns(
        {
            "key": key,
            "etag": urls.bare_etag(quoted),
            "content_type": content_type(key),
            "length": F.octet_length(content).cast("bigint"),
            "modified": F.lit(None).cast("timestamp") if modified is None else modified,
        }
    )


def write_artifacts(spark: SparkSession, root: str, shelves: int = SHELVES, **kinds: DataFrame) -> None:
    """Append the artefacts of policies below ``root/kind/shelf=..``; policy and signature are columns.

    A policy's shelf is a hash of its number, so folders and files don't grow with the policies. Files are
    in order of policy and signature, so readers of one skip the rest by their statistics. Rows are
    spread by shelf and a salt, so a large policy is written by several tasks.
    """
    for kind, rows in kinds.items():
        if kind not in ARTEFACT_KINDS:
            raise ValueError(f"unknown artefact kind {kind}")
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if dict(rows.dtypes)[c][:3] != "map"]), F.lit(8)))
        shelved = salted.withColumn("shelf", F.pmod(F.xxhash64("policy_no"), F.lit(shelves)).cast("int"))
        shelved.repartition("shelf", "_salt").drop("_salt").sortWithinPartitions("shelf", "policy_no", "signature").write.mode(
            "append"
        ).partitionBy("shelf").parquet(f"{root}/{kind}")
