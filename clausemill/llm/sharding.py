"""Sharding by extendible hashing.

Shards are named by leading bits of a hash. Only a shard over its byte limit is split on
one more bit, so the directory is deep where the bytes are and shallow elsewhere. The bytes
of all prefixes of a stretch of bits are summed at once; rows of shards that even the last
of these bits leaves too large go on with the next stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clausemill.llm.common import cut_lineage, small_side, text_of

HASH_BITS = 60
BITS_AT_ONCE = 12


def _bits() -> Column:
    """Leading bits of the MD5 of id and text; a null id counts as empty."""
    content = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_of())
    return F.lpad(F.conv(F.substring(F.md5(content), 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def _n_bytes() -> Column:
    return F.octet_length(text_of()).cast("long")


def directory(rows: DataFrame, max_bytes: int) -> DataFrame:
    """``(shard, depth, shard_bytes, n_docs)``: the shards' bit prefixes for rows ``(bits, n_bytes)``.

    A shard is over the limit only if all its rows have one hash: a single larger document,
    or rows that repeat both id and text. The root's prefix is empty.
    """
    left, base, parts = rows.select("bits", "n_bytes"), 0, []
    while True:
        end = min(base + BITS_AT_ONCE, HASH_BITS)
        fine = left.groupBy(F.substring("bits", 1, end).alias("bits")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_docs")
        )
        # At most 2 ** BITS_AT_ONCE prefixes below each shard that is still too large.
        each = fine.select("n_bytes", "n_docs", F.explode(F.transform(
            F.sequence(F.lit(base), F.lit(end)), lambda d: F.struct(d.alias("depth"), F.substring(F.col("bits"), F.lit(1), d).alias("shard"))
        )).alias("p")).groupBy("p.depth", "p.shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("n_docs"))
        each = cut_lineage(each)
        large = each.filter(F.col("shard_bytes") > max_bytes).select(
            F.col("depth").alias("up_depth"), F.col("shard").alias("up")
        )
        fits = each.filter((F.col("shard_bytes") <= max_bytes) | ((F.col("depth") == HASH_BITS)))
        # A shard stands where its parent had to be split.
        parent = F.substring(F.col("shard"), F.lit(1), F.col("depth") - 1)
        roots = fits.filter(F.col("depth") == 0)
        split = fits.filter(F.col("depth") > base).join(
            small_side(large), (F.col("up_depth") == F.col("depth") - 1) & (F.col("up") == parent), "left_semi"
        )
        parts.append(split if base else split.unionByName(roots))
        over = large.filter(F.col("up_depth") == end).select(F.col("up").alias("bits"))
        if end == HASH_BITS or over.isEmpty():
            break
        left = left.withColumn("head", F.substring("bits", 1, end)).join(
            small_side(over.withColumnRenamed("bits", "head")), "head", "left_semi"
        ).drop("head")
        base = end
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("shard", "depth", "shard_bytes", "n_docs")


def _in_shard(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Each row with its shard: of its prefixes in the depths in use exactly one is a shard."""
    depths = sorted(r[0] for r in table.select("depth").distinct().collect())  # at most HASH_BITS + 1
    tries = F.explode(F.array(*(F.substring("bits", 1, d) for d in depths or [0])))
    return rows.withColumn("shard", tries).join(small_side(table), "shard")


def shards(docs: DataFrame, max_bytes: int) -> DataFrame:
    """``(doc_id, n_bytes, shard, depth, shard_bytes)`` of every row.

    Null text has no bytes, a null id hashes as empty; rows that repeat id and text share a shard. No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _n_bytes().alias("n_bytes"), _bits().alias("bits"))
    table = cut_lineage(directory(rows, max_bytes))
    return _in_shard(rows, table).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")


def write_shards(docs: DataFrame, max_bytes: int, folder: str) -> None:
    """Write the columns of ``docs`` as Parquet, one folder ``shard_name=...`` per shard (the root's is ``root``).

    If ``docs`` has a column of that name, the folders' name has underscores before it.
    """
    name = _folder_column(docs.columns)
    rows = docs.select(F.struct(*docs.columns).alias("row"), _n_bytes().alias("n_bytes"), _bits().alias("bits"))
    table = cut_lineage(directory(rows, max_bytes)).select("shard", "depth")
    named = _in_shard(rows, table).select(
        "row.*", F.when(F.col("shard") == "", "root").otherwise(F.col("shard")).alias(name)
    )
    named.repartition(name).write.partitionBy(name).parquet(folder)


def _folder_column(columns: list[str]) -> str:
    name, taken = "shard_name", {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def read_shards(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    """``(doc_id, n_bytes, shard, depth, shard_bytes)`` of the rows that :func:`write_shards` wrote with columns of ``schema``."""
    # Named as a string, or a prefix such as 0101 would be read as a number.
    name = _folder_column(schema.names)
    rows = spark.read.schema(StructType([*schema.fields, StructField(name, StringType())])).parquet(folder).select(
        F.col("doc_id").cast("long").alias("doc_id"), _n_bytes().alias("n_bytes"),
        F.when(F.col(name) == "root", "").otherwise(F.col(name)).alias("shard"),
    )
    totals = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return rows.join(small_side(cut_lineage(totals)), "shard").select(
        "doc_id", "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes"
    )
