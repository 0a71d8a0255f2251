"""Helpers the operators share: shared files, worker state, checked broadcasts, documents by content."""

from __future__ import annotations

import sys
import types

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.plans.scratch import scratch
from clausemill.session import cut_lineage, small_enough

BROADCAST_ROWS = 50_000
ARROW_ROWS = 1_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share (below ``spark.checkpoint.dir``)."""
    return scratch(spark, name)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named by URI or absolute path, for use inside tasks."""
    return fs.FileSystem.from_uri(uri)


def arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, so that a Python worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    name = "_clausemill_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``max_rows`` narrow rows, else as it is."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that later steps never recompute it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, name)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't use, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def text_of(text: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


__all__ = [
    "ARROW_ROWS", "BROADCAST_ROWS", "arrow_batches", "cut_lineage", "free_name", "open_folder",
    "shared_folder", "small_side", "stored", "text_of", "worker_state",
]
