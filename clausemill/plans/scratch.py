"""Folders for the tables that registered queries write and read back."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one the cluster names; a local one only in local sessions."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/clausemill-{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix=f"clausemill-{name}-")


_KEPT: dict[tuple, str] = {}


def kept(spark: SparkSession, name: str, table: str, build: Callable[[str], object]) -> str:
    """Folder of what ``build(folder)`` writes from the files at ``table``, made once per application and content.

    Equal content is told by path, length and time of change. A folder that a failed build left is not used again.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    changed = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path))
    key = (spark.sparkContext.applicationId, name, table, tuple(changed))
    if key not in _KEPT:
        folder = os.path.join(scratch(spark, name), name)
        build(folder)
        _KEPT[key] = folder
    return _KEPT[key]
