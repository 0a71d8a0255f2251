"""Structured Streaming forms: ingest, dedup, windows, cache state, coding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausemill.operators.ingest import exact_dedup


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A growing table of parquet files, or one file, as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A stream takes a folder, or a pattern; as a pattern the name fits a folder of files as well as a file.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}[.]parquet")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there, hand each batch to ``sink``, then stop. Restarts go on from the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    )
    query.awaitTermination()


def batch_writer(path: str, mode: str = "append") -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    return write


def ingest(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Run a batch operator on each new set of documents."""
    writer = batch_writer(path)
    run_available(stream, lambda batch, batch_id: writer(operator(batch), batch_id), checkpoint)


def dedup_into(stream: DataFrame, content: str, order: list[str], path: str, checkpoint: str) -> None:
    """Append the first row of each content to ``path``, with its ``content_md5``, however far copies are apart.

    Copies within a batch go by :func:`exact_dedup` in the given order, copies of earlier batches by
    an anti join with the stored hashes. A repeated batch replaces itself and does not see its own rows.
    """
    writer = batch_writer(path)
    spark = stream.sparkSession
    spark.createDataFrame([], "content_md5 string, batch long").write.mode("append").partitionBy("batch").parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = batch.sparkSession.read.schema("content_md5 string, batch long").parquet(path)
        seen = stored.filter(F.col("batch") != batch_id).select(F.col("content_md5").alias("seen"))
        rows = exact_dedup(batch, content, order)
        writer(rows.join(seen, rows["content_md5"].eqNullSafe(seen["seen"]), "left_anti"), batch_id)

    run_available(stream, write, checkpoint)


def window_counts(stream: DataFrame, key: str, ts: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = stream.withWatermark(ts, delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def session_counts(stream: DataFrame, key: str, ts: str, gap: str, delay: str = "1 hour") -> DataFrame:
    counted = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def ttl_cache(stream: DataFrame, key: str, ts: str, ttl: int) -> DataFrame:
    """``(key, ts, hit)`` with the last miss of each key as state; rows of a key must arrive in time order."""

    def replay(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps = pd.concat([b[ts] for b in batches]).sort_values().to_numpy()
        anchor = state.get[0] if state.exists else None
        hits = []
        for t in stamps:
            hit = anchor is not None and t - anchor <= ttl
            hits.append(hit)
            if not hit:
                anchor = int(t)
        state.update((anchor,))
        yield pd.DataFrame({key: k[0], ts: stamps, "hit": hits})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(
        replay, f"{key} {kind}, {ts} long, hit boolean", "anchor long", "append", GroupStateTimeout.NoTimeout
    )


def code_stream(stream: DataFrame, static: DataFrame, keys: list[str]) -> DataFrame:
    """Stream rows with their codes from a static table; left join, so uncoded rows stay."""
    return stream.join(static, keys, "left")
