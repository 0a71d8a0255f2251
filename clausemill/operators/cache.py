"""Replay of a result cache with a fixed time to live."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from clausemill.operators.groups import group_starts, map_sorted_groups

CHUNK_TTLS = 16


class _Chunks:
    """Arrays over whole (key, chunk) groups, with times made comparable across groups."""

    def __init__(self, rows: pd.DataFrame, column: str, width: int, ttl: int):
        self.starts = group_starts(rows, ["k", "chunk"])
        self.sizes = np.diff(np.append(self.starts, len(rows)))
        self.ends = self.starts + self.sizes
        self.group = np.repeat(np.arange(len(self.starts)), self.sizes)
        self.chunk = rows["chunk"].to_numpy()[self.starts]
        self.stamps = rows[column].to_numpy()
        self.width, self.ttl = width, ttl
        self.span = width + 2 * ttl + 2
        if len(self.starts) * self.span > 2**62:
            raise ValueError("time to live too large for this batch size; lower maxRecordsPerBatch")
        self.code = self.group * self.span + (self.stamps - self.chunk[self.group] * width)

    def first_after(self, groups: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Place of the first row of each group later than a time; the group's end if there is none."""
        offset = np.clip(times - self.chunk[groups] * self.width, -1, self.span - 1)
        at = np.searchsorted(self.code, groups * self.span + offset, side="right")
        return np.clip(at, self.starts[groups], self.ends[groups])

    def next_miss(self) -> np.ndarray:
        return self.first_after(self.group, self.stamps + self.ttl)


def query_cache(log: DataFrame, key: str, ts: str, ttl: int, chunk_ttls: int = CHUNK_TTLS) -> DataFrame:
    """``(key, ts, hit)`` per log row; ``ts`` and ``ttl`` are whole microseconds.

    A hit is a row within ``ttl`` of the last miss of its key and leaves that miss in
    place. Which rows miss depends on the whole past of the key, yet a key is not
    one task's work: its time line is cut into chunks, each chunk reports only
    where a chain of misses would leave it for every way to enter it, the chunks
    are linked per key, and then all chunks are replayed side by side.
    """
    width = ttl * chunk_ttls
    rows = log.select(F.col(key).alias("k"), F.col(ts).cast("long").alias("ts")).withColumn(
        "chunk", F.floor(F.col("ts") / width).cast("long")
    )
    key_type = dict(rows.dtypes)["k"]

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _Chunks(pdf, "ts", width, ttl)
        after = c.next_miss()
        last = np.where(after < c.ends[c.group], after, np.arange(len(after)))
        while True:  # double the steps until every chain has reached its end
            further = last[last]
            if (further == last).all():
                break
            last = further
        # A chain enters no later than at the first row that is one ttl into the chunk.
        groups = np.arange(len(c.starts))
        entry_end = c.first_after(groups, c.chunk * width + ttl - 1)
        entry = np.arange(len(after)) <= entry_end[c.group]
        leave = c.stamps[last]
        same = np.zeros(len(after), dtype=bool)
        same[:-1] = (c.group[1:] == c.group[:-1]) & (leave[1:] == leave[:-1]) & entry[1:]
        keep = entry & ~same
        return pd.DataFrame(
            {"k": pdf["k"][keep], "chunk": pdf["chunk"][keep], "enter": c.stamps[keep], "leave": leave[keep]}
        )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _Chunks(pdf, "enter", width, ttl)
        leave = pdf["leave"].to_numpy()
        firsts = np.isin(c.starts, group_starts(pdf, ["k"]))
        of_key = np.cumsum(firsts) - 1
        order = np.arange(len(c.starts)) - np.flatnonzero(firsts)[of_key]
        anchor = np.zeros(len(c.starts), dtype=np.int64)
        held = np.full(int(of_key[-1]) + 1, np.iinfo(np.int64).min // 2)
        for step in range(int(order.max()) + 1):  # the j-th chunk of all keys at once
            now = np.flatnonzero(order == step)
            anchor[now] = held[of_key[now]]
            at = c.first_after(now, anchor[now] + ttl)
            entered = at < c.ends[now]
            held[of_key[now[entered]]] = leave[at[entered]]
        return pd.DataFrame(
            {"k": pdf["k"].to_numpy()[c.starts], "chunk": c.chunk, "anchor": anchor}
        )

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _Chunks(pdf, "ts", width, ttl)
        after = c.next_miss()
        hit = np.ones(len(after), dtype=bool)
        groups = np.arange(len(c.starts))
        at = c.first_after(groups, pdf["anchor"].to_numpy()[c.starts] + ttl)
        while len(at):  # one miss of every chunk at once
            live = at < c.ends[groups]
            at, groups = at[live], groups[live]
            hit[at] = False
            at = after[at]
        return pd.DataFrame({"k": pdf["k"], "ts": c.stamps, "hit": hit})

    ways = map_sorted_groups(rows, ["k", "chunk"], ["ts"], exits, f"k {key_type}, chunk long, enter long, leave long")
    anchors = map_sorted_groups(ways, ["k"], ["chunk", "enter"], link, f"k {key_type}, chunk long, anchor long")
    replayed = map_sorted_groups(
        rows.join(anchors, ["k", "chunk"]), ["k", "chunk"], ["ts"], replay, f"k {key_type}, ts long, hit boolean"
    )
    return replayed.withColumnRenamed("k", key).withColumnRenamed("ts", ts)


def cache_stats(replayed: DataFrame, *by: str) -> DataFrame:
    """Hits, misses and hit rate (0 for an empty log)."""
    counted = replayed.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"),
        F.coalesce(F.sum((~F.col("hit")).cast("long")), F.lit(0)).alias("misses"),
    )
    total = F.col("hits") + F.col("misses")
    return counted.withColumn("hit_rate", F.when(total > 0, F.round(F.col("hits") / total, 6)).otherwise(0.0))
