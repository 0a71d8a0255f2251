"""Sorted-partition streaming for numpy work over many groups at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def map_sorted_groups(
    df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply ``fn`` to frames of whole groups of ``keys``, sorted by keys and ``order``.

    A frame holds all groups an Arrow batch completes, so ``fn`` can work on arrays
    that span groups; only the group at a batch border is carried along.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            start = int(group_starts(batch, keys)[-1])
            if held and start == 0 and all(held[0][k].iloc[0] == batch[k].iloc[0] for k in keys):
                held.append(batch)
                continue
            done = pd.concat([*held, batch.iloc[:start]], ignore_index=True)
            if len(done):
                yield fn(done)
            held = [batch.iloc[start:]]
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    spread = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return spread.mapInPandas(run, schema)


def group_starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Places where a new group begins in rows sorted by ``keys``."""
    new = np.zeros(len(rows), dtype=bool)
    if len(rows):
        new[0] = True
    for key in keys:
        values = rows[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
