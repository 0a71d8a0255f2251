"""Where users plug in their own functions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

# SQL text of the functions users can call from spark.sql.
SQL_FUNCTIONS = {
    "cm_strip_index_mark": (r"title STRING", "STRING", r"trim(regexp_replace(title, '\\s*\\[\\d+(?:-\\d+)?\\]$', ''))"),
    "cm_days": ("t STRING", "INT", r"try_cast(regexp_extract(t, '(\\d+)\\s*[天日]', 1) AS INT)"),
    "cm_similarity": ("distance DOUBLE", "DOUBLE", "1 / (1 + distance)"),
    "cm_overlap": (
        "lo_a DOUBLE, hi_a DOUBLE, lo_b DOUBLE, hi_b DOUBLE", "DOUBLE",
        "greatest(least(hi_a, hi_b) - greatest(lo_a, lo_b), 0) / least(hi_a - lo_a, hi_b - lo_b)",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the functions as SQL expressions, which the optimizer inlines; no Python runs per row."""
    for name, (args, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(SQL_FUNCTIONS)


def score_with(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int | None = None) -> DataFrame:
    """Run a user's scorer or embedder over Arrow batches, ``batch`` rows at a time if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = batch or max(len(pdf), 1)
            for at in range(0, len(pdf), step):
                yield fn(pdf.iloc[at : at + step])

    return rows.mapInPandas(run, schema)


_MASK_BITS = 62


def per_page(rows: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a user's own rule on each page; a page must fit a task.

    Pages reach the rule as slices of Arrow batches, not as a batch each. Whole numbers and booleans would change
    their type in a whole batch for one null; their nulls travel as bits, so only a page that has one sees that.
    """
    kinds = dict(rows.dtypes)
    whole = [c for c, t in kinds.items() if t in ("tinyint", "smallint", "int", "bigint", "boolean")]
    marked = [*whole, *[c for c in keys if c not in whole]]
    chunks = [marked[i : i + _MASK_BITS] for i in range(0, len(marked), _MASK_BITS)]
    masks = [f"_nulls{i}" for i in range(len(chunks))]
    bits = [
        functools.reduce(lambda a, b: a + b, [F.when(F.col(f"`{c}`").isNull(), 1 << k).otherwise(0).cast("bigint") for k, c in enumerate(chunk)])
        for chunk in chunks
    ]
    filled = [F.coalesce(f"`{c}`", F.lit(0).cast(kinds[c])).alias(c) if c in whole else F.col(f"`{c}`") for c in rows.columns]
    key_bits = {m: sum(1 << k for k, c in enumerate(chunk) if c in keys) for m, chunk in zip(masks, chunks, strict=True)}

    def starts(batch: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(batch), dtype=bool)
        new[0] = True
        for key in keys:
            values = batch[key]
            new[1:] |= ((values != values.shift()) & ~(values.isna() & values.shift().isna())).to_numpy()[1:]
        for mask, of_keys in key_bits.items():
            values = batch[mask].to_numpy() & of_keys
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def page(part: pd.DataFrame, holes: int, mask: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        for m, chunk in zip(masks, chunks, strict=True) if holes else ():
            for k, c in enumerate(chunk):
                null = (mask[m].to_numpy() >> k) & 1 == 1
                if c in whole and null.any():
                    part[c] = part[c].astype("object").where(~null, None) if kinds[c] == "boolean" else part[c].astype("float64").mask(null)
        return fn(part)

    def judged(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        at = [*starts(batch), len(batch)]
        mask, part = batch[masks], batch.drop(columns=masks)
        holes = np.bitwise_or.reduceat(np.bitwise_or.reduce(mask.to_numpy(), axis=1), at[:-1])
        for i, lo in enumerate(at[:-1]):
            yield page(part.iloc[lo : at[i + 1]], holes[i], mask.iloc[lo : at[i + 1]])

    def joined(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        alike: dict[tuple, list[pd.DataFrame]] = {}  # results of other types keep them
        for found in judged(batch):
            if len(found):
                alike.setdefault((*found.columns, *found.dtypes), []).append(found)
        for parts in alike.values():
            yield pd.concat(parts, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            edge = batch if not held else pd.concat([held[-1].iloc[-1:], batch], ignore_index=True)
            at = starts(edge) - bool(held)
            last = int(at[-1])
            if last < 0:  # all of it goes on with the page held
                held.append(batch)
                continue
            done = pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            if len(done):
                yield from joined(done)
            held = [batch.iloc[last:]]
        if held:
            yield from joined(pd.concat(held, ignore_index=True))

    marks = [bit.alias(m) for bit, m in zip(bits, masks, strict=True)]
    spread = rows.repartition(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys])
    return spread.select(*filled, *marks).mapInPandas(run, schema)


def box_union(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hull of each group's boxes."""
    return rows.groupBy(*keys).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def register_table_functions(spark: SparkSession) -> None:
    """``cm_windows(text, size, overlap)`` as a table function; the native form is ``markdown.windows``."""

    @udtf(returnType="part: int, chunk: string")
    class Windows:
        def eval(self, text: str, size: int, overlap: int):
            at, part = 0, 0
            while True:
                yield part, text[at : at + size]
                if at + size >= len(text):
                    return
                at, part = at + size - overlap, part + 1

    spark.udtf.register("cm_windows", Windows)
