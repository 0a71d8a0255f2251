"""Table cells as rows, and back to HTML."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from clausemill.functions import tables as T
from clausemill.functions.ordered import ordered_join


def _columns(tables: pa.Array) -> pa.Array:
    """First column of every cell of tables of ``(row_span, col_span)``, whose cells may hang down into later rows; null for null."""
    rows = tables.flatten()
    cells = rows.flatten()
    n_rows, n_cells = pc.list_value_length(tables), pc.list_value_length(rows).to_pylist()
    spans = zip(cells.field("row_span").to_pylist(), cells.field("col_span").to_pylist(), strict=True)
    out: list[int] = []
    row_lengths = iter(n_cells)
    for n in n_rows.to_pylist():
        until: dict[int, int] = {}  # first row in which a column is free again
        for r in range(n or 0):
            c = 0
            for row_span, col_span in itertools.islice(spans, next(row_lengths)):
                while until and until.get(c, 0) > r:
                    c += 1
                out.append(c)
                if row_span > 1:
                    until.update((k, max(until.get(k, 0), r + row_span)) for k in range(c, c + col_span))
                c += col_span

    def ends(lengths: list) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)

    by_row = pa.ListArray.from_arrays(pa.array(ends(n_cells)), pa.array(out, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(ends(n_rows.fill_null(0).to_pylist())), by_row, mask=tables.is_null())


def table_cells(tables: DataFrame, keys: list[str], html: str) -> DataFrame:
    """``(keys, r, c, row_span, col_span, text)``; columns count what row spans occupy.

    One pass over the tables. Only the spans of tables with row spans leave the JVM.
    """
    hangs = F.exists("_cells", lambda row: F.exists(row, lambda x: x["row_span"] > 1))
    spans = F.transform("_cells", lambda row: F.transform(row, lambda x: F.struct(x["row_span"].alias("row_span"), x["col_span"].alias("col_span"))))
    parsed = tables.select(*keys, F.transform(T.table_rows(F.col(html)), T.row_cells).alias("_cells"))
    placed = parsed.withColumn("_c", F.arrow_udf(_columns, "array<array<int>>")(F.when(hangs, spans))).select(*keys, "_c", F.posexplode("_cells").alias("r", "_row"))
    hung = F.zip_with("_row", F.element_at("_c", F.col("r") + 1), lambda x, c: x.withField("c", c))
    cells = F.when(F.col("_c").isNull(), T.placed_cells(F.col("_row"))).otherwise(hung)
    return placed.select(*keys, "r", F.explode(cells).alias("x")).select(*keys, "r", "x.c", "x.row_span", "x.col_span", "x.text")


def cells_to_html(cells: DataFrame, key: str) -> DataFrame:
    """One HTML table per key; every cell once at its origin, its text escaped."""
    text = F.col("text")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    spans = [
        F.when(F.col(c) > 1, F.concat(F.lit(f' {a}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
        for c, a in (("row_span", "rowspan"), ("col_span", "colspan"))
    ]
    cell = F.concat(F.lit("<td"), *spans, F.lit(">"), text, F.lit("</td>"))
    rows = cells.groupBy(key, "r").agg(ordered_join([F.col("c")], cell, "").alias("row"))
    body = ordered_join([F.col("r")], F.concat(F.lit("<tr>"), F.col("row"), F.lit("</tr>")), "")
    return rows.groupBy(key).agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))
