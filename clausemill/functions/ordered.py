"""Ordered aggregates over a document, page, table or request."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ordered_list(order: list[Column], value: Column) -> Column:
    """Values of a group as an array in the given total order.

    For groups of one document's or one request's size. Nothing here caps the
    group, so do not use it with keys that span a corpus.
    """
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    return F.transform(
        F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda x: x["v"]
    )


def ordered_join(order: list[Column], value: Column, sep: str) -> Column:
    return F.array_join(ordered_list(order, value), sep)


def null_if_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
