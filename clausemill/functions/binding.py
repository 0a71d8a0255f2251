"""Bind a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    The optimizer may inline a projected column into a lambda, where it would be
    evaluated per array element. A lambda variable is never inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
