"""Small dictionaries as literals: lookups and keyword scans without a join.

The dictionaries are the fixed lists of :mod:`clausemill.functions.dims`, so
their size does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def literal_map(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def look_up(entries: Mapping[str, str], code: Column) -> Column:
    """The entry for a code; an unknown code stays as it is."""
    return F.coalesce(F.try_element_at(literal_map(entries), code), code)


def pairs(entries: Iterable[tuple[str, str]]) -> Column:
    """Array of ``(key, value)`` in the given order."""
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in entries])


def matches(text: Column, entries: Iterable[tuple[str, str]]) -> Column:
    """Values whose key occurs in the text, in dictionary order."""
    return F.transform(F.filter(pairs(entries), lambda p: F.contains(text, p["key"])), lambda p: p["value"])


def first_match(text: Column, entries: Iterable[tuple[str, str]]) -> Column:
    return F.try_element_at(matches(text, entries), F.lit(1))
