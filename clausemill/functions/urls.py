"""URL and object-name columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def filename_from_url(url: Column) -> Column:
    """Last path segment, decoded; null where the path ends in a slash or is missing."""
    last = F.element_at(F.split(F.try_parse_url(url, F.lit("PATH")), "/", -1), -1)
    return F.nullif(F.url_decode(last), F.lit(""))


def object_key(url: Column) -> Column:
    """Decoded path of an object, without the leading slash."""
    return F.url_decode(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/", ""))


def bare_etag(etag: Column) -> Column:
    return F.regexp_replace(etag, '^"+|"+$', "")


def link_targets(html: Column, needle: str = "pdf") -> Column:
    """Distinct link targets that contain the needle, in order of first appearance."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.array_distinct(F.filter(found, lambda u: F.contains(u, F.lit(needle))))
