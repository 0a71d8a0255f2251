"""Which rows contain which needles, without a nested-loop join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clausemill.functions.binding import let
from clausemill.session import small_enough

ANCHOR_LENGTHS = (8, 4, 2, 1)
BROADCAST_NEEDLES = 500_000  # narrow rows of anchors that may be broadcast


def _grams(text: Column, size: Column | int) -> Column:
    """All distinct stretches of ``size`` characters."""
    empty = F.lit([]).cast("array<string>")

    def cut(chars: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(chars) - size + 1)
        return F.when(F.size(chars) >= size, F.transform(at, lambda i: F.array_join(F.slice(chars, i, size), ""))).otherwise(empty)

    return F.array_distinct(let(F.split(text, ""), cut))


def anchors(needles: DataFrame, needle: str) -> DataFrame:
    """``(needle, _size, _anchor)``: of each needle's stretches of 8 characters (4, 2 or 1 if it is shorter) the one that fewest needles have."""
    size = F.coalesce(*[F.when(F.length(needle) >= n, F.lit(n)) for n in ANCHOR_LENGTHS])
    cut = needles.select(needle, size.alias("_size")).select(needle, "_size", F.explode(_grams(F.col(needle), F.col("_size"))).alias("_anchor"))
    shared = cut.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n"))
    return cut.join(shared, "_anchor").groupBy(needle, "_size").agg(F.min_by("_anchor", F.struct("_n", "_anchor")).alias("_anchor"))


def contains_pairs(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Rows of ``texts`` paired with each distinct needle they contain; rows without a key and empty needles have no pairs.

    Stretches of a text meet needles by equality of the needle's anchor, as rows of the key alone;
    only texts that hold an anchor are then looked through for the whole needle.
    """
    wanted = needles.select(needle).where(f"length({needle}) > 0").distinct()
    chosen = anchors(wanted, needle)
    chosen = F.broadcast(chosen) if small_enough(wanted, BROADCAST_NEEDLES) else chosen
    sizes = [r[0] for r in chosen.select("_size").distinct().collect()]  # as many as anchor lengths at most
    if not sizes:
        return texts.withColumn(needle, F.lit(None).cast("string")).limit(0)
    grams = F.array_distinct(F.concat(*[_grams(F.col(text), n) for n in sizes]))
    held = texts.select(key, F.explode(grams).alias("_anchor")).join(chosen, "_anchor").select(key, needle).distinct()
    return texts.join(held, key).filter(F.contains(F.col(text), F.col(needle)))
