"""Box predicates and measures. A box is four columns with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

COORDS = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in COORDS)


def area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def inside(a, b) -> Column:
    """Box ``a`` lies in box ``b``; equal boxes lie in each other."""
    return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])


def touches(a, b) -> Column:
    return (F.greatest(a[0], b[0]) <= F.least(a[2], b[2])) & (F.greatest(a[1], b[1]) <= F.least(a[3], b[3]))


def intersection(a, b) -> Column:
    """Common area; 0 for boxes that only touch or are apart."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    return w * h


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def iou(a, b) -> Column:
    common = intersection(a, b)
    return _share(common, area(a) + area(b) - common)


def overlap_of_smaller(a, b) -> Column:
    return _share(intersection(a, b), F.least(area(a), area(b)))


def overlap_of_first(a, b) -> Column:
    return _share(intersection(a, b), area(a))


def relative_position(a, b) -> Column:
    """``(left, right, above, below)``: where box ``b`` lies wholly beside box ``a``."""
    return F.struct(
        (b[2] < a[0]).alias("left"), (a[2] < b[0]).alias("right"), (b[3] < a[1]).alias("above"), (a[3] < b[1]).alias("below")
    )


def gap_distance(a, b) -> Column:
    """Length of the shortest line between two boxes; 0 where they overlap."""
    dx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0))
    dy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0))
    return F.sqrt(dx * dx + dy * dy)


def corner_distance(a, b) -> Column:
    """City-block distance of the top left corners plus that of the bottom right ones, the smaller counted twice."""
    start = F.abs(a[0] - b[0]) + F.abs(a[1] - b[1])
    end = F.abs(a[2] - b[2]) + F.abs(a[3] - b[3])
    return start + end + F.least(start, end)


def axis_overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Share of the shorter of two spans that both have."""
    common = F.greatest(F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b), F.lit(0))
    return _share(common, F.least(hi_a - lo_a, hi_b - lo_b))


def x_overlap(a, b) -> Column:
    return axis_overlap(a[0], a[2], b[0], b[2])


def y_overlap(a, b) -> Column:
    return axis_overlap(a[1], a[3], b[1], b[3])


def rounded(x: Column, digits: int = 0) -> Column:
    """``F.round`` of a double, with the same result in plain arithmetic.

    Only values beside a half of the last digit, and very large ones, need the decimal numbers of ``F.round``,
    which cost more than the rest of a box.
    """
    scaled = x * float(10**digits)
    down = F.floor(scaled)
    plain = (F.abs(scaled) < 1e12) & (F.abs(scaled - down - 0.5) > 1e-3)
    return F.when(plain, F.floor(scaled + 0.5).cast("double") / float(10**digits)).otherwise(F.round(x, digits))


def from_polygon(poly: Column, scale: float) -> Column:
    """Whole-pixel box of a four-corner polygon ``x,y,x,y..`` at page scale."""
    return F.struct(*[F.floor(poly[i] / scale).cast("int").alias(c) for c, i in zip(COORDS, (0, 1, 4, 5))])


def from_relative(b, width: Column, height: Column) -> Column:
    """Pixel box of a box in shares of the page; swapped corners are put right."""
    x = [(b[i] * width).cast("int") for i in (0, 2)]
    y = [(b[i] * height).cast("int") for i in (1, 3)]
    return F.struct(
        F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1")
    )


def to_thousandths(b, width: Column, height: Column) -> Column:
    return F.struct(*[(b[i] * 1000 / (width, height)[i % 2]).cast("int").alias(c) for i, c in enumerate(COORDS)])
