"""Set-based rules over detected boxes of pages.

Boxes meet only where they can touch: the join key is the page and a grid cell, so
a crowded page is spread over its cells, and a pair is kept only in the cell of
its common corner, so it comes out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.functions import boxes as B
from clausemill.session import cut_lineage

CELL = 200
REGIONS = {1: "title", 2: "text", 3: "table", 4: "image", 5: "equation", 6: "discarded", 7: "footnote"}


def _cells(rows: DataFrame, prefix: str, cell: int) -> DataFrame:
    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(prefix + lo) / cell), F.floor(F.col(prefix + hi) / cell))

    return rows.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def touching_pairs(left: DataFrame, right: DataFrame, page: str, columns: list[str], cell: int = CELL) -> DataFrame:
    """Pairs ``(page, a_*, b_*)`` of boxes that overlap or touch, each pair once."""
    a = _cells(left.select(page, *[F.col(c).alias(f"a_{c}") for c in columns]), "a_", cell)
    b = _cells(right.select(page, *[F.col(c).alias(f"b_{c}") for c in columns]), "b_", cell)
    corner = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("cx")) & (
        F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("cy")
    )
    return a.join(b, [page, "cx", "cy"]).filter(B.touches(B.box("a_"), B.box("b_")) & corner).drop("cx", "cy")


_COLUMNS = ["box_id", *B.COORDS, "score"]


def self_pairs(rows: DataFrame, page: str, cell: int = CELL) -> DataFrame:
    """Ordered pairs of different boxes of a page that overlap or touch."""
    return touching_pairs(rows, rows, page, _COLUMNS, cell).filter("a_box_id <> b_box_id")


def _without(rows: DataFrame, losers: DataFrame, page: str) -> DataFrame:
    return rows.join(losers.select(page, F.col("a_box_id").alias("box_id")).distinct(), [page, "box_id"], "left_anti")


def drop_low_score(rows: DataFrame, floor: float = 0.05) -> DataFrame:
    return rows.filter(F.col("score") > floor)


def keep_text_hits(rows: DataFrame, score: float = 0.5, width: int = 3) -> DataFrame:
    return rows.filter((F.col("score") >= score) & (F.col("x1") - F.col("x0") >= width))


def suppress_duplicates(rows: DataFrame, page: str, threshold: float = 0.9) -> DataFrame:
    """A box loses to any better one of nearly the same place; equal scores: the lower id stays."""
    better = (F.col("b_score") > F.col("a_score")) | (
        (F.col("b_score") == F.col("a_score")) & (F.col("b_box_id") < F.col("a_box_id"))
    )
    losers = self_pairs(rows, page).filter((B.iou(B.box("a_"), B.box("b_")) > threshold) & better)
    return _without(rows, losers, page)


def drop_contained(rows: DataFrame, page: str, keep_equal: bool = False) -> DataFrame:
    """Remove boxes inside another. Equal boxes remove each other unless ``keep_equal`` keeps the first."""
    a, b = B.box("a_"), B.box("b_")
    test = B.inside(a, b)
    if keep_equal:
        test = test & (~B.inside(b, a) | (F.col("b_box_id") < F.col("a_box_id")))
    return _without(rows, self_pairs(rows, page).filter(test), page)


def absorb_small(rows: DataFrame, page: str, threshold: float = 0.8, grow: bool = True) -> DataFrame:
    """A box mostly covered by a larger one goes; its largest cover grows to hold it. One pass, no chains."""
    a, b = B.box("a_"), B.box("b_")
    larger = (B.area(b) > B.area(a)) | ((B.area(b) == B.area(a)) & (F.col("b_box_id") < F.col("a_box_id")))
    covers = (
        self_pairs(rows, page)
        .filter((B.overlap_of_smaller(a, b) > threshold) & larger)
        .groupBy(page, "a_box_id", *[f"a_{c}" for c in B.COORDS])
        .agg(F.max_by("b_box_id", F.struct(B.area(b), -F.col("b_box_id"))).alias("owner"))
    )
    kept = _without(rows, covers, page)
    if not grow:
        return kept
    grown = covers.groupBy(page, F.col("owner").alias("box_id")).agg(
        F.min("a_x0").alias("gx0"), F.min("a_y0").alias("gy0"), F.max("a_x1").alias("gx1"), F.max("a_y1").alias("gy1")
    )
    return kept.join(grown, [page, "box_id"], "left").withColumns(
        {
            "x0": F.least("x0", "gx0"), "y0": F.least("y0", "gy0"), "x1": F.greatest("x1", "gx1"), "y1": F.greatest("y1", "gy1"),
        }
    ).drop("gx0", "gy0", "gx1", "gy1")


def _linked(edges: DataFrame, page: str) -> DataFrame:
    """``(page, node, label)`` of the nodes that have an edge.

    Labels spread along edges and jump to their label's label, so rounds grow with
    the logarithm of a chain; labels only fall, so the loop ends by itself. Each round is checkpointed, its stop test is one count.
    """
    # Both ways of an edge come from one row, so that what finds the edges runs once.
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(edges.select(page, F.inline(ways)).distinct())
    labels = cut_lineage(both.select(page, F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    while True:
        heard = (
            both.join(labels.withColumnsRenamed({"node": "b"}), [page, "b"])
            .groupBy(page, F.col("a").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        spread = labels.join(heard, [page, "node"], "left").select(
            page, "node", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label")
        )
        jump = labels.select(page, F.col("node").alias("label"), F.col("label").alias("far"))
        after = cut_lineage(
            spread.join(jump, [page, "label"]).select(page, "node", "old", F.least("label", "far").alias("label"))
        )
        if after.filter("old <> label").isEmpty():
            return after.drop("old")
        labels = after.drop("old")


def connected(edges: DataFrame, nodes: DataFrame, page: str) -> DataFrame:
    """``(page, node, label)``: the lowest node of each connected group. Nodes without an edge are their own group."""
    return nodes.select(page, "node").join(_linked(edges, page), [page, "node"], "left").withColumn(
        "label", F.coalesce("label", "node")
    )


def union_tables(rows: DataFrame, page: str, threshold: float = 0.7) -> DataFrame:
    """Boxes of nearly the same place become their common hull, groups taken transitively."""
    edges = self_pairs(rows, page).filter(B.iou(B.box("a_"), B.box("b_")) > threshold).select(
        page, F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b")
    )
    hull = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    # Only boxes with an edge have a label to look up, so the boxes are joined with those few and not with all.
    # A box that is given n times counts with each of its rows, n times n in all.
    known = rows.filter(F.col(page).isNotNull() & F.col("box_id").isNotNull()).groupBy(page, "box_id").agg(*hull, F.count("*").alias("_n"))
    return (
        known.join(_linked(edges, page).withColumnRenamed("node", "box_id"), [page, "box_id"], "left")
        .groupBy(page, F.coalesce("label", "box_id").alias("box_id"))
        .agg(*hull, F.sum(F.col("_n") * F.col("_n")).alias("n_boxes"))
    )


def _inner_pairs(rows: DataFrame, page: str, share: float = 0.8) -> DataFrame:
    """Pairs of a smaller box ``a`` that lies in a larger box ``b`` to the given share of its area."""
    a, b = B.box("a_"), B.box("b_")
    return self_pairs(rows, page).filter((B.overlap_of_first(a, b) >= share) & (B.area(a) < B.area(b)))


def drop_container_tables(rows: DataFrame, page: str, n_inner: int = 3, coverage: float = 0.8) -> DataFrame:
    """Remove a table that is only the frame of several disjoint tables filling most of it."""
    a, b = B.box("a_"), B.box("b_")
    inner = _inner_pairs(rows, page)
    filled = (
        inner.groupBy(page, "b_box_id")
        .agg(F.count("*").alias("n"), F.sum(B.area(a)).alias("covered"), F.max(B.area(b)).alias("whole"))
        .filter((F.col("n") >= n_inner) & (F.col("covered") > F.col("whole") * coverage))
    )
    # Overlapping inner boxes: a pair test per cell, then both must share the container.
    member = inner.select(page, "b_box_id", F.col("a_box_id").alias("m"))
    clash = (
        self_pairs(rows, page)
        .filter((F.col("a_box_id") < F.col("b_box_id")) & (B.intersection(a, b) > 0))
        .select(page, F.col("a_box_id").alias("m"), F.col("b_box_id").alias("m2"))
        .join(member, [page, "m"])
        .join(member.withColumnRenamed("m", "m2"), [page, "m2", "b_box_id"], "left_semi")
        .select(page, "b_box_id")
        .distinct()
    )
    losers = filled.join(clash, [page, "b_box_id"], "left_anti").select(page, F.col("b_box_id").alias("a_box_id"))
    return _without(rows, losers, page)


def resolve_groups(rows: DataFrame, page: str, n_inner: int = 2) -> DataFrame:
    """A box holding several others: if it scores above their mean they go and it grows, else it goes."""
    score = F.coalesce(F.col("a_score"), F.lit(0.5))
    inner = _inner_pairs(rows, page)
    judged = (
        inner.groupBy(page, "b_box_id")
        .agg(
            F.count("*").alias("n"), F.round(F.avg(score), 9).alias("mean"), F.first(F.coalesce(F.col("b_score"), F.lit(0.5))).alias("own"),
            F.min("a_x0").alias("gx0"), F.min("a_y0").alias("gy0"), F.max("a_x1").alias("gx1"), F.max("a_y1").alias("gy1"),
        )
        .filter(F.col("n") >= n_inner)
        .withColumn("wins", F.col("own") > F.col("mean"))
    )
    beaten = inner.join(judged.filter("wins").select(page, "b_box_id"), [page, "b_box_id"], "left_semi").select(page, "a_box_id")
    empty = judged.filter(~F.col("wins")).select(page, F.col("b_box_id").alias("a_box_id"))
    grown = judged.filter("wins").select(page, F.col("b_box_id").alias("box_id"), "gx0", "gy0", "gx1", "gy1")
    kept = _without(rows, beaten.union(empty), page).join(grown, [page, "box_id"], "left")
    return kept.withColumns(
        {"x0": F.least("x0", "gx0"), "y0": F.least("y0", "gy0"), "x1": F.greatest("x1", "gx1"), "y1": F.greatest("y1", "gy1")}
    ).drop("gx0", "gy0", "gx1", "gy1")


def prefer(winners: DataFrame, losers: DataFrame, page: str, threshold: float = 0.8) -> DataFrame:
    """Losers without those that a winner covers nearly alike."""
    beaten = touching_pairs(losers, winners, page, _COLUMNS).filter(B.iou(B.box("a_"), B.box("b_")) > threshold)
    return _without(losers, beaten, page)


def drop_under(rows: DataFrame, covers: DataFrame, page: str, share: float = 0.6) -> DataFrame:
    """Rows without those mostly under a cover."""
    under = touching_pairs(rows, covers, page, _COLUMNS).filter(B.overlap_of_first(B.box("a_"), B.box("b_")) > share)
    return _without(rows, under, page)


def is_footnote_region(b, page_width: Column, page_height: Column) -> Column:
    return (b[2] - b[0] > page_width / 3) & (b[3] - b[1] > 10) & (b[1] > page_height * 0.7)


def below_footnotes(rows: DataFrame, footnotes: DataFrame, page: str, share: float = 0.8) -> DataFrame:
    """Rows under a footnote that covers them sideways to the given share; they are to be discarded.

    Only the footnote column decides, so each side is cut into x cells and no page-wide product arises.
    """
    def cells(r: DataFrame, p: str) -> DataFrame:
        return r.withColumn("cx", F.explode(F.sequence(F.floor(F.col(p + "x0") / CELL), F.floor(F.col(p + "x1") / CELL))))

    a = cells(rows.select(page, *[F.col(c).alias("a_" + c) for c in _COLUMNS]), "a_")
    b = cells(footnotes.select(page, *[F.col(c).alias("b_" + c) for c in _COLUMNS]), "b_")
    covered = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    hits = a.join(b, [page, "cx"]).filter((F.col("a_y0") >= F.col("b_y1")) & (covered >= share * (F.col("a_x1") - F.col("a_x0"))))
    return rows.join(hits.select(page, F.col("a_box_id").alias("box_id")).distinct(), [page, "box_id"], "left_semi")


def region(category: Column) -> Column:
    return F.coalesce(*[F.when(category == k, v) for k, v in REGIONS.items()], F.lit("other"))


def spans_in_scope(spans: DataFrame, discarded: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """Spans over 0.4 in a discarded region or over 0.5 in a block."""
    def hits(regions: DataFrame, share: float) -> DataFrame:
        pairs = touching_pairs(spans, regions, page, _COLUMNS).filter(B.overlap_of_first(B.box("a_"), B.box("b_")) > share)
        return pairs.select(page, F.col("a_box_id").alias("box_id"))

    return spans.join(hits(discarded, 0.4).union(hits(blocks, 0.5)).distinct(), [page, "box_id"], "left_semi")


def assign_spans(spans: DataFrame, blocks: DataFrame, page: str, ratio: float = 0.5) -> DataFrame:
    """Each span with the first block that holds it to the given share; null where none does."""
    found = (
        touching_pairs(spans, blocks, page, _COLUMNS)
        .filter(B.overlap_of_first(B.box("a_"), B.box("b_")) > ratio)
        .groupBy(page, F.col("a_box_id").alias("box_id"))
        .agg(F.min("b_box_id").alias("block_id"))
    )
    return spans.join(found, [page, "box_id"], "left")


def nearest_owner(captions: DataFrame, bodies: DataFrame, page: str, reach: int = 200) -> DataFrame:
    """Each caption with the body of its page at the smallest gap; ties go to the lower id.

    Captions look for bodies within a reach. One whose best gap is inside it is
    settled; the others look again four times as far, so no page pairs all with all.
    Both inputs are read several times, so store them first if they are costly.
    """
    cols = ["box_id", *B.COORDS]
    open_ones = captions.select(page, *cols).join(bodies.select(page).distinct(), page, "left_semi")
    settled = None
    while True:
        wide = open_ones.select(
            page, "box_id", *[(F.col(c) - reach).alias(c) for c in ("x0", "y0")], *[(F.col(c) + reach).alias(c) for c in ("x1", "y1")]
        )
        a = (F.col("a_x0") + reach, F.col("a_y0") + reach, F.col("a_x1") - reach, F.col("a_y1") - reach)
        gap = F.round(B.gap_distance(a, B.box("b_")), 6)
        best = (
            touching_pairs(wide, bodies, page, cols, max(CELL, 2 * reach))  # smaller cells would repeat a wide box more often
            .groupBy(page, F.col("a_box_id").alias("box_id"))
            .agg(F.min(F.struct(gap.alias("gap"), F.col("b_box_id").alias("owner"))).alias("best"))
            .filter(F.col("best.gap") <= reach)
            .select(page, "box_id", "best.gap", "best.owner")
        )
        looked = cut_lineage(open_ones.join(best, [page, "box_id"], "left"))
        done = looked.filter("owner is not null").select(page, "box_id", "gap", "owner")
        settled = done if settled is None else settled.unionByName(done)
        open_ones = looked.filter("owner is null").drop("gap", "owner")
        if open_ones.isEmpty():
            return settled
        reach *= 4


def text_share(images: DataFrame, texts: DataFrame, page: str) -> DataFrame:
    """Share of each image's area under text boxes, and whether that makes it text."""
    covered = touching_pairs(images, texts, page, _COLUMNS).groupBy(page, F.col("a_box_id").alias("box_id")).agg(
        F.sum(B.intersection(B.box("a_"), B.box("b_"))).alias("covered")
    )
    share = F.coalesce(F.col("covered"), F.lit(0)) / B.area(B.box())
    return images.join(covered, [page, "box_id"], "left").withColumns(
        {"share": F.round(share, 6), "is_text": share > 0.25}
    ).drop("covered")


def list_members(items: DataFrame, lists: DataFrame, page: str, share: float = 0.8) -> DataFrame:
    """``(page, list_id, n_items, sub_type)``: items go to the first list that holds them, empty lists vanish."""
    kind = items.select(page, F.col("box_id"), F.col("category_id"))
    owned = (
        touching_pairs(items, lists, page, _COLUMNS)
        .filter(B.overlap_of_first(B.box("a_"), B.box("b_")) >= share)
        .groupBy(page, F.col("a_box_id").alias("box_id"))
        .agg(F.min("b_box_id").alias("list_id"))
        .join(kind, [page, "box_id"])
    )
    counted = owned.groupBy(page, "list_id", "category_id").agg(F.count("*").alias("n"))
    return counted.groupBy(page, "list_id").agg(
        F.sum("n").alias("n_items"), F.min_by("category_id", F.struct(-F.col("n"), "category_id")).alias("sub_type")
    )


def match_text_to_cells(texts: DataFrame, cells: DataFrame, page: str) -> DataFrame:
    """Each text with its best cell: highest IoU, then nearest corners, then lowest id; many texts may share one.

    A text that shares no area with any cell has none.
    """
    a, b = B.box("a_"), B.box("b_")
    best = F.struct(-F.round(B.iou(a, b), 9), F.round(B.corner_distance(a, b), 6), F.col("b_box_id"))
    meets = touching_pairs(texts, cells, page, _COLUMNS).filter(B.intersection(a, b) > 0)
    return (
        meets.groupBy(page, F.col("a_box_id").alias("box_id")).agg(F.min_by("b_box_id", best).alias("cell_id"))
    )


def row_islands(rows: DataFrame, page: str, lo: str, hi: str, share: float = 0.6, alone: Column | None = None) -> DataFrame:
    """``line`` number per page: a box starts a line when it shares too little height with the one before."""
    w = Window.partitionBy(page).orderBy(lo, "x0", "box_id")
    same = B.axis_overlap(F.col(lo), F.col(hi), F.lag(lo).over(w), F.lag(hi).over(w)) > share
    if alone is not None:
        same = same & ~alone & ~F.lag(alone).over(w)
    opens = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("_opens", opens).withColumn("line", F.sum("_opens").over(w) - 1).drop("_opens")
