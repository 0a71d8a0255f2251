"""Characters, spans, lines, paragraphs and reading order of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.functions import boxes as B
from clausemill.functions.binding import let
from clausemill.functions.ordered import ordered_join, ordered_list
from clausemill.operators.layout_boxes import CELL, row_islands
from clausemill.session import cut_lineage

# Fixed values.
LINE_STOP = tuple(".!?。！？)）\"”:：;；")
LIST_END = tuple(".。;；")
CHAR_STOP = tuple(".!?。！？)）\"”:：;；]】}>》、,，-—–")
CHAR_START = tuple("(（\"“【{《<「『[")


def _spread(rows: DataFrame, page: str, prefix: str, cell: int) -> DataFrame:
    cells = F.sequence(F.floor(F.col(prefix + "y0") / cell), F.floor(F.col(prefix + "y1") / cell))
    return rows.withColumn("cy", F.explode(cells))


def assign_chars(chars: DataFrame, spans: DataFrame, page: str, cell: int = 50) -> DataFrame:
    """``(page, char_idx, span_id)``: a character belongs to the first span around its centre.

    Stop and opening marks may lean out of the span's end or start by its height.
    """
    a = chars.select(page, "char_idx", "ch", *[F.col(c).alias("a_" + c) for c in B.COORDS])
    b = spans.select(page, "span_id", *[F.col(c).alias("b_" + c) for c in B.COORDS])
    mid_x, mid_y = (F.col("a_x0") + F.col("a_x1")) / 2, (F.col("a_y0") + F.col("a_y1")) / 2
    height = F.col("b_y1") - F.col("b_y0")
    near_y = (mid_y > F.col("b_y0")) & (mid_y < F.col("b_y1")) & (F.abs(mid_y - (F.col("b_y0") + F.col("b_y1")) / 2) < height * 0.33)
    within = (mid_x > F.col("b_x0")) & (mid_x < F.col("b_x1"))
    at_end = F.col("ch").isin(*CHAR_STOP) & (F.col("a_x0") > F.col("b_x1") - height) & (F.col("a_x0") < F.col("b_x1")) & (mid_x > F.col("b_x0"))
    at_start = F.col("ch").isin(*CHAR_START) & (F.col("a_x1") < F.col("b_x0") + height) & (F.col("a_x1") > F.col("b_x0")) & (mid_x < F.col("b_x1"))
    # A character takes the one row cell of its centre, a span all it covers.
    placed = a.withColumn("cy", F.floor(mid_y / cell)).withColumn("cx", F.explode(F.sequence(F.floor(F.col("a_x0") / CELL), F.floor(F.col("a_x1") / CELL))))
    covered = _spread(b, page, "b_", cell).withColumn("cx", F.explode(F.sequence(F.floor(F.col("b_x0") / CELL), F.floor(F.col("b_x1") / CELL))))
    return (
        placed.join(covered.hint("merge"), [page, "cx", "cy"])  # both sides are far larger than the tables their size is guessed from
        .filter(near_y & (within | at_end | at_start))
        .groupBy(page, "char_idx")
        .agg(F.min("span_id").alias("span_id"))
    )


def chars_to_text(chars: DataFrame, page: str) -> DataFrame:
    """Text per span from ``(span_id, char_idx, ch, box)``; a wide gap becomes a blank."""
    width = F.col("x1") - F.col("x0")
    listed = chars.groupBy(page, "span_id").agg(
        F.median(width).alias("w"), ordered_list([F.col("char_idx")], F.struct("ch", "x0", "x1")).alias("cs")
    )
    pieces = F.transform(
        F.col("cs"),
        lambda c, i: F.when(
            F.coalesce(F.try_element_at("cs", i + 2)["x0"] - c["x1"] > F.col("w") * 0.25, F.lit(False))
            & (c["ch"] != " ")
            & F.coalesce(F.try_element_at("cs", i + 2)["ch"] != " ", F.lit(False)),
            F.concat(c["ch"], F.lit(" ")),
        ).otherwise(c["ch"]),
    )
    return listed.select(page, "span_id", F.array_join(pieces, "").alias("text"))


def needs_ocr(text: Column, b) -> Column:
    """Too little text for the width of the span."""
    return F.length(text) * (b[3] - b[1]) < (b[2] - b[0]) / 2


def lines(spans: DataFrame, page: str, alone: Column | None = None, vertical: bool = False) -> DataFrame:
    """``line`` per span: top-down by shared height; vertical text goes from the right by shared width."""
    if not vertical:
        return row_islands(spans, page, "y0", "y1", alone=alone)
    turned = spans.withColumns({"_lo": -F.col("x1"), "_hi": -F.col("x0")})
    return row_islands(turned, page, "_lo", "_hi", alone=alone).drop("_lo", "_hi")


def line_boxes(spans: DataFrame, page: str) -> DataFrame:
    """Hull, spans left to right and direction of each line; over 80% tall spans make it vertical."""
    tall = ((F.col("y1") - F.col("y0")) > 2 * (F.col("x1") - F.col("x0"))).cast("int")
    return spans.groupBy(page, "line").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        ordered_list([F.col("x0"), F.col("box_id")], F.col("box_id")).alias("span_ids"),
        (F.avg(tall) > 0.8).alias("vertical"),
    )


def merge_intervals(rows: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Disjoint intervals with the same cover; ends are inclusive whole numbers."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("_new", F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0))
    return (
        flagged.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_g")
        .agg(F.min(lo).alias(lo), F.max(hi).alias(hi))
        .drop("_g")
    )


def subtract_intervals(whole: DataFrame, masks: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """What is left of each whole ``(keys, lo, hi)`` after its masks."""
    edges = whole.select(*keys, F.col(lo).alias("_a"), F.col(hi).alias("_b"))
    cut = merge_intervals(masks, keys, lo, hi).join(edges, keys).filter((F.col(hi) >= F.col("_a")) & (F.col(lo) <= F.col("_b")))
    w = Window.partitionBy(*keys).orderBy(lo)
    before = cut.select(*keys, (F.coalesce(F.lag(hi).over(w) + 1, F.col("_a"))).alias("s"), (F.col(lo) - 1).alias("e"))
    last = cut.groupBy(*keys).agg(F.max(hi).alias("_h"))
    after = edges.join(last, keys, "left").select(*keys, F.coalesce(F.col("_h") + 1, F.col("_a")).alias("s"), F.col("_b").alias("e"))
    return before.unionByName(after).filter("s <= e").select(*keys, F.col("s").alias(lo), F.col("e").alias(hi))


def merge_line_boxes(spans: DataFrame, page: str, ratio: float = 4.0) -> DataFrame:
    """Overlapping boxes of a long line become one; short lines keep theirs."""
    in_lines = lines(spans, page)
    hull = in_lines.groupBy(page, "line").agg(
        F.min("x0").alias("lx0"), F.max("x1").alias("lx1"), F.min("y0").alias("ly0"), F.max("y1").alias("ly1")
    ).withColumn("long", F.col("lx1") - F.col("lx0") > ratio * (F.col("ly1") - F.col("ly0")))
    joined = in_lines.join(hull.select(page, "line", "long", "ly0", "ly1"), [page, "line"])
    merged = merge_intervals(joined.filter("long"), [page, "line", "ly0", "ly1"], "x0", "x1")
    return merged.select(page, "line", "x0", F.col("ly0").alias("y0"), "x1", F.col("ly1").alias("y1")).unionByName(
        joined.filter("not long").select(page, "line", *B.COORDS)
    )


def line_height(rows: DataFrame, page: str, text_like: Column, default: float = 10.0) -> DataFrame:
    return rows.groupBy(page).agg(
        F.coalesce(F.median(F.when(text_like, F.col("y1") - F.col("y0"))), F.lit(default)).alias("line_height")
    )


def virtual_lines(b, height: Column, page_w: Column, page_h: Column) -> Column:
    """Array of slices ``(n, y0, y1)`` a block counts as, by its shape and the page's line height."""
    w, h = b[2] - b[0], b[3] - b[1]
    many = F.floor(h / height).cast("int")
    n = (
        F.when(h <= height * 2, 1)
        .when((h > page_h * 0.25) & (w > page_w * 0.25) & (w < page_w * 0.5), many)
        .when(w > page_w * 0.4, 3)
        .when(w > page_w * 0.25, many)
        .when(h / w > 1.2, 1)
        .otherwise(2)
    )
    return let(
        F.struct(n.alias("n"), (h / n).alias("each")),
        lambda s: F.transform(
            F.sequence(F.lit(0), s["n"] - 1),
            lambda i: F.struct(i.alias("n"), (b[1] + s["each"] * i).alias("y0"), (b[1] + s["each"] * (i + 1)).alias("y1")),
        ),
    )


def xy_cut(rows: DataFrame, page: str) -> DataFrame:
    """``position`` per box: pages fall into bands at y gaps, bands into columns at x gaps, and so on.

    Each round cuts every open group of every page at once and is checkpointed. A group is known by the place it starts at.
    Only columns of a band that fell apart can be cut again; all others get their places and leave the loop, which
    ends when none is open. Both cuts and the places keep the group's rows together, so a round has one shuffle.
    """
    now = rows.select(page, "box_id", *B.COORDS, F.lit(0).alias("start"))
    placed = None
    while True:
        keys, split = [page, "start"], now
        for part, lo, hi in (("band", "y0", "y1"), ("column", "x0", "x1")):
            w = Window.partitionBy(*keys).orderBy(lo, hi, "box_id")
            reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
            split = split.withColumns({"_reach": reach, "_n": F.row_number().over(w) - 1})
            opens = F.when(F.col(lo) >= F.col("_reach"), F.col("_n")).otherwise(0)
            split = split.withColumn(part, F.col(keys[-1]) + F.max(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            keys = [*keys, part]
        fell = F.max("column").over(Window.partitionBy(*keys[:-1])) > F.col("band")
        several = F.count("*").over(Window.partitionBy(*keys)) > 1
        place = F.col("column") + F.row_number().over(Window.partitionBy(*keys).orderBy("y0", "x0", "box_id")) - 1
        split = split.withColumn("_fell", fell).withColumns({"_several": several, "position": place})
        split = cut_lineage(
            split.select(page, "box_id", *B.COORDS, F.col("column").alias("start"), "position", (F.col("_fell") & F.col("_several")).alias("_open"))
        )
        done = split.filter("not _open").select(page, "box_id", "position")
        placed = done if placed is None else placed.unionByName(done)
        now = split.filter("_open").drop("position", "_open")
        if now.isEmpty():
            return placed


def block_index(ordered: DataFrame, page: str, block: str) -> DataFrame:
    """A block stands at the median place of its lines."""
    return ordered.groupBy(page, block).agg(F.median("position").alias("block_index"))


def group_blocks(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Body, captions and footnotes of a group as one block: the body's box, the median place, the parts in order."""
    body = F.when(F.col("part") == "body", F.struct(*B.COORDS))
    ids = {p: ordered_list([F.col("position")], F.when(F.col("part") == p, F.col("box_id"))) for p in ("caption", "footnote")}
    return parts.groupBy(*keys).agg(
        F.max(body).alias("body"), F.median("position").alias("position"),
        *[F.filter(v, lambda x: x.isNotNull()).alias(p + "s") for p, v in ids.items()],
    )


def classify_list(rows: DataFrame, block: str, page_width: float) -> DataFrame:
    """``index``, ``list`` or ``text`` per block from its lines ``(x0, y0, x1, y1, text, lang, line_no)``."""
    whole = rows.groupBy(block).agg(
        F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"),
        F.min_by(F.struct("x0", (F.col("y1") - F.col("y0")).alias("h")), "line_no").alias("first"),
        F.max_by(F.struct("x0", "x1"), "line_no").alias("last"),
    )
    j = rows.join(whole, block)
    h, bw = F.col("first.h"), F.col("bx1") - F.col("bx0")
    left, right = F.col("x0") - F.col("bx0"), F.col("bx1") - F.col("x1")
    free = F.when(F.col("lang").isin("zh", "ja", "ko") | (bw / page_width >= 0.5), 0.26).otherwise(0.36) * bw
    text = F.col("text")

    def count(test: Column) -> Column:
        return F.sum(F.coalesce(test, F.lit(False)).cast("int"))

    stats = j.groupBy(block, "bx0", "by0", "bx1", "by1", "first", "last").agg(
        F.count("*").alias("n"),
        count((left > 0.7 * h) & (right > 0.7 * h)).alias("sides"),
        count(F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("bx0") + F.col("bx1")) / 2) < h / 2).alias("centred"),
        count(F.abs(left) < h / 2).alias("l_close"),
        count((F.abs(left) >= h / 2) & (left > h)).alias("l_open"),
        count(F.abs(right) < h).alias("r_close"),
        count((F.abs(right) >= h) & (right > free)).alias("r_open"),
        count(F.right(text, F.lit(1)).isin(*LIST_END)).alias("ends"),
        count(text.rlike(r"^\d")).alias("num_start"),
        count(text.rlike(r"\d$")).alias("num_end"),
    )
    n = F.col("n")

    def share(c: str) -> Column:
        return F.col(c) / n

    several = (
        (F.col("first.x0") - F.col("bx0") > h / 2) & (F.abs(F.col("last.x0") - F.col("bx0")) < h / 2) & (F.col("bx1") - F.col("last.x1") > h)
    )
    numbered = (share("num_start") >= 0.8) | (share("num_end") >= 0.8)
    ended = share("ends") >= 0.8
    kind = (
        F.when(n < 2, "text")
        .when(((share("l_close") >= 0.8) | (share("r_close") >= 0.8)) & numbered, "index")
        .when(
            (F.col("sides") >= 2) & (F.col("centred") == n) & (share("sides") >= 0.5) & ((F.col("by1") - F.col("by0")) / bw > 0.4), "list"
        )
        .when((F.col("l_close") >= 2) & ((F.col("r_open") >= 2) | ended | (F.col("l_open") >= 2)) & ~several, "list")
        .otherwise("text")
    )
    return stats.select(block, "n", "l_close", "r_close", "l_open", "r_open", kind.alias("kind"))


def merge_paragraphs(blocks: DataFrame, doc: str) -> DataFrame:
    """Paragraphs from blocks ``(page_idx, block_idx, type, text, width, starts_flush, ends_full)``.

    A text block goes on from the one before if that one's last line is full and
    has no stop mark, widths are within a factor of two, and it starts neither with
    a digit nor a capital. Adjacent lists join. Titles break groups.
    """
    w = Window.partitionBy(doc).orderBy("page_idx", "block_idx")

    def prev(c: str) -> Column:
        return F.lag(c).over(w)

    both_text = (F.col("type") == "text") & (prev("type") == "text")
    goes_on = (
        both_text & F.col("starts_flush") & prev("ends_full")
        & ~F.right(prev("text"), F.lit(1)).isin(*LINE_STOP)
        & (F.abs(F.col("width") - prev("width")) < F.least("width", prev("width")))
        & ~F.col("text").rlike(r"^(\d|\p{Lu})") & (F.col("text") != "")
    )
    joins = F.coalesce(goes_on | ((F.col("type") == "list") & (prev("type") == "list")), F.lit(False))
    numbered = blocks.withColumn("_new", (~joins).cast("int")).withColumn("para", F.sum("_new").over(w) - 1)
    return numbered.groupBy(doc, "para").agg(
        F.min_by("type", F.struct("page_idx", "block_idx")).alias("type"),
        ordered_join([F.col("page_idx"), F.col("block_idx")], F.col("text"), "\n").alias("text"),
        (F.min("page_idx") < F.max("page_idx")).alias("cross_page"),
    )


def table_chains(blocks: DataFrame, doc: str) -> DataFrame:
    """Tables ``(page_idx, block_idx)`` with the number of parts that continue them over the next pages.

    The last table of a page goes on as long as the next page's first block is a
    table marked as continued. Continued tables start nothing themselves.
    """
    is_table = F.col("type") == "table"
    pages = blocks.groupBy(doc, "page_idx").agg(
        F.min_by(is_table & F.col("continued"), "block_idx").alias("linked"),
        F.max(F.when(is_table, F.col("block_idx"))).alias("last_table"),
    )
    w = Window.partitionBy(doc).orderBy("page_idx")
    link = F.col("linked") & (F.lag("page_idx").over(w) == F.col("page_idx") - 1)
    islands = pages.withColumn("_new", (~F.coalesce(link, F.lit(False))).cast("int")).withColumn("island", F.sum("_new").over(w))
    ends = islands.withColumn("end_page", F.max("page_idx").over(Window.partitionBy(doc, "island")))
    tables = blocks.filter(is_table & ~F.col("continued"))
    return tables.join(ends.select(doc, "page_idx", "last_table", "end_page"), [doc, "page_idx"]).select(
        doc, "page_idx", "block_idx",
        (F.when(F.col("block_idx") == F.col("last_table"), F.col("end_page") - F.col("page_idx")).otherwise(0) + 1).alias("n_parts"),
    )


def restore_continued(blocks: DataFrame, originals: DataFrame, keys: list[str]) -> DataFrame:
    """Give deleted blocks the content of the original block of the same box, keeping the mark."""
    found = originals.select(*keys, F.col("content").alias("_original"))
    return blocks.join(found, keys, "left").withColumns(
        {
            "restored": F.col("deleted") & F.col("_original").isNotNull(),
            "content": F.when(F.col("deleted"), F.coalesce("_original", "content")).otherwise(F.col("content")),
        }
    ).drop("_original")


def suppress_restored(blocks: DataFrame) -> DataFrame:
    return blocks.filter(~F.col("deleted"))


def row_text(spans: DataFrame, page: str, unit: int = 10) -> DataFrame:
    """Text per line of a page; a gap becomes one blank per ``unit``."""
    in_lines = lines(spans, page)
    w = Window.partitionBy(page, "line").orderBy("x0", "box_id")
    gap = F.floor((F.col("x0") - F.lag("x1").over(w)) / unit)
    blanks = F.repeat(F.lit(" "), F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0)).cast("int"))
    return in_lines.withColumn("_piece", F.concat(blanks, "text")).groupBy(page, "line").agg(
        ordered_join([F.col("x0"), F.col("box_id")], F.col("_piece"), "").alias("text")
    )


def sort_boxes(rows: DataFrame, page: str, tolerance: int = 10) -> DataFrame:
    """Top-down, left to right; boxes within the tolerance of the one above share a row."""
    w = Window.partitionBy(page).orderBy("y0", "x0", "box_id")
    new = F.when(F.col("y0") - F.lag("y0").over(w) < tolerance, 0).otherwise(1)
    rowed = rows.withColumn("_new", new).withColumn("row", F.sum("_new").over(w) - 1)
    by_row = Window.partitionBy(page).orderBy("row", "x0", "y0", "box_id")
    return rowed.withColumn("position", F.row_number().over(by_row) - 1).drop("_new")
