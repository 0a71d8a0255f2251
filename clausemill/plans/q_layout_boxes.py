"""Registered queries for box rules of page layouts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from clausemill.functions import boxes as B
from clausemill.operators import layout_boxes as L
from clausemill.plans.fixtures import BOXES, PAIRS, boxes, with_ctes
from clausemill.plans.registry import query
from clausemill.session import cut_lineage

_ALL = "page, box_id, x0, y0, x1, y1"
_COLS = ["page", "box_id", "x0", "y0", "x1", "y1"]


def _without(found: str, among: str = "true", keep: str = "not exists") -> tuple[str, str]:
    """SQL of the boxes ``among`` all that aren't ``found (page, id)``."""
    gone = f"gone as materialized (select distinct page, id from ({found}))"
    return gone, f"select {_ALL} from boxes where {among} and {keep} (select 1 from gone where gone.page = boxes.page and gone.id = boxes.box_id)"



def _next(spark, sf):
    w = Window.partitionBy("page").orderBy("box_id")
    rows = boxes(spark, sf)
    for c in B.COORDS:
        rows = rows.withColumn("n_" + c, F.lead(c).over(w))
    return rows.filter("n_x0 is not null")


_NEXT = """
nxt as (select *, lead(x0) over w as nx0, lead(y0) over w as ny0, lead(x1) over w as nx1, lead(y1) over w as ny1 from boxes window w as (partition by page order by box_id) qualify nx0 is not null),
meas as (select *, greatest(least(x1, nx1) - greatest(x0, nx0), 0) as ox, greatest(least(y1, ny1) - greatest(y0, ny0), 0) as oy, (x1 - x0) * (y1 - y0) as a1, (nx1 - nx0) * (ny1 - ny0) as a2 from nxt)
"""


@query(
    "l01_box_functions",
    with_ctes(BOXES, _NEXT, """
select page, box_id, (x0 >= nx0 and y0 >= ny0 and x1 <= nx1 and y1 <= ny1)::int as contained, (nx1 < x0)::int as is_left, (ny1 < y0)::int as is_above, ox * oy as common, round(ox * oy / (a1 + a2 - ox * oy), 6) as iou,
  round(ox * oy / least(a1, a2), 6) as of_smaller, round(ox * oy / a1, 6) as of_first, round(ox / least(x1 - x0, nx1 - nx0), 6) as x_share,
  round(sqrt(greatest(x0 - nx1, nx0 - x1, 0) ** 2 + greatest(y0 - ny1, ny0 - y1, 0) ** 2), 6) as gap from meas"""),
)
def box_functions(spark, sf):
    a, b = B.box(), B.box("n_")
    where = B.relative_position(a, b)
    return _next(spark, sf).select(
        "page", "box_id", B.inside(a, b).cast("int").alias("contained"), where["left"].cast("int").alias("is_left"), where["above"].cast("int").alias("is_above"),
        B.intersection(a, b).alias("common"), F.round(B.iou(a, b), 6).alias("iou"), F.round(B.overlap_of_smaller(a, b), 6).alias("of_smaller"),
        F.round(B.overlap_of_first(a, b), 6).alias("of_first"), F.round(B.x_overlap(a, b), 6).alias("x_share"), F.round(B.gap_distance(a, b), 6).alias("gap"),
    )


@query(
    "l02_axis_overlap",
    with_ctes(BOXES, _NEXT, "select page, box_id, (oy / least(y1 - y0, ny1 - ny0) > 0.6)::int as same_row, (ox / least(x1 - x0, nx1 - nx0) > 0.6)::int as same_column from meas"),
)
def axis(spark, sf):
    a, b = B.box(), B.box("n_")
    return _next(spark, sf).select("page", "box_id", (B.y_overlap(a, b) > 0.6).cast("int").alias("same_row"), (B.x_overlap(a, b) > 0.6).cast("int").alias("same_column"))


@query(
    "l03_rescale",
    with_ctes(BOXES, """
select page, box_id, floor(x0 / 3.0)::int as x0, floor(y0 / 3.0)::int as y0, floor(x1 / 3.0)::int as x1, floor(y1 / 3.0)::int as y1, trunc(x0 * 1000 / 500.0)::int as tx0, trunc(y1 * 1000 / 700.0)::int as ty1,
  trunc(x0 / 512.0 * 400)::int as rx0, trunc(y1 / 512.0 * 300)::int as ry1 from boxes where floor(x1 / 3.0) > floor(x0 / 3.0)"""),
)
def rescale(spark, sf):
    poly = F.array("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")
    wide, high = F.lit(500.0), F.lit(700.0)
    swapped = [F.col(c) / 512 for c in ("x1", "y1", "x0", "y0")]
    return (
        boxes(spark, sf)
        .select(
            "page", "box_id", B.from_polygon(poly, 3.0).alias("b"), B.to_thousandths(B.box(), wide, high).alias("t"),
            B.from_relative(swapped, F.lit(400), F.lit(300)).alias("r"),
        )
        .filter("b.x1 > b.x0 and b.y1 > b.y0")
        .select("page", "box_id", "b.*", F.col("t.x0").alias("tx0"), F.col("t.y1").alias("ty1"), F.col("r.x0").alias("rx0"), F.col("r.y1").alias("ry1"))
    )


@query("l04_drop_low_score", with_ctes(BOXES, "select page, box_id, (score >= 0.5 and x1 - x0 >= 70)::int as is_text from boxes where score > 0.05"))
def low(spark, sf):
    kept = L.drop_low_score(boxes(spark, sf))
    text = L.keep_text_hits(kept, 0.5, 70).select("page", "box_id", F.lit(1).alias("is_text"))
    return kept.join(text, ["page", "box_id"], "left").select("page", "box_id", F.coalesce("is_text", F.lit(0)).alias("is_text"))


@query("l05_suppress_duplicates", with_ctes(BOXES, PAIRS, *_without("select page, a as id from prs where iou > 0.9 and (sb > sa or (sb = sa and b < a))")))
def suppressed(spark, sf):
    return L.suppress_duplicates(boxes(spark, sf), "page").select(*_COLS)


_INSIDE = "ax0 >= bx0 and ay0 >= by0 and ax1 <= bx1 and ay1 <= by1"


@query("l06_drop_contained", with_ctes(BOXES, PAIRS, *_without(f"select page, a as id from prs where {_INSIDE}")))
def contained(spark, sf):
    return L.drop_contained(boxes(spark, sf), "page").select(*_COLS)


@query(
    "l06_drop_contained_keep_equal",
    with_ctes(BOXES, PAIRS, *_without(f"select page, a as id from prs where {_INSIDE} and (aa < ab or b < a)")),
)
def contained_equal(spark, sf):
    return L.drop_contained(boxes(spark, sf), "page", keep_equal=True).select(*_COLS)


@query(
    "l07_absorb_small",
    with_ctes(BOXES, PAIRS, """
cov as (select page, a, ax0, ay0, ax1, ay1, b as owner from prs where osmall > 0.8 and (ab > aa or (ab = aa and b < a)) qualify row_number() over (partition by page, a order by ab desc, b) = 1)""", """
grow as (select page, owner, min(ax0) as gx0, min(ay0) as gy0, max(ax1) as gx1, max(ay1) as gy1 from cov group by page, owner)""", """
select b.page, box_id, least(x0, gx0) as x0, least(y0, gy0) as y0, greatest(x1, gx1) as x1, greatest(y1, gy1) as y1 from boxes b left join grow g on g.page = b.page and g.owner = b.box_id
where (b.page, box_id) not in (select (page, a) from cov)"""),
)
def absorbed(spark, sf):
    return L.absorb_small(boxes(spark, sf), "page").select(*_COLS)


@query(
    "l08_union_tables",
    with_ctes(BOXES, PAIRS, "edges as (select page, a, b from prs where iou > 0.7)", """
reach as (select page, box_id as node, box_id as label from boxes union select r.page, e.b, r.label from reach r join edges e on e.page = r.page and e.a = r.node)""", """
labels as (select page, node, min(label) as label from reach group by page, node)""", """
select b.page, label as box_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n_boxes from boxes b join labels l on l.page = b.page and l.node = b.box_id group by b.page, label"""),
)
def united(spark, sf):
    return L.union_tables(boxes(spark, sf), "page").select(*_COLS, "n_boxes")


_INNER = "inn as (select * from prs where ofirst >= 0.8 and aa < ab)"


@query(
    "l09_drop_container_tables",
    with_ctes(BOXES, PAIRS, _INNER, """
filled as (select page, b from inn group by page, b having count(*) >= 2 and sum(aa) > max(ab) * 0.5)""", """
clash as materialized (select distinct i.page, i.b from inn i join inn j on j.page = i.page and j.b = i.b and i.a < j.a join prs p on p.page = i.page and p.a = i.a and p.b = j.a and p.inter > 0)""",
        *_without("select page, b as id from filled f where not exists (select 1 from clash c where c.page = f.page and c.b = f.b)")),
)
def containers(spark, sf):
    return L.drop_container_tables(boxes(spark, sf), "page", 2, 0.5).select(*_COLS)


@query(
    "l10_resolve_groups",
    with_ctes(BOXES, PAIRS, _INNER, """
jud as (select page, b, round(avg(coalesce(sa, 0.5)), 9) as mean, max(coalesce(sb, 0.5)) as own, min(ax0) as gx0, min(ay0) as gy0, max(ax1) as gx1, max(ay1) as gy1 from inn group by page, b having count(*) >= 2)""", """
gone as (select i.page, i.a as id from inn i join jud j on j.page = i.page and j.b = i.b and own > mean union select page, b from jud where own <= mean)""", """
select b.page, box_id, least(x0, gx0) as x0, least(y0, gy0) as y0, greatest(x1, gx1) as x1, greatest(y1, gy1) as y1 from boxes b left join jud g on g.page = b.page and g.b = b.box_id and own > mean
where (b.page, box_id) not in (select (page, id) from gone)"""),
)
def groups(spark, sf):
    return L.resolve_groups(boxes(spark, sf), "page").select(*_COLS)


def cat(spark, sf, *ids):
    return boxes(spark, sf).filter(F.col("category_id").isin(*ids))


@query("l11_prefer", with_ctes(BOXES, PAIRS, *_without("select page, a as id from prs where cb in (2, 5) and iou > 0.5", "category_id in (1, 3)")))
def preferred(spark, sf):
    return L.prefer(cat(spark, sf, 2, 5), cat(spark, sf, 1, 3), "page", 0.5).select(*_COLS)


@query("l12_drop_under_discarded", with_ctes(BOXES, PAIRS, *_without("select page, a as id from prs where cb = 6 and ofirst > 0.6", "category_id <> 6")))
def under(spark, sf):
    return L.drop_under(boxes(spark, sf).filter("category_id <> 6"), cat(spark, sf, 6), "page").select(*_COLS)


@query("l13_footnote_regions", with_ctes(BOXES, f"select {_ALL} from boxes where x1 - x0 > 250 / 3.0 and y1 - y0 > 10 and y0 > 500 * 0.7"))
def footnotes(spark, sf):
    return boxes(spark, sf).filter(L.is_footnote_region(B.box(), F.lit(250), F.lit(500))).select(*_COLS)


@query(
    "l14_drop_below_footnote",
    with_ctes(BOXES, f"select {_ALL} from boxes a where category_id <> 7 and exists (select 1 from boxes b where b.page = a.page and b.category_id = 7 and a.y0 >= b.y1 and least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.3 * (a.x1 - a.x0))"),
)
def below(spark, sf):
    return L.below_footnotes(boxes(spark, sf).filter("category_id <> 7"), cat(spark, sf, 7), "page", 0.3).select(*_COLS)


@query(
    "l15_route_regions",
    with_ctes(BOXES, "select page, coalesce(['title', 'text', 'table', 'image', 'equation', 'discarded', 'footnote'][category_id], 'other') as region, count(*) as n from boxes group by all"),
)
def routed(spark, sf):
    return boxes(spark, sf).groupBy("page", L.region(F.col("category_id")).alias("region")).agg(F.count("*").alias("n"))


@query(
    "l16_spans_in_scope",
    with_ctes(BOXES, PAIRS, *_without("select page, a as id from prs where (cb = 6 and ofirst > 0.4) or (cb in (1, 3) and ofirst > 0.5)", "category_id in (2, 5)", "exists")),
)
def scoped(spark, sf):
    return L.spans_in_scope(cat(spark, sf, 2, 5), cat(spark, sf, 6), cat(spark, sf, 1, 3), "page").select(*_COLS)


@query(
    "l17_assign_spans",
    with_ctes(BOXES, PAIRS, "own as (select page, a, min(b) as block_id from prs where cb in (1, 3, 4) and ofirst > 0.5 group by page, a)", """
select b.page, box_id, block_id from boxes b left join own o on o.page = b.page and o.a = b.box_id where category_id in (2, 5)"""),
)
def assigned(spark, sf):
    return L.assign_spans(cat(spark, sf, 2, 5), cat(spark, sf, 1, 3, 4), "page").select("page", "box_id", "block_id")


_GAP = "round(sqrt(greatest(a.x0 - b.x1, b.x0 - a.x1, 0) ** 2 + greatest(a.y0 - b.y1, b.y0 - a.y1, 0) ** 2), 6)"


@query(
    "l29_nearest_owner",
    with_ctes(BOXES, f"""
select a.page, a.box_id, min({_GAP}) as gap, arg_min(b.box_id, {{'g': {_GAP}, 'i': b.box_id}}) as owner from boxes a join boxes b on a.page = b.page and a.category_id = 7 and b.category_id in (3, 4) group by a.page, a.box_id"""),
)
def owners(spark, sf):
    rows = cut_lineage(cat(spark, sf, 3, 4, 7).select(*_COLS, "category_id"))
    return L.nearest_owner(rows.filter("category_id = 7"), rows.filter("category_id <> 7"), "page").select("page", "box_id", "gap", "owner")


@query(
    "l30_relabel_footnotes",
    with_ctes(BOXES, f"""
g as (select a.page, a.box_id, b.category_id as c, min({_GAP}) as gap from boxes a join boxes b on a.page = b.page and a.category_id = 7 and b.category_id in (3, 4) group by all)""", """
select f.page, f.box_id from (select * from g where c = 4) f left join (select * from g where c = 3) t on t.page = f.page and t.box_id = f.box_id where t.gap is null or f.gap < t.gap"""),
)
def relabelled(spark, sf):
    rows = cut_lineage(cat(spark, sf, 3, 4, 7).select(*_COLS, "category_id"))
    notes = rows.filter("category_id = 7")
    image = L.nearest_owner(notes, rows.filter("category_id = 4"), "page").select("page", "box_id", F.col("gap").alias("to_image"))
    table = L.nearest_owner(notes, rows.filter("category_id = 3"), "page").select("page", "box_id", F.col("gap").alias("to_table"))
    nearer = F.col("to_table").isNull() | (F.col("to_image") < F.col("to_table"))
    return image.join(table, ["page", "box_id"], "left").filter(nearer).select("page", "box_id")


_AREA_SHARE = "coalesce(c.covered, 0) / ((b.x1 - b.x0) * (b.y1 - b.y0))"


@query(
    "l32_image_is_text",
    with_ctes(BOXES, PAIRS, "c as (select page, a, sum(inter) as covered from prs where ca = 4 and cb = 2 group by page, a)", f"""
select b.page, box_id, round({_AREA_SHARE}, 6) as share, ({_AREA_SHARE} > 0.25)::int as is_text from boxes b left join c on c.page = b.page and c.a = b.box_id where category_id = 4"""),
)
def image_text(spark, sf):
    return L.text_share(cat(spark, sf, 4), cat(spark, sf, 2), "page").select("page", "box_id", "share", F.col("is_text").cast("int").alias("is_text"))


@query(
    "l33_list_members",
    with_ctes(BOXES, PAIRS, """
own as (select page, a, min(b) as list_id, any_value(ca) as c from prs where ca in (1, 2) and cb in (3, 4) and ofirst >= 0.4 group by page, a)""", """
cnt as (select page, list_id, c, count(*) as n from own group by all)""", """
select page, list_id, sum(n)::bigint as n_items, arg_min(c, {'n': -n, 'c': c}) as sub_type from cnt group by page, list_id"""),
)
def members(spark, sf):
    return L.list_members(cat(spark, sf, 1, 2), cat(spark, sf, 3, 4), "page", 0.4)


@query(
    "l45_match_text_to_cells",
    with_ctes(BOXES, PAIRS, """
k as (select *, abs(ax0 - bx0) + abs(ay0 - by0) as st, abs(ax1 - bx1) + abs(ay1 - by1) as en from prs where ca = 2 and cb in (3, 1) and inter > 0)""", """
select page, a as box_id, arg_min(b, {'i': -round(iou, 9), 'd': round(st + en + least(st, en), 6), 'b': b}) as cell_id from k group by page, a"""),
)
def matched(spark, sf):
    return L.match_text_to_cells(cat(spark, sf, 2), cat(spark, sf, 3, 1), "page")
