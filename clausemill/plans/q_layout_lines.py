"""Registered queries for lines, paragraphs, tables and rendering of page layouts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from clausemill.functions import boxes as B, render as D, tables as T
from clausemill.functions.ordered import ordered_join
from clausemill.operators import layout_lines as N, tables as O
from clausemill.plans.fixtures import BOXES, boxes, with_ctes
from clausemill.plans.registry import query
from clausemill.session import load

# Letters of part names as characters on a line, words as spans.
_CHARS = """
chars as (select p_partkey as page, (i - 1)::int as char_idx, substring(p_name, i, 1) as ch, (i - 1) * 10 + p_size % 3 as x0, 0 as y0, (i - 1) * 10 + p_size % 3 + 9 as x1, 12 as y1
  from part, unnest(range(1, length(p_name) + 1)) as u(i)),
words as (select p_partkey as page, k - 1 as span_id, length(array_to_string(string_split(p_name, ' ')[:k - 1], ' ')) + (k > 1)::int as off, length(string_split(p_name, ' ')[k]) as n from part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) as u(k)),
wspans as (select page, span_id, off * 10 as x0, 0 as y0, (off + n) * 10 as x1, 12 as y1 from words),
placed as (select c.page, c.char_idx, min(s.span_id) as span_id from chars c join wspans s on c.page = s.page and (c.x0 + c.x1) / 2 > s.x0 and (c.x0 + c.x1) / 2 < s.x1 group by all)
"""


def chars(spark, sf):
    part = load(spark, sf, "part").select("p_partkey", "p_size", F.posexplode(F.split("p_name", "")).alias("i", "ch")).filter("ch <> ''")
    x0 = F.col("i") * 10 + F.col("p_size") % 3
    return part.select(F.col("p_partkey").alias("page"), F.col("i").alias("char_idx"), "ch", x0.alias("x0"), F.lit(0).alias("y0"), (x0 + 9).alias("x1"), F.lit(12).alias("y1"))


def word_spans(spark, sf):
    words = F.split("p_name", " ", -1)
    spans = F.transform(
        words,
        lambda w, k: F.struct(
            k.alias("span_id"),
            (F.aggregate(F.slice(words, 1, k), F.lit(0), lambda acc, x: acc + F.length(x) + 1) * 10).alias("x0"),
            F.length(w).alias("n"),
        ),
    )
    return load(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.inline(spans)).select(
        "page", "span_id", "x0", F.lit(0).alias("y0"), (F.col("x0") + F.col("n") * 10).alias("x1"), F.lit(12).alias("y1")
    )


@query("l18_assign_chars", with_ctes(_CHARS, "select page, char_idx, span_id from placed"))
def assign_chars(spark, sf):
    return N.assign_chars(chars(spark, sf), word_spans(spark, sf), "page")


@query(
    "l19_chars_to_text",
    with_ctes(_CHARS, "select page, span_id, string_agg(ch, '' order by char_idx) as text from placed join chars using (page, char_idx) group by all"),
)
def char_text(spark, sf):
    owned = N.assign_chars(chars(spark, sf), word_spans(spark, sf), "page")
    return N.chars_to_text(chars(spark, sf).join(owned.hint("merge"), ["page", "char_idx"]), "page")


@query("l20_needs_ocr", with_ctes(BOXES, "select page, box_id from boxes where length(flag) * (category_id % 3) * (y1 - y0) < (x1 - x0) / 2"))
def ocr(spark, sf):
    text = F.repeat("flag", (F.col("category_id") % 3).cast("int"))
    return boxes(spark, sf).filter(N.needs_ocr(text, B.box())).select("page", "box_id")


def _line_ctes(name, lo, hi):
    return f"""
{name}_f as (select *, case when greatest(least({hi}, lag({hi}) over w) - greatest({lo}, lag({lo}) over w), 0) / least({hi} - {lo}, lag({hi}) over w - lag({lo}) over w) > 0.6
   and category_id <> 5 and lag(category_id) over w <> 5 then 0 else 1 end as opens from boxes window w as (partition by page order by {lo}, x0, box_id)),
{name} as (select *, sum(opens) over (partition by page order by {lo}, x0, box_id) - 1 as line from {name}_f)
"""


def alone():
    return F.col("category_id") == 5


@query("l21_lines", with_ctes(BOXES, _line_ctes("ls", "y0", "y1"), "select page, box_id, line from ls"))
def lines(spark, sf):
    return N.lines(boxes(spark, sf), "page", alone()).select("page", "box_id", "line")


@query("l21_lines_vertical", with_ctes(BOXES, _line_ctes("ls", "(-x1)", "(-x0)"), "select page, box_id, line from ls"))
def lines_vertical(spark, sf):
    return N.lines(boxes(spark, sf), "page", alone(), vertical=True).select("page", "box_id", "line")


@query(
    "l22_line_boxes",
    with_ctes(BOXES, _line_ctes("ls", "y0", "y1"), "select page, line, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, string_agg(box_id::varchar, ',' order by x0, box_id) as span_ids, (avg((y1 - y0 > 2 * (x1 - x0))::int) > 0.8)::int as vertical from ls group by page, line"),
)
def line_boxes(spark, sf):
    found = N.line_boxes(N.lines(boxes(spark, sf), "page", alone()), "page")
    return found.select("page", "line", *B.COORDS, F.array_join(F.col("span_ids").cast("array<string>"), ",").alias("span_ids"), F.col("vertical").cast("int").alias("vertical"))


_MERGED = """
mf as (select page, x0, x1, case when max(x1) over w >= x0 then 0 else 1 end as opens from boxes window w as (partition by page order by x0, x1 rows between unbounded preceding and 1 preceding)),
mg as (select *, sum(opens) over (partition by page order by x0, x1 rows unbounded preceding) as g from mf),
merged as (select page, min(x0) as x0, max(x1) as x1 from mg group by page, g)
"""


@query("l23_merge_intervals", with_ctes(BOXES, _MERGED, "select page, x0, x1 from merged"))
def merged(spark, sf):
    return N.merge_intervals(boxes(spark, sf), ["page"], "x0", "x1")


@query(
    "l23_subtract_intervals",
    with_ctes(BOXES, _MERGED, "whole as (select p_partkey as page, 0 as a, 300 + p_size as b from part)", """
cutm as (select m.* from merged m join whole w on w.page = m.page and x1 >= a and x0 <= b)""", """
gaps as (select c.page, coalesce(lag(x1) over (partition by c.page order by x0) + 1, a) as x0, x0 - 1 as x1 from cutm c join whole w on w.page = c.page union all
  select w.page, coalesce(max(x1) + 1, a) as s, b from whole w left join cutm c on c.page = w.page group by w.page, a, b)""", "select page, x0, x1 from gaps where x0 <= x1"),
)
def subtracted(spark, sf):
    whole = load(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.lit(0).alias("x0"), (F.col("p_size") + 300).alias("x1"))
    return N.subtract_intervals(whole, boxes(spark, sf), ["page"], "x0", "x1")


@query(
    "l24_merge_line_boxes",
    with_ctes(BOXES, _line_ctes("ls", "y0", "y1").replace("and category_id <> 5 and lag(category_id) over w <> 5", ""), """
hull as (select page, line, min(y0) as ly0, max(y1) as ly1, max(x1) - min(x0) > 4 * (max(y1) - min(y0)) as long from ls group by page, line)""", """
jf as (select ls.*, ly0, ly1, long, case when max(x1) over w >= x0 then 0 else 1 end as o2 from ls join hull using (page, line) window w as (partition by page, line order by x0, x1 rows between unbounded preceding and 1 preceding))""", """
jg as (select *, sum(o2) over (partition by page, line order by x0, x1 rows unbounded preceding) as g from jf where long)""", """
select page, line, min(x0) as x0, any_value(ly0) as y0, max(x1) as x1, any_value(ly1) as y1 from jg group by page, line, g union all select page, line, x0, y0, x1, y1 from jf where not long"""),
)
def merged_lines(spark, sf):
    return N.merge_line_boxes(boxes(spark, sf), "page")


@query("l25_line_height", with_ctes(BOXES, "select page, coalesce(median(y1 - y0) filter (category_id in (1, 2)), 10.0) as line_height from boxes group by page"))
def heights(spark, sf):
    return N.line_height(boxes(spark, sf), "page", F.col("category_id").isin(1, 2))


@query(
    "l26_virtual_lines",
    with_ctes(BOXES, """
v as (select page, box_id, y0, y1 * 3 - y0 * 2 as y1, x1 - x0 as w, (y1 - y0) * 3 as h, 7 + category_id as lh from boxes)""", """
c as (select *, case when h <= lh * 2 then 1 when h > 500 * 0.1 * 2.5 and w > 75 and w < 150 then floor(h / lh)::int when w > 120 then 3 when w > 75 then floor(h / lh)::int when h / w > 1.2 then 1 else 2 end as n from v)""", """
select page, box_id, i as n, round(y0 + h / n * i, 6) as y0, round(y0 + h / n * (i + 1), 6) as y1 from c, unnest(range(0, n)) as u(i)"""),
)
def virtual(spark, sf):
    tall = boxes(spark, sf).withColumn("y1", F.col("y1") * 3 - F.col("y0") * 2)
    slices = N.virtual_lines(B.box(), F.col("category_id") + 7, F.lit(300), F.lit(500))
    return tall.select("page", "box_id", F.inline(slices)).select("page", "box_id", "n", B.rounded(F.col("y0"), 6).alias("y0"), B.rounded(F.col("y1"), 6).alias("y1"))


@query("l27_reading_order")
def reading(spark, sf):
    return N.xy_cut(boxes(spark, sf), "page")


_SORTED = """
sf0 as (select *, case when y0 - lag(y0) over w < 10 then 0 else 1 end as o from boxes window w as (partition by page order by y0, x0, box_id)),
sf1 as (select *, sum(o) over (partition by page order by y0, x0, box_id) - 1 as row from sf0),
sorted as (select *, row_number() over (partition by page order by row, x0, y0, box_id) - 1 as position from sf1)
"""


@query("l28_block_index", with_ctes(BOXES, _SORTED, "select page, category_id, median(position) as block_index from sorted group by all"))
def block_indexes(spark, sf):
    return N.block_index(N.sort_boxes(boxes(spark, sf), "page"), "page", "category_id")


@query(
    "l31_group_blocks",
    with_ctes(BOXES, _SORTED, """
g as (select *, category_id % 2 as grp, case when category_id < 3 then 'body' when category_id < 6 then 'caption' else 'footnote' end as part from sorted)""", """
b as (select page, grp, max({'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) filter (part = 'body') as body from g group by page, grp)""", """
select g.page, g.grp, any_value(b.body.x0) as x0, any_value(b.body.y1) as y1, median(position) as position, coalesce(string_agg(case when part = 'caption' then box_id::varchar end, ',' order by position), '') as captions,
  coalesce(string_agg(case when part = 'footnote' then box_id::varchar end, ',' order by position), '') as footnotes from g join b on b.page = g.page and b.grp = g.grp group by g.page, g.grp"""),
)
def grouped(spark, sf):
    part = F.when(F.col("category_id") < 3, "body").when(F.col("category_id") < 6, "caption").otherwise("footnote")
    parts = N.sort_boxes(boxes(spark, sf), "page").withColumns({"grp": F.col("category_id") % 2, "part": part})
    found = N.group_blocks(parts, ["page", "grp"])
    return found.select("page", "grp", "body.x0", "body.y1", "position", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("captions", "footnotes")])


@query(
    "l34_classify_list",
    with_ctes(BOXES, """
ln as (select *, row_number() over (partition by page order by y0, x0, box_id) as line_no, case when page % 3 = 0 then box_id || ' item' when category_id % 2 = 0 then 'item.' else 'plain' end as text from boxes)""", """
wh as (select page, min(x0) as bx0, min(y0) as by0, max(x1) as bx1, max(y1) as by1, arg_min(y1 - y0, line_no) as h, arg_min(x0, line_no) as fx0, arg_max(x0, line_no) as lx0, arg_max(x1, line_no) as lx1 from ln group by page)""", """
st as (select page, any_value(bx0) as bx0, any_value(bx1) as bx1, any_value(by0) as by0, any_value(by1) as by1, any_value(h) as h, any_value(fx0) as fx0, any_value(lx0) as lx0, any_value(lx1) as lx1, count(*) as n,
  count(*) filter (x0 - bx0 > 0.7 * h and bx1 - x1 > 0.7 * h) as sides, count(*) filter (abs((x0 + x1) / 2 - (bx0 + bx1) / 2) < h / 2) as centred, count(*) filter (abs(x0 - bx0) < h / 2) as l_close,
  count(*) filter (abs(x0 - bx0) >= h / 2 and x0 - bx0 > h) as l_open, count(*) filter (abs(bx1 - x1) < h) as r_close,
  count(*) filter (abs(bx1 - x1) >= h and bx1 - x1 > case when (bx1 - bx0) / 600 >= 0.5 then 0.26 else 0.36 end * (bx1 - bx0)) as r_open,
  count(*) filter (ends_with(text, '.')) as ends, count(*) filter (regexp_matches(text, '^\\d')) as ns from ln join wh using (page) group by page)""".replace("\\\\", "\\"), """
select page, n, l_close, r_close, l_open, r_open, case when n < 2 then 'text' when (l_close / n >= 0.8 or r_close / n >= 0.8) and ns / n >= 0.8 then 'index'
  when sides >= 2 and centred = n and sides / n >= 0.5 and (by1 - by0) / (bx1 - bx0) > 0.4 then 'list'
  when l_close >= 2 and (r_open >= 2 or ends / n >= 0.8 or l_open >= 2) and not (fx0 - bx0 > h / 2 and abs(lx0 - bx0) < h / 2 and bx1 - lx1 > h) then 'list' else 'text' end as kind from st"""),
)
def listed(spark, sf):
    w = Window.partitionBy("page").orderBy("y0", "x0", "box_id")
    text = F.when(F.col("page") % 3 == 0, F.concat(F.col("box_id").cast("string"), F.lit(" item"))).when(F.col("category_id") % 2 == 0, "item.").otherwise("plain")
    rows = boxes(spark, sf).withColumns({"line_no": F.row_number().over(w), "text": text, "lang": F.lit("en")})
    return N.classify_list(rows, "page", 600.0)


_BLOCKS = """
blk as (select conv_id, turn as page_idx, i - 1 as block_idx, case when i % 7 = 0 then 'title' when i % 5 = 0 then 'list' else 'text' end as type, case when turn % 2 = 0 then lower(l[i]) else l[i] end as text,
   100 + length(l[i]) % 150 as width, i % 4 <> 3 as starts_flush, length(l[i]) % 3 <> 0 as ends_full from (select conv_id, turn, role, string_split(replace(text, '. ', chr(10)), chr(10)) as l from conversations), unnest(range(1, len(l) + 1)) as u(i))
"""


def blocks(spark, sf):
    rows = load(spark, sf, "conversations").select("conv_id", F.col("turn").alias("page_idx"), F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit("\n")), "\n", -1)).alias("block_idx", "line"))
    i = F.col("block_idx") + 1
    return rows.select(
        "conv_id", "page_idx", "block_idx", F.when(i % 7 == 0, "title").when(i % 5 == 0, "list").otherwise("text").alias("type"),
        F.when(F.col("page_idx") % 2 == 0, F.lower("line")).otherwise(F.col("line")).alias("text"), (F.length("line") % 150 + 100).alias("width"),
        (i % 4 != 3).alias("starts_flush"), (F.length("line") % 3 != 0).alias("ends_full"),
    )


@query(
    "l35_merge_paragraphs",
    with_ctes(_BLOCKS, r"""
bj as (select *, case when (type = 'text' and lag(type) over w = 'text' and starts_flush and lag(ends_full) over w and not list_contains(string_split_regex('.!?。！？)）"”:：;；', ''), right(lag(text) over w, 1))
    and abs(width - lag(width) over w) < least(width, lag(width) over w) and not regexp_matches(text, '^(\d|\p{Lu})') and text <> '') or (type = 'list' and lag(type) over w = 'list') then 0 else 1 end as opens
   from blk window w as (partition by conv_id order by page_idx, block_idx))""", """
bp as (select *, sum(opens) over (partition by conv_id order by page_idx, block_idx) - 1 as para from bj)""", """
select conv_id, para, arg_min(type, {'p': page_idx, 'b': block_idx}) as type, string_agg(text, chr(10) order by page_idx, block_idx) as text, (min(page_idx) < max(page_idx))::int as cross_page from bp group by conv_id, para"""),
)
def paragraphs(spark, sf):
    found = N.merge_paragraphs(blocks(spark, sf), "conv_id")
    return found.withColumn("cross_page", F.col("cross_page").cast("int"))


_TBLOCKS = """
tb as (select page as doc, (row_number() over (partition by page order by box_id) - 1) // 3 as page_idx, ((row_number() over (partition by page order by box_id) - 1) % 3)::int as block_idx, case when flag <> 'N' then 'table' else 'text' end as type, category_id % 2 = 0 as continued from boxes)
"""


@query(
    "l36_table_chains",
    with_ctes(BOXES, _TBLOCKS, """
pg as (select doc, page_idx, arg_min(type = 'table' and continued, block_idx) as linked, max(block_idx) filter (type = 'table') as last_table from tb group by all)""", """
isl as (select *, sum(case when linked and page_idx > 0 then 0 else 1 end) over (partition by doc order by page_idx) as island from pg)""", """
fin as (select *, max(page_idx) over (partition by doc, island) as end_page from isl)""", """
select t.doc, t.page_idx, t.block_idx, case when block_idx = last_table then end_page - t.page_idx else 0 end + 1 as n_parts from tb t join fin f on f.doc = t.doc and f.page_idx = t.page_idx where type = 'table' and not continued"""),
)
def chains(spark, sf):
    w = Window.partitionBy("page").orderBy("box_id")
    n = F.row_number().over(w) - 1
    rows = boxes(spark, sf).select(
        F.col("page").alias("doc"), F.floor(n / 3).alias("page_idx"), (n % 3).alias("block_idx"),
        F.when(F.col("flag") != "N", "table").otherwise("text").alias("type"), (F.col("category_id") % 2 == 0).alias("continued"),
    )
    return N.table_chains(rows, "doc")


# Orders as HTML tables, one row per line item; the second page repeats the header of three in four orders.
_TABLES = """
trs as (select l_orderkey as o, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n, '<tr><td>' || l_linenumber || '</td><td>' || l_partkey || '</td><td>' || l_returnflag || '</td></tr>' as tr from lineitem),
tabs as (select o, '<table><tr><th>n</th><th colspan="2">part</th></tr>' || coalesce(string_agg(case when n % 2 = 1 then tr end, '' order by n), '') || '</table>' as above,
   '<table><tr><th>n</th><th colspan="2">' || case when o % 4 = 0 then 'other' else 'part' end || '</th></tr>' || coalesce(string_agg(case when n % 2 = 0 then tr end, '' order by n), '') || case when o % 5 = 0 then '<tr><td>x</td></tr>' else '' end || '</table>' as below from trs group by o)
"""


def html_tables(spark, sf):
    items = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    rows = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(items)).alias("items"))

    def half(rest):
        def tr(x):
            return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x[c].cast("string"), F.lit("</td>")) for c in ("l_linenumber", "l_partkey", "l_returnflag")], F.lit("</tr>"))

        return F.array_join(F.transform(F.filter("items", lambda x, i: i % 2 == rest), tr), "")

    other = F.when(F.col("o") % 4 == 0, "other").otherwise("part")
    tail = F.when(F.col("o") % 5 == 0, "<tr><td>x</td></tr>").otherwise("")
    return rows.select(
        "o",
        F.concat(F.lit('<table><tr><th>n</th><th colspan="2">part</th></tr>'), half(0), F.lit("</table>")).alias("above"),
        F.concat(F.lit('<table><tr><th>n</th><th colspan="2">'), other, F.lit("</th></tr>"), half(1), tail, F.lit("</table>")).alias("below"),
    )


_TABLE_CELLS = """
cells as (select o, r - 1 as r, i, case when r = 1 and i = 2 then 2 else 1 end as col_span, regexp_extract_all(regexp_extract_all(above, '<tr>(.*?)</tr>', 1)[r], '<t[dh][^>]*>(.*?)</t[dh]>', 1)[i] as text from tabs, unnest(range(1, len(regexp_extract_all(above, '<tr>(.*?)</tr>', 1)) + 1)) as u(r),
   unnest(range(1, case when r = 1 then 3 else 4 end)) as v(i))
"""


@query(
    "t14_table_cells",
    with_ctes(_TABLES, _TABLE_CELLS, "select o, r::int as r, (i - 1)::int as c, 1 as row_span, col_span, text from cells"),
)
def cells(spark, sf):
    return O.table_cells(html_tables(spark, sf), ["o"], "above")


# The first header cell hangs down into the first data row, whose cells all move by one column.
@query(
    "t14_table_cells_spanned",
    with_ctes(_TABLES, _TABLE_CELLS, "select o, r::int as r, (i - 1 + (r = 1)::int)::int as c, case when r = 0 and i = 1 then 2 else 1 end as row_span, col_span, text from cells"),
)
def spanned(spark, sf):
    hung = html_tables(spark, sf).withColumn("above", F.replace("above", F.lit("<th>n</th>"), F.lit('<th rowspan="2">n</th>')))
    return O.table_cells(hung, ["o"], "above")


@query(
    "t15_otsl_cells",
    """select doc_id, unnest([0, 0, 1, 1, 2, 2]) as r, unnest([0, 2, 0, 1, 1, 2]) as c, unnest([1, 1, 2, 1, 1, 1]) as row_span, unnest([2, 1, 1, 2, 1, 1]) as col_span, unnest([lang, source, n_chars::varchar, 'a', '', '']) as text from documents""",
)
def otsl(spark, sf):
    text = F.concat(
        F.lit("<fcel>"), "lang", F.lit("<lcel><fcel> "), "source", F.lit("<nl><fcel>"), F.col("n_chars").cast("string"), F.lit("<fcel>a<lcel><nl><ucel><ecel><nl>")
    )
    return load(spark, sf, "documents").select("doc_id", F.inline(T.otsl_cells(text))).drop("mark")


@query(
    "t16_cells_to_html",
    with_ctes("""
b as (select l_orderkey as o, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n, '<td' || case when l_linenumber % 2 = 0 then ' colspan="2"' else '' end || '>' || l_partkey || '&lt;&amp;' || '</td>' as td from lineitem)""", """
r as (select o, l_linenumber, string_agg(td, '' order by n) as row from b group by all)""", """
select o, '<table>' || string_agg('<tr>' || row || '</tr>', '' order by l_linenumber) || '</table>' as html from r group by o"""),
)
def to_html(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("r"), F.row_number().over(w).alias("c"), F.lit(1).alias("row_span"),
        F.when(F.col("l_linenumber") % 2 == 0, 2).otherwise(1).alias("col_span"), F.concat(F.col("l_partkey").cast("string"), F.lit("<&")).alias("text"),
    )
    return O.cells_to_html(rows, "o")


@query(
    "l37_can_merge_tables",
    with_ctes(_TABLES, "select o, (o % 7 <> 0 and o % 11 <> 0 and o % 3 <> 1)::int as can_merge from tabs"),
)
def mergeable(spark, sf):
    narrow = F.when(F.col("o") % 3 == 1, 80).otherwise(100)
    test = T.can_merge(F.col("above"), F.col("below"), F.lit(100), narrow, F.col("o") % 7 == 0, F.col("o") % 11 == 0)
    return html_tables(spark, sf).select("o", test.cast("int").alias("can_merge"))


_SHARED = r"""
rws as (select o, regexp_extract_all(above, '<tr>(.*?)</tr>', 1) as a, regexp_extract_all(below, '<tr>(.*?)</tr>', 1) as b from tabs),
shr as (select *, case when a[1] <> b[1] then 0 when len(a) < 2 or len(b) < 2 or a[2] <> b[2] then 1 when len(a) < 3 or len(b) < 3 or a[3] <> b[3] then 2 when len(a) < 4 or len(b) < 4 or a[4] <> b[4] then 3
   when len(a) < 5 or len(b) < 5 or a[5] <> b[5] then 4 else 5 end as shared from rws)
"""


@query("l38_shared_header_rows", with_ctes(_TABLES, _SHARED, "select o, shared from shr"))
def shared(spark, sf):
    return html_tables(spark, sf).select("o", T.shared_header_rows(F.col("above"), F.col("below")).alias("shared"))


@query(
    "l39_concat_tables",
    with_ctes(_TABLES, _SHARED, "select o, '<table>' || array_to_string(list_transform(list_concat(a, b[shared + 1:]), lambda r: '<tr>' || r || '</tr>'), '') || '</table>' as html from shr"),
)
def concatenated(spark, sf):
    return html_tables(spark, sf).select("o", T.concat_tables(F.col("above"), F.col("below")).alias("html"))


_KEYWORDS = "[" + ", ".join(f"'{k}'" for k in D.DISCARD_KEYWORDS) + "]"


@query(
    "l40_discard_by_content",
    rf"""with t as (select doc_id, text || case doc_id % 5 when 0 then ' 职业代码表 商业' when 1 then ' 11010519900307123X ' when 2 then ' 1234567 2201005 ' when 3 then ' 22010050 ' else '' end as t from documents)
select doc_id, coalesce(list_filter({_KEYWORDS}, lambda k: contains(t, k))[1], nullif(regexp_extract(t, '(^|[^\dXx])([1-9]\d{{5}}(18|19|20)\d{{2}}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{{3}}[\dXx])($|[^\dXx])', 2), ''),
  list_filter(list_transform(regexp_extract_all(regexp_replace(t, '(\d+)', ' \1 ', 'g'), '(^|\D)(\d+)', 2), lambda n: case when length(n) = 7 and n::bigint between 2201001 and 4101032 then n end), lambda n: n is not null)[1]) as reason from t""",
)
def discarded(spark, sf):
    n = F.col("doc_id") % 5
    extra = F.when(n == 0, " 职业代码表 商业").when(n == 1, " 11010519900307123X ").when(n == 2, " 1234567 2201005 ").when(n == 3, " 22010050 ").otherwise("")
    return load(spark, sf, "documents").select("doc_id", D.discard_reason(F.concat("text", extra)).alias("reason"))


@query(
    "l41_restore_continued",
    with_ctes(BOXES, """
select page, box_id, case when category_id % 2 = 0 and score > 0.2 then 'orig ' || flag else flag end as content, (category_id % 2 = 0 and score > 0.2)::int as restored, (category_id % 2 <> 0)::int as shown from boxes"""),
)
def restored(spark, sf):
    rows = boxes(spark, sf).withColumns({"deleted": F.col("category_id") % 2 == 0, "content": F.col("flag")})
    originals = rows.filter("score > 0.2").withColumn("content", F.concat(F.lit("orig "), "flag"))
    found = N.restore_continued(rows, originals, ["page", "box_id", *B.COORDS])
    # Boxes are shown or not, so the two kinds are put together and not joined with all boxes; one without a page is known by no key.
    shown = N.suppress_restored(found).withColumn("shown", F.col("page").isNotNull().cast("int"))
    hidden = found.filter(F.coalesce("deleted", F.lit(True))).withColumn("shown", F.lit(0))
    return shown.unionByName(hidden).select("page", "box_id", "content", F.col("restored").cast("int").alias("restored"), "shown")


@query(
    "l42_title_level",
    with_ctes(BOXES, """
h as (select page, category_id, avg(y1 - y0) as h from boxes group by all)""", """
select page, category_id, (case when category_id - 2 > 4 then 4 when category_id - 2 < 1 then 0 else category_id - 2 end)::int as level, dense_rank() over (partition by page order by round(h, 6) desc) as by_height from h"""),
)
def title_levels(spark, sf):
    heights_ = boxes(spark, sf).groupBy("page", "category_id").agg(F.round(F.avg(F.col("y1") - F.col("y0")), 6).alias("h"))
    w = Window.partitionBy("page").orderBy(F.desc("h"))
    return heights_.select("page", "category_id", D.title_level(F.col("category_id") - 2).cast("int").alias("level"), F.dense_rank().over(w).alias("by_height"))


_RENDER = r"""
rb as (select doc_id, i - 1 as pos, l[i] as text, ['title', 'text', 'equation', 'image', 'table', 'code'][((doc_id + i) % 6 + 1)::int] as kind, i % 7 as level, case when i % 2 = 0 then 'cap ' || i end as cap, case when i % 3 = 0 then 'note ' || i end as note, 'img/' || i || '.png' as img
  from (select doc_id, string_split(text, chr(10)) as l from documents), unnest(range(1, len(l) + 1)) as u(i)),
rm as (select *, regexp_replace(text, '([*`~$])', '\\\1', 'g') as esc, case when level > 4 then 4 else level end as lv from rb),
rt as (select *, case kind when 'title' then repeat('#', lv::int) || ' ' || esc when 'text' then esc when 'equation' then '$$' || chr(10) || text || chr(10) || '$$' when 'image' then concat_ws('  ' || chr(10), cap, '![](' || img || ')', note)
   when 'table' then concat_ws(chr(10), cap, text, note) else '```' || chr(10) || text || chr(10) || '```' end as md from rm)
"""


def render_blocks(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    i = F.col("pos") + 1
    kinds = F.array(*[F.lit(k) for k in ("title", "text", "equation", "image", "table", "code")])
    n = i.cast("string")
    return rows.select(
        "doc_id", "pos", "text", F.element_at(kinds, ((F.col("doc_id") + i) % 6 + 1).cast("int")).alias("kind"), (i % 7).alias("level"),
        F.when(i % 2 == 0, F.concat(F.lit("cap "), n)).alias("cap"), F.when(i % 3 == 0, F.concat(F.lit("note "), n)).alias("note"), F.concat(F.lit("img/"), n, F.lit(".png")).alias("img"),
    )


@query(
    "l43_to_markdown",
    with_ctes(_RENDER, r"select doc_id, string_agg(md, chr(10) || chr(10) order by pos) as md, string_agg(case when kind not in ('image', 'table') then md end, chr(10) || chr(10) order by pos) as text_md from rt group by doc_id"),
)
def markdown(spark, sf):
    def md(text_only):
        block = D.block_markdown(F.col("kind"), F.col("text"), F.col("level"), F.col("cap"), F.col("img"), F.col("note"), text_only)
        return F.nullif(ordered_join([F.col("pos")], block, "\n\n"), F.lit(""))

    return render_blocks(spark, sf).groupBy("doc_id").agg(md(False).alias("md"), md(True).alias("text_md"))


@query(
    "l44_to_content_list",
    with_ctes(_RENDER, "select doc_id, pos, case when kind in ('title', 'text') then 'text' else kind end as type, case when kind <> 'image' then text end as text, case when kind = 'title' and lv > 0 then lv end as text_level, case when kind = 'image' then img end as img_path, pos as page_idx from rm"),
)
def content(spark, sf):
    record = D.content_record(F.col("kind"), F.col("text"), F.col("level"), F.col("img"), F.col("pos"))
    return render_blocks(spark, sf).select("doc_id", "pos", record.alias("r")).select("doc_id", "pos", "r.*")


@query(
    "l46_row_text",
    with_ctes(BOXES, _line_ctes("ls", "y0", "y1").replace("and category_id <> 5 and lag(category_id) over w <> 5", ""), """
pc as (select page, line, x0, box_id, repeat(' ', greatest(coalesce(floor((x0 - lag(x1) over (partition by page, line order by x0, box_id)) / 10), 0), 0)::int) || flag || category_id as p from ls)""", """
select page, line, string_agg(p, '' order by x0, box_id) as text from pc group by page, line"""),
)
def row_texts(spark, sf):
    rows = boxes(spark, sf).withColumn("text", F.concat("flag", F.col("category_id").cast("string")))
    return N.row_text(rows, "page")


@query("l47_sort_boxes", with_ctes(BOXES, _SORTED, "select page, box_id, row, position from sorted"))
def sorted_boxes(spark, sf):
    return N.sort_boxes(boxes(spark, sf), "page").select("page", "box_id", "row", "position")
