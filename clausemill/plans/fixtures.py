"""Inputs that operators need, derived from the given tables.

Each one has a Spark form and the same thing as a DuckDB CTE. They keep every
row and the whole text; numbers only choose what a row looks like.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.functions.boxes import rounded
from clausemill.session import load, load_spread

NL = "chr(10)"


def with_ctes(*parts: str) -> str:
    """``with a as (..), b as (..) body`` from CTE texts and a final body."""
    *ctes, body = parts
    return "with recursive " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: every third line is a heading, some lines are code fences,
    every 20th document opens with a file mark and has another in its middle."""
    docs = load_spread(spark, sf_dir, "documents").select("doc_id", "text")
    line = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.when(
            (F.col("doc_id") % 20 == 0) & (i % 12 == 0),
            F.concat(F.lit("# FILE: part_"), i.cast("string"), F.lit(".md"), F.when(i % 24 == 0, " | 条款文档").otherwise("")),
        )
        .when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (1 + (F.col("doc_id") + i) % 4).cast("int")), F.lit(" "), x))
        .when(i % 11 == 5, F.lit("```"))
        .otherwise(x),
    )
    return docs.select("doc_id", F.array_join(line, "\n").alias("md"))


MD_DOCS = """
md_docs as (
  select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
    case when doc_id % 20 = 0 and (i - 1) % 12 = 0
           then '# FILE: part_' || (i - 1) || '.md' || case when (i - 1) % 24 = 0 then ' | 条款文档' else '' end
         when (i - 1) % 3 = 0 then repeat('#', (1 + (doc_id + i - 1) % 4)::int) || ' ' || x
         when (i - 1) % 11 = 5 then '```' else x end), chr(10)) as md
  from documents)
"""

MD_LINES = """
md_lines as (
  select doc_id, i - 1 as i, ls[i] as line
  from (select doc_id, string_split(md, chr(10)) as ls from md_docs), unnest(range(1, len(ls) + 1)) as u(i)
  where not (i = len(ls) and ls[i] = ''))
"""

_WS = r"[\s\pZ]"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


# Chunks of md_docs, stated with windows over lines.
_LAST = ", ".join(
    f"max(case when h and level = {k} then i end) over w as p{k}, "
    f"arg_max(case when h and level = {k} then title end, case when h and level = {k} then i end) over w as t{k}"
    for k in range(1, 7)
)
_KEEP = ", ".join(
    f"case when p{k} is not null and p{k} > greatest(-1, {', '.join(f'coalesce(p{j}, -1)' for j in range(1, k)) or '-1'}) then t{k} end as k{k}"
    for k in range(1, 7)
)
_PARTS = ", ".join(f"case when k{k} is not null then '{k}' || chr(1) || k{k} end" for k in range(1, 7))
_PATH = ", ".join(rf"regexp_replace(k{k}, '\s*\[\d+(?:-\d+)?\]$', '')" for k in range(1, 7))
MD_CHUNKS = f"""
c_lines as (select doc_id, i - 1 as i, {sql_strip('ls[i]')} as s from (select doc_id, string_split(md, chr(10)) ls from md_docs), unnest(range(1, len(ls) + 1)) as u(i)),
c_fence as (select *, regexp_matches(s, '^(```|~~~)') and not regexp_matches(s, '^```.*```') as f from c_lines),
c_code as (select *, f or coalesce(sum(f::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as code from c_fence),
c_head as (select *, not code and regexp_matches(s, '^#+( |$)') as h, length(regexp_extract(s, '^(#+)', 1)) as level from c_code),
c_title as (select *, case when h then {sql_strip('s[level + 1:]')} end as title, sum(h::int) over (partition by doc_id order by i) as sec from c_head),
c_last as (select *, {_LAST} from c_title window w as (partition by doc_id order by i)),
c_keep as (select *, {_KEEP} from c_last),
c_secs as (select doc_id, sec, min(i) as line_idx, first(concat_ws(chr(2), {_PARTS})) as parts, first(concat_ws('/', {_PATH})) as structure_path,
   regexp_replace(regexp_replace(string_agg(case when s = '' and not code then chr(57344) else s end, chr(10) order by i),
      '^(' || chr(57344) || '\n?)+|(\n?' || chr(57344) || ')+$', '', 'g'), '\n(' || chr(57344) || '\n)+', '  ' || chr(10), 'g') as body
   from c_keep group by doc_id, sec),
c_full as (select *, case when parts = '' then 0 else len(string_split(parts, chr(2))) end as n from c_secs where body <> ''),
c_lag as (select *, lag(parts) over (partition by doc_id order by sec) as pp, lag(n) over (partition by doc_id order by sec) as pn, lag(body) over (partition by doc_id order by sec) as pb from c_full),
c_flag as (select *, case when pp is null then 1 when pp = parts or (pn < n and regexp_matches(pb, '(^|\n)#[^\n]*$')) then 0 else 1 end as opens from c_lag),
c_no as (select *, sum(opens) over (partition by doc_id order by sec) - 1 as original_index from c_flag),
md_chunks as (select doc_id, original_index::int as original_index, min(line_idx) as line_idx, string_agg(body, '  ' || chr(10) order by sec) as page_content,
   arg_max(structure_path, sec) as structure_path, arg_max(parts, sec) as parts, arg_max(n, sec)::int as structure_level from c_no group by doc_id, original_index)
"""

MD_FILES = r"""
f_marks as (select doc_id, i as start_line, regexp_extract(line, '^#\s+FILE:\s*([^|]+?)(?:\s*\|\s*(.+))?$', 1) as file_name,
   nullif(regexp_extract(line, '^#\s+FILE:\s*([^|]+?)(?:\s*\|\s*(.+))?$', 2), '') as file_class, n_lines
   from (select *, max(i) over (partition by doc_id) + 1 as n_lines from md_lines) where regexp_matches(line, '^#\s+FILE:\s*([^|]+?)(?:\s*\|\s*(.+))?$')),
md_files as (select doc_id, start_line, coalesce(lead(start_line) over (partition by doc_id order by start_line), n_lines) - 1 as end_line, file_name, file_class from f_marks)
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes of a page per part."""
    from pyspark.sql import Window

    items = load(spark, sf_dir, "lineitem")
    others = [c for c in items.columns if c != "l_partkey"]
    # Rows alike up to the last column that a box shows are alike as boxes, so what comes after it need not travel.
    w = Window.partitionBy("l_partkey").orderBy(*others[: others.index("l_returnflag") + 1])
    # Numbered first and derived after, so the shuffle carries no derived columns and like uses can share it.
    items = items.withColumn("box_id", F.row_number().over(w))
    x0 = F.col("l_linenumber") * 40
    y0 = rounded(F.col("l_quantity")).cast("int") * 10
    return items.select(
        F.col("l_partkey").alias("page"),
        "box_id",
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 60 + F.col("l_suppkey") % 40).cast("int").alias("x1"),
        (y0 + 14 + rounded(F.col("l_tax") * 100).cast("int")).alias("y1"),
        rounded(F.col("l_discount") * 10, 2).alias("score"),
        F.col("l_linenumber").alias("category_id"),
        F.col("l_returnflag").alias("flag"),
    )


BOXES = """
boxes as (select l_partkey as page, row_number() over (partition by l_partkey order by l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::int as box_id,
  (l_linenumber * 40)::int as x0, round(l_quantity)::int * 10 as y0, (l_linenumber * 40 + 60 + l_suppkey % 40)::int as x1, round(l_quantity)::int * 10 + 14 + round(l_tax * 100)::int as y1,
  round(l_discount * 10, 2) as score, l_linenumber as category_id, l_returnflag as flag from lineitem)
"""
_I = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
_AA, _AB = "(a.x1 - a.x0) * (a.y1 - a.y0)", "(b.x1 - b.x0) * (b.y1 - b.y0)"
PAIRS = f"""
prs as materialized (select a.page, a.box_id as a, b.box_id as b, {_I} as inter, {_I} / ({_AA} + {_AB} - {_I}) as iou, {_I} / least({_AA}, {_AB}) as osmall, {_I} / ({_AA}) as ofirst, {_AA} as aa, {_AB} as ab,
   a.score as sa, b.score as sb, a.category_id as ca, b.category_id as cb, a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1, b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1
  from boxes a join boxes b on a.page = b.page and a.box_id <> b.box_id and greatest(a.x0, b.x0) <= least(a.x1, b.x1) and greatest(a.y0, b.y0) <= least(a.y1, b.y1))
"""
