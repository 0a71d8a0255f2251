"""Registered queries for Markdown structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import markdown as M
from clausemill.functions.ordered import ordered_join
from clausemill.operators import structure as S
from clausemill.plans.fixtures import MD_CHUNKS, MD_DOCS, MD_FILES, MD_LINES, md_docs, sql_strip, with_ctes
from clausemill.plans.registry import query
from clausemill.session import cut_lineage, load_spread

_HEADS = rf"""
heads as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as idx, i as line_idx, length(regexp_extract(line, '^(#+)', 1)) as level,
  {sql_strip(r"regexp_extract(line, '^#+[\s\pZ]+(.+)$', 1)")} as title from md_lines where regexp_matches(line, '^#+[\s\pZ]+(.+)$'))
"""


@query("d01_headers", with_ctes(MD_DOCS, MD_LINES, _HEADS, "select doc_id, idx, line_idx, level, title from heads"))
def headers(spark, sf):
    return S.headers(md_docs(spark, sf), "doc_id", "md")


@query(
    "d02_catalog",
    with_ctes(MD_DOCS, MD_LINES, _HEADS, """
select doc_id, coalesce(c, '') as catalog from (select distinct doc_id from md_docs) left join
  (select doc_id, string_agg(repeat('#', level::int) || ' ' || title || ' [' || idx || ']', chr(10) order by idx) as c from heads group by doc_id) using (doc_id)"""),
)
def catalog(spark, sf):
    return md_docs(spark, sf).select("doc_id", M.catalog(M.headers(F.col("md"))).alias("catalog"))


_BATCHES = """
batches as (select doc_id, idx, level, title, batch, batch = 0 or idx >= batch * 9 + 3 as updates
  from heads, unnest(range(0, (idx // 9) + 1)) as u(batch) where idx < batch * 9 + 12)
"""


@query(
    "d03_overlap_batches",
    with_ctes(MD_DOCS, MD_LINES, _HEADS, _BATCHES, "select doc_id, idx, batch, updates::int as updates from batches"),
)
def batches(spark, sf):
    found = S.overlap_batches(S.headers(md_docs(spark, sf), "doc_id", "md"), "doc_id", 12, 3)
    return found.select("doc_id", "idx", "batch", F.col("updates").cast("int").alias("updates"))


@query(
    "d04_apply_header_fixes",
    with_ctes(MD_DOCS, MD_LINES, _HEADS, _BATCHES, """
said as (select doc_id, idx, level % 3 + 1 as level, 'B' || batch || ' ' || title as title from batches where updates and (level + batch) % 2 = 0 and title <> '')""", """
select h.doc_id, h.idx, h.line_idx, coalesce(s.level, h.level)::int as level, coalesce(s.title, h.title) as title, (s.idx is not null)::int as fixed
from heads h left join said s on h.doc_id = s.doc_id and h.idx = s.idx"""),
)
def header_fixes(spark, sf):
    found = S.headers(md_docs(spark, sf), "doc_id", "md")
    line = F.concat(
        F.repeat(F.lit("#"), F.col("level") % 3 + 1),
        F.lit(" B"), F.col("batch").cast("string"), F.lit(" "), F.col("title"), F.lit(" ["), F.col("idx").cast("string"), F.lit("]"),
    )
    replies = (
        S.overlap_batches(found, "doc_id", 12, 3)
        .withColumn("line", F.when((F.col("level") + F.col("batch")) % 2 == 0, line).otherwise("no change"))
        .groupBy("doc_id", "batch")
        .agg(ordered_join([F.col("idx")], F.col("line"), "\n").alias("reply"))
    )
    fixed = S.apply_header_fixes(found, replies, "doc_id", 12, 3)
    return fixed.withColumn("fixed", F.col("fixed").cast("int"))


def md_chunks(spark, sf, **kw):
    return S.chunks(md_docs(spark, sf), "doc_id", "md", **kw)


@query(
    "d05_chunk_by_header",
    with_ctes(MD_DOCS, MD_CHUNKS, "select doc_id, original_index, page_content from md_chunks"),
)
def chunk_rows(spark, sf):
    return md_chunks(spark, sf).select("doc_id", "original_index", "page_content")


@query(
    "d06_structure_path",
    with_ctes(MD_DOCS, MD_CHUNKS, "select doc_id, original_index, structure_path, structure_level from md_chunks"),
)
def paths(spark, sf):
    return md_chunks(spark, sf).select("doc_id", "original_index", "structure_path", "structure_level")


@query(
    "d07_strip_index_mark",
    with_ctes(MD_DOCS, MD_LINES, _HEADS, rf"""
select doc_id, idx, {sql_strip(r"regexp_replace(title || case when idx % 3 = 0 then ' [' || idx || ']' when idx % 3 = 1 then '[' || idx || '-' || idx + 2 || ']' else ' [x]' end, '\s*\[\d+(?:-\d+)?\]$', '')")} as clean from heads"""),
)
def index_marks(spark, sf):
    idx = F.col("idx").cast("string")
    mark = (
        F.when(F.col("idx") % 3 == 0, F.concat(F.lit(" ["), idx, F.lit("]")))
        .when(F.col("idx") % 3 == 1, F.concat(F.lit("["), idx, F.lit("-"), (F.col("idx") + 2).cast("string"), F.lit("]")))
        .otherwise(" [x]")
    )
    found = S.headers(md_docs(spark, sf), "doc_id", "md")
    return found.select("doc_id", "idx", M.strip_index_mark(F.concat("title", mark)).alias("clean"))


@query(
    "d08_parse_file_marker",
    with_ctes(MD_DOCS, MD_LINES, _HEADS, r"""
select doc_id, idx, regexp_extract(title, '^FILE:\s*([^|]+?)(?:\s*\|\s*(.+))?$', 1) as file_name, nullif(regexp_extract(title, '^FILE:\s*([^|]+?)(?:\s*\|\s*(.+))?$', 2), '') as file_class
from heads where regexp_matches(title, '^FILE:\s*([^|]+?)(?:\s*\|\s*(.+))?$')"""),
)
def markers(spark, sf):
    found = S.headers(md_docs(spark, sf), "doc_id", "md").withColumn("m", M.parse_file_marker(F.col("title")))
    return found.filter(F.col("m").isNotNull()).select("doc_id", "idx", "m.*")


@query(
    "d09_file_sections",
    with_ctes(MD_DOCS, MD_LINES, MD_FILES, "select doc_id, start_line, end_line, file_name, file_class from md_files"),
)
def sections(spark, sf):
    return md_docs(spark, sf).select("doc_id", F.inline(M.file_sections(F.col("md"))))


@query(
    "d10_attribute_file",
    with_ctes(MD_DOCS, MD_LINES, MD_CHUNKS, MD_FILES, """
first_file as (select doc_id, arg_min(file_name, start_line) as fn, arg_min(file_class, start_line) as fc0, min(start_line) as s0 from md_files group by doc_id)""", """
select c.doc_id, c.original_index, case when f.start_line is not null then f.file_name else g.fn end as file_name,
   case when f.start_line is not null then f.file_class else (select m.file_class from md_files m where m.doc_id = c.doc_id and m.start_line = g.s0) end as file_class
from md_chunks c left join first_file g on g.doc_id = c.doc_id
  left join md_files f on f.doc_id = c.doc_id and c.line_idx between f.start_line and f.end_line"""),
)
def attributed(spark, sf):
    return md_chunks(spark, sf).select("doc_id", "original_index", "file_name", "file_class")


@query(
    "d10_attribute_file_compat",
    with_ctes(MD_DOCS, MD_LINES, MD_CHUNKS, MD_FILES, f"""
placed as (select c.doc_id, c.original_index, case when instr(d.md, first) = 0 then null else len(string_split(d.md[:instr(d.md, first) - 1], chr(10))) - 1 end as line_idx
  from (select *, {sql_strip("string_split(page_content, chr(10))[1]")} as first from md_chunks) c join md_docs d using (doc_id))""", """
edges as (select doc_id, min(start_line) as s0, max(start_line) as s1 from md_files group by doc_id)""", """
select p.doc_id, p.original_index, f.file_name, f.file_class from placed p left join edges e on e.doc_id = p.doc_id
  left join md_files f on f.doc_id = p.doc_id and case when p.line_idx is null then f.start_line = e.s1 when p.line_idx < e.s0 then f.start_line = e.s0
    else p.line_idx between f.start_line and f.end_line end"""),
)
def attributed_compat(spark, sf):
    return md_chunks(spark, sf, compat_files=True).select("doc_id", "original_index", "file_name", "file_class")


def doc_chunks(spark, sf):
    """Whole documents as single chunks, the input of oversize splitting."""
    return load_spread(spark, sf, "documents").select(
        "doc_id", F.lit(0).alias("original_index"), F.lit(0).alias("split_part"), F.col("text").alias("page_content")
    )


@query(
    "d11_split_oversize",
    """select doc_id, case when n > 1 then k + 1 else 0 end as split_part, n as split_total, substring(text, (k * 5800 + 1)::bigint, 6000) as page_content
from (select doc_id, text, case when length(text) <= 6000 then 1 else ceil((length(text) - 6000) / 5800.0)::int + 1 end as n from documents), unnest(range(0, n)) as u(k)""",
)
def oversize(spark, sf):
    return S.split_oversize(doc_chunks(spark, sf)).select("doc_id", "split_part", "split_total", "page_content")


@query("d11_split_at_separators")
def separators(spark, sf):
    return S.split_at_separators(doc_chunks(spark, sf)).select("doc_id", "split_part", "split_total", "page_content")


@query(
    "d12_rebuild_text",
    with_ctes(MD_DOCS, MD_CHUNKS, """
select doc_id, string_agg(page_content, chr(10) || chr(10) order by original_index) as parsed from md_chunks group by doc_id"""),
)
def rebuilt(spark, sf):
    return S.rebuild_text(md_chunks(spark, sf), "doc_id")


@query(
    "d13_fetch_by_index",
    with_ctes(MD_DOCS, MD_CHUNKS, """
asked as (select doc_id, original_index as parent_index, structure_path, original_index - structure_level * 1000000 as pos from md_chunks where structure_level in (1, 2))""", """
owned as (select c.doc_id, c.original_index, arg_min(a.parent_index, a.pos) as parent_index from md_chunks c join asked a
   on a.doc_id = c.doc_id and a.structure_path <> '' and starts_with(c.structure_path, a.structure_path || '/')
   where c.structure_level not in (1, 2) group by c.doc_id, c.original_index)""", """
members as (select doc_id, parent_index, original_index, 1 as below from owned union all select doc_id, parent_index, parent_index, 0 from asked)""", """
select m.doc_id, m.parent_index, string_agg(c.page_content, chr(10) order by below, m.original_index) as content,
  max(case when below = 0 then c.structure_path end) as structure_path, sum(below) as n_below
from members m join md_chunks c on c.doc_id = m.doc_id and c.original_index = m.original_index group by m.doc_id, m.parent_index"""),
)
def fetched(spark, sf):
    rows = cut_lineage(md_chunks(spark, sf))
    wanted = rows.filter(F.col("structure_level").isin(1, 2)).select(
        "doc_id", "original_index", (F.col("original_index") - F.col("structure_level") * 1000000).alias("pos")
    )
    return S.fetch_by_index(rows, wanted, "doc_id")


@query(
    "d14_subtree",
    with_ctes(MD_DOCS, MD_CHUNKS, """
select a.doc_id, a.original_index as ancestor_index, c.original_index as descendant_index from md_chunks a join md_chunks c
  on a.doc_id = c.doc_id and a.structure_path <> '' and starts_with(c.structure_path, a.structure_path || '/')"""),
)
def subtree(spark, sf):
    rows = md_chunks(spark, sf).select("doc_id", "original_index", "structure_path")  # the rest need not be stored
    return S.descendants(cut_lineage(rows), "doc_id")
