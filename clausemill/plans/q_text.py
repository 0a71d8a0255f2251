"""Registered queries for the text-cleaning functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import text as X
from clausemill.plans.fixtures import MD_DOCS, MD_LINES, md_docs, with_ctes
from clausemill.plans.registry import query
from clausemill.session import load

_WS = r"[\s\pZ]"
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_ALNUM = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c).isalnum())
_WIDE_ALNUM = "".join(chr(ord(c) + 0xFEE0) for c in _ALNUM)


@query(
    "t01_repair_markdown",
    with_ctes(MD_DOCS, MD_LINES, rf"""
fixed as (select doc_id, string_agg(regexp_replace(regexp_replace(line, '{_WS}+$', ''), '^(#{{1,6}})$', '\1 Untitled section'), chr(10) order by i) as t
  from md_lines group by doc_id)""", rf"""
select doc_id, regexp_replace(regexp_replace(t, '^{_WS}+', ''), '{_WS}+$', '') || chr(10) as repaired from fixed"""),
)
def repair(spark, sf):
    return md_docs(spark, sf).select("doc_id", X.repair_markdown(F.col("md")).alias("repaired"))


@query(
    "t02_fix_empty_headers",
    with_ctes(MD_DOCS, MD_LINES, rf"""
select doc_id, string_agg(regexp_replace(line, '^(#+){_WS}*$', '\1 未命名章节'), chr(10) order by i) as fixed
from md_lines group by doc_id"""),
)
def fix_headers(spark, sf):
    return md_docs(spark, sf).select("doc_id", X.fix_empty_headers(F.col("md")).alias("fixed"))


@query(
    "t03_placeholder_empty_sections",
    with_ctes(MD_DOCS, """
all_lines as (select doc_id, i - 1 as i, ls[i] as line from (select doc_id, string_split(md, chr(10)) ls from md_docs), unnest(range(1, len(ls) + 1)) as u(i))""", """
marked as (select *, sum(case when regexp_matches(line, '^#+ ') then 1 else 0 end) over (partition by doc_id order by i) as sec from all_lines)""", """
secs as (select doc_id, sec, min(line order by i) as head0, arg_min(line, i) as head, count(*) as n,
   string_agg(line, chr(10) order by i) as whole,
   coalesce(string_agg(case when i > first_i then line end, chr(10) order by i), '') as body,
   max(sec) over (partition by doc_id) as last_sec
  from (select *, min(i) over (partition by doc_id, sec) as first_i from marked) group by doc_id, sec)""", rf"""
pieces as (select doc_id, sec, case when sec = 0 then whole || case when sec < last_sec then chr(10) else '' end
   when regexp_replace(body, '{_WS}+', '', 'g') = '' then head || chr(10) || chr(10) || '本节无正文内容' || chr(10) || chr(10)
   else whole || case when sec < last_sec then chr(10) else '' end end as piece from secs)""", """
select doc_id, string_agg(piece, '' order by sec) as filled from pieces group by doc_id"""),
)
def placeholders(spark, sf):
    return md_docs(spark, sf).select("doc_id", X.placeholder_empty_sections(F.col("md")).alias("filled"))


@query(
    "t04_full_to_half",
    f"""select doc_id, translate(w, '{_WIDE}', '{_ASCII}') as half, translate(w, '{_WIDE_ALNUM}', '{_ALNUM}') as half_alnum
from (select doc_id, translate(text, '{_ASCII}', '{_WIDE}') as w from documents)""",
)
def widths(spark, sf):
    wide = load(spark, sf, "documents").select("doc_id", X.half_to_full(F.col("text")).alias("w"))
    return wide.select(
        "doc_id", X.full_to_half(F.col("w")).alias("half"), X.full_to_half(F.col("w"), True).alias("half_alnum")
    )


@query(
    "t05_fix_ligatures",
    """select doc_id, replace(replace(replace(replace(replace(replace(replace(w, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'ft'), 'ﬆ', 'st') as plain,
  replace(replace(c, chr(13) || chr(10), ''), chr(2), '-') as controlled
from (select doc_id, replace(replace(replace(text, 'st', 'ﬆ'), 'en', 'ﬃ'), 'er', 'ﬁ') as w,
  replace(replace(text, chr(10), chr(13) || chr(10)), ', ', chr(2)) as c from documents)""",
)
def ligatures(spark, sf):
    def swap(col, *pairs):
        for a, b in pairs:
            col = F.replace(col, F.lit(a), F.lit(b))
        return col

    docs = load(spark, sf, "documents").select(
        "doc_id",
        swap(F.col("text"), ("st", "ﬆ"), ("en", "ﬃ"), ("er", "ﬁ")).alias("w"),
        swap(F.col("text"), ("\n", "\r\n"), (", ", "\u0002")).alias("c"),
    )
    return docs.select(
        "doc_id", X.fix_ligatures(F.col("w")).alias("plain"), X.fix_control(F.col("c")).alias("controlled")
    )


@query(
    "t06_strip_invalid",
    r"""select doc_id, regexp_replace(replace(replace(text, ', ', chr(7)), 'e', 'e' || chr(8203)), '\pC', '', 'g') as valid from documents""",
)
def invalid(spark, sf):
    noisy = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit("\u0007")), F.lit("e"), F.lit("e​"))
    return load(spark, sf, "documents").select("doc_id", X.strip_invalid(noisy).alias("valid"))


@query(
    "t07_escape_markdown",
    r"""select doc_id, regexp_replace(text, '([*`~$])', '\\\1', 'g') as escaped from documents""",
)
def escape(spark, sf):
    return load(spark, sf, "documents").select("doc_id", X.escape_markdown(F.col("text")).alias("escaped"))


# Formula marks put into the text: every comma opens or closes one, by its place.
_FORMULA = r"""
marked as (
  select doc_id, case when doc_id % 3 = 0 then '\[' || replace(t, '. ', '\] \[') || '\]' else t end as boxed,
     array_to_string(list_transform(string_split(t, ', '), lambda x, i: x || case when i % 2 = 1 then ' \(' else '\) ' end), '') as inlined,
     '```text' || chr(10) || t || chr(10) || case when doc_id % 2 = 0 then '```' else 'end' end as fenced
  from (select doc_id, text as t from documents))
"""


def _marked(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id",
        F.when(
            F.col("doc_id") % 3 == 0,
            F.concat(F.lit("\\["), F.replace("text", F.lit(". "), F.lit("\\] \\[")), F.lit("\\]")),
        ).otherwise(F.col("text")).alias("boxed"),
        F.array_join(
            F.transform(
                F.split("text", ", ", -1), lambda x, i: F.concat(x, F.when(i % 2 == 0, " \\(").otherwise("\\) "))
            ),
            "",
        ).alias("inlined"),
        F.concat(
            F.lit("```text\n"), "text", F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "```").otherwise("end")
        ).alias("fenced"),
    )


def _sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


@query(
    "t08_clean_formula",
    with_ctes(_FORMULA, rf"""
select doc_id, {_sql_strip(r"regexp_replace(regexp_replace(boxed, '^\\\[', ''), '\\\]$', '')")} as bare,
  case when len(string_split(boxed, '\[')) = len(string_split(boxed, '\]')) and len(string_split(boxed, '\[')) > 1
    then regexp_replace(boxed, '\\\[(.*?)\\\]', '[\1]', 'g') else boxed end as unwrapped,
  {_sql_strip("array_to_string(list_slice(string_split(fenced, chr(10)), 2, len(string_split(fenced, chr(10))) - case when doc_id % 2 = 0 then 1 else 0 end), chr(10))")} as code
from marked"""),
)
def formulas(spark, sf):
    return _marked(spark, sf).select(
        "doc_id",
        X.clean_display_formula(F.col("boxed")).alias("bare"),
        X.unwrap_bracket_formula(F.col("boxed")).alias("unwrapped"),
        X.strip_code_fence(F.col("fenced")).alias("code"),
    )


@query(
    "t09_split_inline_formula",
    with_ctes(_FORMULA, rf"""
cut as (select doc_id, case when len(string_split(inlined, '\(')) = len(string_split(inlined, '\)')) and len(string_split(inlined, '\(')) > 1
    then list_filter(list_transform(string_split(regexp_replace(inlined, '\\\((.+?)\\\)', chr(57344) || chr(57345) || '\1' || chr(57344), 'g'), chr(57344)),
       lambda p: case when starts_with(p, chr(57345)) then {{'type': 'inline_equation', 'content': {_sql_strip("p[2:]")}}} else {{'type': 'text', 'content': p}} end),
       lambda q: q.type = 'inline_equation' or {_sql_strip("q.content")} <> '')
    else [{{'type': 'text', 'content': inlined}}] end as ps from marked)""", """
select doc_id, pos - 1 as pos, ps[pos].type as type, ps[pos].content as content from cut, unnest(range(1, len(ps) + 1)) as u(pos)"""),
)
def inline_formulas(spark, sf):
    return (
        _marked(spark, sf)
        .select("doc_id", F.posexplode(X.split_inline_formula(F.col("inlined"))).alias("pos", "piece"))
        .select("doc_id", "pos", F.col("piece.type").alias("type"), F.col("piece.content").alias("content"))
    )


def _cjk(spark, sf):
    lead = F.element_at(F.array(F.lit("保险责任"), F.lit("ひらがなカナ"), F.lit("보험금"), F.lit("term ")), (F.col("doc_id") % 4 + 1).cast("int"))
    return load(spark, sf, "documents").select(
        "doc_id", F.concat(F.repeat(lead, (F.col("doc_id") % 61).cast("int")), "text").alias("mixed")
    )


_CJK = """
mixed as (select doc_id, repeat(['保险责任', 'ひらがなカナ', '보험금', 'term '][(doc_id % 4 + 1)::int], (doc_id % 61)::int) || text as mixed from documents)
"""
_CJK_LANG = r"""
langs as (select doc_id, mixed, case when kana * 20 >= letters then 'ja' when hangul * 10 >= letters * 3 then 'ko'
    when (han + kana) * 10 >= letters * 3 then 'zh' else 'other' end as lang
  from (select doc_id, mixed, greatest(1, length(regexp_replace(mixed, '[^\pL]', '', 'g'))) as letters,
    length(regexp_replace(mixed, '[^\p{Hiragana}\p{Katakana}]', '', 'g')) as kana,
    length(regexp_replace(mixed, '[^\p{Hangul}]', '', 'g')) as hangul,
    length(regexp_replace(mixed, '[^\p{Han}]', '', 'g')) as han from mixed))
"""


@query("t10_script_lang", with_ctes(_CJK, _CJK_LANG, "select doc_id, lang from langs"))
def langs(spark, sf):
    return _cjk(spark, sf).select("doc_id", X.script_lang(F.col("mixed")).alias("lang"))


@query(
    "t11_join_lines",
    with_ctes(_CJK, _CJK_LANG, rf"""
ls as (select doc_id, lang, i, {_sql_strip("l[i]")} as s from (select doc_id, lang, string_split(replace(mixed, ', ', '-' || chr(10)), chr(10)) as l from langs), unnest(range(1, len(l) + 1)) as u(i))""", """
select doc_id, string_agg(case when lang in ('zh', 'ja', 'ko') then s when regexp_matches(s, '[A-Za-z]+-$') then s[:-2] else s || ' ' end, '' order by i) as para
from ls where s <> '' group by doc_id"""),
)
def joined(spark, sf):
    docs = _cjk(spark, sf)
    broken = F.split(F.replace("mixed", F.lit(", "), F.lit("-\n")), "\n", -1)
    return docs.select("doc_id", X.join_lines(broken, X.script_lang(F.col("mixed"))).alias("para"))


@query(
    "t12_promote_headings",
    with_ctes(rf"""
ls as (select doc_id, i, {_sql_strip("case when i % 5 = 0 then '第' || i || '条 ' || l[i] when i % 7 = 0 then '特别约定' else l[i] end")} as s
  from (select doc_id, string_split(text, chr(10)) as l from documents), unnest(range(1, len(l) + 1)) as u(i))""", """
kept as (select doc_id, row_number() over (partition by doc_id order by i) as i, s from ls where s <> '')""", """
flags as (select *, i = 1 or regexp_matches(s, '^第[一二三四五六七八九十百零0-9]+条') or s = '特别约定' as h from kept)""", """
groups as (select *, sum(case when h or prev_h then 1 else 0 end) over (partition by doc_id order by i) as g
  from (select *, coalesce(lag(h) over (partition by doc_id order by i), true) as prev_h from flags))""", """
paras as (select doc_id, g, string_agg(case when i = 1 then '# ' || s when h then '## ' || s else s end, '' order by i) as p from groups group by doc_id, g)""", """
select doc_id, string_agg(p, chr(10) || chr(10) order by g) || chr(10) as promoted from paras group by doc_id"""),
)
def promoted(spark, sf):
    marked = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.when((i + 1) % 5 == 0, F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("条 "), x))
        .when((i + 1) % 7 == 0, "特别约定")
        .otherwise(x),
    )
    return load(spark, sf, "documents").select(
        "doc_id", X.promote_headings(F.array_join(marked, "\n")).alias("promoted")
    )


@query(
    "t13_find_and_replace_tables",
    with_ctes("""
tabled as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
   case when i % 4 = 2 then '<Table class="c">' || x || chr(10) || x || '</TABLE>' else x end), chr(10)) as t from documents)""", """
select doc_id, len(regexp_extract_all(t, '(?is)<table\\b[^>]*>.*?</table>')) as n_tables,
  regexp_replace(t, '(?is)<table\\b[^>]*>(.*?)</table>', '[\\1]', 'g') as replaced from tabled""".replace("\\\\", "\\")),
)
def tables_replaced(spark, sf):
    tabled = load(spark, sf, "documents").select(
        "doc_id",
        F.array_join(
            F.transform(
                F.split("text", "\n", -1),
                lambda x, i: F.when(
                    i % 4 == 1, F.concat(F.lit('<Table class="c">'), x, F.lit("\n"), x, F.lit("</TABLE>"))
                ).otherwise(x),
            ),
            "\n",
        ).alias("t"),
    )
    found = X.find_tables(F.col("t"))
    texts = F.transform(found, lambda b: F.concat(F.lit("["), F.regexp_replace(b, "(?i)</?table[^>]*>", ""), F.lit("]")))
    return tabled.select(
        "doc_id", F.size(found).alias("n_tables"), X.replace_tables(F.col("t"), texts).alias("replaced")
    )


@query(
    "t17_parse_storage_path",
    with_ctes("""
paths as (select page_id, case when page_id % 3 = 0 then url else replace(split_part(url, '?', 1), 'http://', 's3://') || case when page_id % 3 = 1 then '?bytes=' || page_id || ',' || page_id * 2 else '' end end as p from pages)""", r"""
select page_id, nullif(regexp_extract(split_part(p, '?', 1), '^s3a?://([^/]*)/', 1), '') as bucket,
  case when regexp_matches(p, '^s3a?://[^/?]*/') then regexp_extract(split_part(p, '?', 1), '^s3a?://[^/]*/(.*)$', 1) end as key,
  try_cast(nullif(regexp_extract(p, '\?bytes=(\d+),', 1), '') as bigint) as range_start, try_cast(nullif(regexp_extract(p, '\?bytes=\d+,(\d+)', 1), '') as bigint) as range_end
from paths"""),
)
def storage(spark, sf):
    pages = load(spark, sf, "pages")
    ranged = F.concat(F.lit("?bytes="), F.col("page_id").cast("string"), F.lit(","), (F.col("page_id") * 2).cast("string"))
    moved = F.replace(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("http://"), F.lit("s3://"))
    path = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(
        F.concat(moved, F.when(F.col("page_id") % 3 == 1, ranged).otherwise(""))
    )
    return pages.select("page_id", X.storage_path(path).alias("s")).select("page_id", "s.*")


@query(
    "t18_content_hash",
    """select doc_id, md5(text) as text_md5, upper(md5(text)) as bytes_md5, sha256(text) as text_sha256,
  md5('{"lang":"' || lang || '","n_chars":"' || n_chars || '","source":"' || source || '"}') as map_md5 from documents""",
)
def hashes(spark, sf):
    entries = F.create_map(
        F.lit("source"), "source", F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("lang"), "lang"
    )
    return load(spark, sf, "documents").select(
        "doc_id",
        X.text_md5(F.col("text")).alias("text_md5"),
        X.bytes_md5(F.encode("text", "UTF-8")).alias("bytes_md5"),
        X.text_sha256(F.col("text")).alias("text_sha256"),
        X.map_md5(entries).alias("map_md5"),
    )
