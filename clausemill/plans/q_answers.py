"""Registered queries for reply parsing. Replies are stated from each document's own columns and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import answers as A
from clausemill.functions.text import sorted_json
from clausemill.operators import answers as O
from clausemill.plans.fixtures import with_ctes
from clausemill.plans.registry import query
from clausemill.session import load


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def replies(spark, sf):
    docs = load(spark, sf, "documents")

    def obj(n, title):
        return F.concat(F.lit('{"index":'), _s(n), F.lit(',"title":"'), title, F.lit('"}'))

    docs = docs.withColumns({"o1": obj(F.col("doc_id") % 50, F.col("lang")), "o2": obj(F.col("n_chars") % 50, F.col("source"))})
    n = F.col("doc_id") % 5
    reply = (
        F.when(n == 0, F.concat(F.lit("note\n```json\n["), "o1", F.lit(","), "o2", F.lit("]\n```\n"), "text"))
        .when(n == 1, F.concat(F.lit("```\n[[1],["), "o1", F.lit(","), "o2", F.lit("]]\n```")))
        .when(n == 2, F.col("o1"))
        .when(n == 3, F.concat(F.lit("broken {"), "text"))
        .otherwise(F.concat(F.lit("```JSON ["), "o2", F.lit(","), "o1", F.lit("] ``` ```x```")))
    )
    return docs.select("doc_id", "text", "lang", "source", "n_chars", reply.alias("reply"))


_REPLIES = """
objs as (select *, '{"index":' || doc_id % 50 || ',"title":"' || lang || '"}' as o1, '{"index":' || n_chars % 50 || ',"title":"' || source || '"}' as o2 from documents),
replies as (select *, case doc_id % 5 when 0 then 'note' || chr(10) || '```json' || chr(10) || '[' || o1 || ',' || o2 || ']' || chr(10) || '```' || chr(10) || text
  when 1 then '```' || chr(10) || '[[1],[' || o1 || ',' || o2 || ']]' || chr(10) || '```' when 2 then o1 when 3 then 'broken {' || text else '```JSON [' || o2 || ',' || o1 || '] ``` ```x```' end as reply from objs),
bodies as (select *, case when regexp_matches(reply, '(?is)```(?:json)?\\s*(.*?)\\s*```') then regexp_extract(reply, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1)
   else regexp_replace(regexp_replace(reply, '^[\\s\\pZ]+', ''), '[\\s\\pZ]+$', '') end as body from replies)
""".replace("\\\\", "\\")


@query("p01_fenced_json", with_ctes(_REPLIES, "select doc_id, body from bodies"))
def fenced(spark, sf):
    return replies(spark, sf).select("doc_id", A.fenced_json(F.col("reply")).alias("body"))


@query(
    "p02_json_object",
    with_ctes(_REPLIES, """
select doc_id, case when not json_valid(body) then '{}' when json_type(body) = 'OBJECT' then body
  when json_type(body->'$[#-1]') = 'OBJECT' then (body->'$[#-1]')::varchar else '{}' end as object from bodies"""),
)
def objects(spark, sf):
    return replies(spark, sf).select("doc_id", A.json_object(F.col("reply")).alias("object"))


_LISTS = """
lists as (select doc_id, case when not json_valid(body) then null when json_type(body) <> 'ARRAY' then null when json_type(body->'$[0]') = 'OBJECT' then body::json
   when json_type(body->'$[0]') = 'ARRAY' then body->'$[1]' end as l from bodies),
items as (select doc_id, i as pos, l->(i::int) as item from lists, unnest(range(0, json_array_length(l)::int)) as u(i))
"""


@query("p03_json_object_list", with_ctes(_REPLIES, _LISTS, "select doc_id, pos, item::varchar as item from items"))
def object_lists(spark, sf):
    return replies(spark, sf).select("doc_id", F.posexplode(A.json_object_list(F.col("reply"))).alias("pos", "item"))


@query(
    "p04_confidence_object",
    """select doc_id, case doc_id % 4 when 0 then m when 1 then m when 2 then '{"plain":1}' else '{}' end as scores
from (select doc_id, '{"发票":{"score":' || n_chars % 11 || ',"reasoning":"' || lang || '"}}' as m from documents)""",
)
def confidence(spark, sf):
    docs = load(spark, sf, "documents")
    m = F.concat(F.lit('{"发票":{"score":'), _s(F.col("n_chars") % 11), F.lit(',"reasoning":"'), "lang", F.lit('"}}'))
    n = F.col("doc_id") % 4
    reply = (
        F.when(n == 0, F.concat(F.lit('```json\n["text",{"a":{"b":1}},'), m, F.lit(',{"x":"score"}]\n```')))
        .when(n == 1, F.concat(F.lit('[[{"old":{"score":1}},'), m, F.lit("],[3]]")))
        .when(n == 2, F.lit('{"plain":1}'))
        .otherwise(F.col("text"))
    )
    return docs.select("doc_id", A.confidence_object(reply).alias("scores"))


@query(
    "p05_int_indexes",
    with_ctes(_REPLIES, _LISTS, "select doc_id, coalesce(string_agg(item->>'$.index', ',' order by pos), '') as indexes from replies left join items using (doc_id) group by doc_id"),
)
def indexes(spark, sf):
    found = replies(spark, sf).select("doc_id", A.int_indexes(F.col("reply")).alias("i"))
    return found.select("doc_id", F.coalesce(F.array_join(F.col("i").cast("array<string>"), ","), F.lit("")).alias("indexes"))


@query("p06_outer_slice", with_ctes(_REPLIES, r"""
select doc_id, regexp_extract(reply, '(?s)\{.*\}') as braces, regexp_extract(reply, '(?s)\[.*\]') as brackets from replies"""))
def slices(spark, sf):
    return replies(spark, sf).select(
        "doc_id", A.outer_slice(F.col("reply")).alias("braces"), A.outer_slice(F.col("reply"), "[", "]").alias("brackets")
    )


_PAIRS = """
pairs as (select doc_id, '(1) 【 治疗类型：住院、' || lang || ' 】且【费用类型: ' || source || '】 （2）没有 (3)【治疗类型：急诊】【治疗类型：' || lang || '】' as t from documents)
"""


def _pairs(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit("(1) 【 治疗类型：住院、"), "lang", F.lit(" 】且【费用类型: "), "source", F.lit("】 （2）没有 (3)【治疗类型：急诊】【治疗类型："), "lang", F.lit("】")
        ).alias("t"),
    )


@query(
    "p07_numbered_bracket_pairs",
    """select doc_id, unnest([0, 1]) as pos, unnest(['治疗类型=住院、' || lang || ';费用类型=' || source, '治疗类型=' || lang]) as pairs from documents""",
)
def numbered(spark, sf):
    found = _pairs(spark, sf).select("doc_id", F.posexplode(A.numbered_bracket_pairs(F.col("t"))).alias("pos", "m"))
    flat = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("doc_id", "pos", F.array_join(flat, ";").alias("pairs"))


@query(
    "p08_bracket_values",
    with_ctes(_PAIRS, """
vals as (select doc_id, unnest(string_split(array_to_string(regexp_extract_all(t, '【治疗类型：([^】]+)】', 1), '、'), '、')) as v from pairs)""", """
select doc_id, string_agg(distinct v, '、' order by v) as treatment, '未指定' as costs from vals group by doc_id"""),
)
def bracketed(spark, sf):
    # Blanks inside the brackets belong to the value, so the fixture's are removed on both sides.
    bare = _pairs(spark, sf).withColumn("t", F.col("t"))
    return bare.select(
        "doc_id", A.bracket_values(F.col("t"), "治疗类型").alias("treatment"), A.bracket_values(F.col("t"), "费用类型").alias("costs")
    )


@query(
    "p09_normalize_keywords",
    r"""select doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(replace(replace('[''' || lang || ''', "' || source || '"，' || text || '，x、y]', '''', ''), '"', ''), '^[\[\](){}]+|[\[\](){}]+$', '', 'g'), '[，,、\s]+'), lambda k: k <> ''), '|') as keywords from documents""",
)
def keywords(spark, sf):
    listed = F.concat(F.lit("['"), "lang", F.lit("', \""), "source", F.lit('"，'), "text", F.lit("，x、y]"))
    return load(spark, sf, "documents").select("doc_id", F.array_join(A.normalize_keywords(listed), "|").alias("keywords"))


@query(
    "p10_dedup_objects",
    """select doc_id, case when lang = source then '{"a":"' || lang || '"}' else '{"a":"' || lang || '","b":"' || source || '"}' end || ';{"a":"' || n_chars || '"}' as objects from documents""",
)
def deduped(spark, sf):
    ab = F.create_map(F.lit("a"), "lang", F.lit("b"), "source")
    ba = F.create_map(F.lit("b"), "source", F.lit("a"), "lang")
    only = F.create_map(F.lit("a"), _s("n_chars"))
    kept = A.dedup_objects(F.array(ab, only, ba, only))
    return load(spark, sf, "documents").select("doc_id", F.array_join(F.transform(kept, sorted_json), ";").alias("objects"))


@query(
    "p11_split_triple",
    """select doc_id, case when doc_id % 3 = 0 then lang || '_' || source else lang end as plan, case when doc_id % 3 = 0 then lang || '_' || source else source end as clause,
  case when doc_id % 3 = 0 then lang || '_' || source else doc_id || '_' || text end as liability from documents""",
)
def triples(spark, sf):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("_", "lang", "source")).otherwise(F.concat_ws("_", "lang", "source", _s("doc_id"), "text"))
    return load(spark, sf, "documents").select("doc_id", A.split_triple(name).alias("t")).select("doc_id", "t.*")


_FACTORS = """
freplies as (select doc_id, lang, source, n_chars, case doc_id % 4 when 0 then '[{"因子值":"' || n_chars || '","费用范围":"' || lang || '","额外描述":["d"]},{"因子值":"2"},7]'
   when 1 then '```json' || chr(10) || '{"因子值":' || n_chars || ',"费用范围":"' || source || '"}' || chr(10) || '```' when 2 then '[]' else text end as reply from documents)
"""


def factor_replies(spark, sf):
    n = F.col("doc_id") % 4
    reply = (
        F.when(n == 0, F.concat(F.lit('[{"因子值":"'), _s("n_chars"), F.lit('","费用范围":"'), "lang", F.lit('","额外描述":["d"]},{"因子值":"2"},7]')))
        .when(n == 1, F.concat(F.lit('```json\n{"因子值":'), _s("n_chars"), F.lit(',"费用范围":"'), "source", F.lit('"}\n```')))
        .when(n == 2, "[]")
        .otherwise(F.col("text"))
    )
    return load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", reply.alias("reply"))


@query(
    "p12_factor_answers",
    with_ctes(_FACTORS, """
select doc_id, 0 as pos, n_chars::varchar as value, lang as fee_range, '["d"]' as notes, 'update' as action from freplies where doc_id % 4 = 0 union all
select doc_id, 1, '2', '', '[]', 'add' from freplies where doc_id % 4 = 0 union all select doc_id, 0, n_chars::varchar, source, '[]', 'update' from freplies where doc_id % 4 = 1"""),
)
def factor_rows(spark, sf):
    return O.factor_rows(factor_replies(spark, sf), "doc_id", "reply")


@query(
    "p13_answer_cache",
    """with asked as (select doc_id, sha256(lang || '|||' || source || '|||' || text) as cache_key from documents),
responses as (select k as cache_key, min(quality::varchar) as reply from labels join (select doc_id, cache_key as k from asked) using (doc_id) group by k)
select doc_id, cache_key, coalesce(reply, 'open') as reply from asked left join responses using (cache_key)""",
)
def answer_cache(spark, sf):
    asked = load(spark, sf, "documents").select("doc_id", A.answer_cache_key(F.col("lang"), F.col("source"), F.col("text")).alias("cache_key"))
    responses = load(spark, sf, "labels").join(asked, "doc_id").select("cache_key", _s("quality").alias("reply"))
    answered, todo = O.reuse_answers(asked, responses)
    return answered.select("doc_id", "cache_key", "reply").unionByName(todo.select("doc_id", "cache_key", F.lit("open").alias("reply")))


@query(
    "p14_validate_confidence",
    """with c as (select doc_id, ['医院范围', '发票', '既往症', '等待期', '其他'][(doc_id % 5 + 1)::int] as field, ['HOSP', 'INV', 'PAST', 'WAIT', 'X'][(doc_id % 5 + 1)::int] as pre, n_chars % 12 as score,
   case doc_id % 3 when 0 then '_POS_01' when 1 then '_NEG_02' else '' end as suffix, doc_id from documents),
r as (select *, case when doc_id % 3 = 2 then case when doc_id % 2 = 0 then '无' else 'R_GEN_01' end else pre || suffix end as rule from c)
select doc_id, field, score, case when score > 10 then 'score out of range' when field = '其他' then 'unknown field' when score = 10 and suffix <> '_POS_01' then 'full score without a positive rule'
  when score = 0 and suffix <> '_NEG_02' and rule <> 'R_GEN_01' then 'zero score without a negative rule' when score between 1 and 9 and rule <> '无' then 'middle score with a rule' end as violation from r""",
)
def confidence_rules(spark, sf):
    at = (F.col("doc_id") % 5 + 1).cast("int")
    field = F.element_at(F.array(*[F.lit(x) for x in ("医院范围", "发票", "既往症", "等待期", "其他")]), at)
    pre = F.element_at(F.array(*[F.lit(x) for x in ("HOSP", "INV", "PAST", "WAIT", "X")]), at)
    rule = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(pre, F.lit("_POS_01")))
        .when(F.col("doc_id") % 3 == 1, F.concat(pre, F.lit("_NEG_02")))
        .when(F.col("doc_id") % 2 == 0, "无")
        .otherwise("R_GEN_01")
    )
    rows = load(spark, sf, "documents").select("doc_id", field.alias("field"), (F.col("n_chars") % 12).alias("score"), rule.alias("rule"))
    return rows.select("doc_id", "field", "score", A.confidence_violation(F.col("field"), F.col("score"), F.col("rule")).alias("violation"))


@query(
    "p15_schema_guard",
    """select doc_id, unnest(['1', '2']) as id, unnest(['1', '2']) as def_direction, unnest(['1', '2']) as def_level, unnest(['1', '0.5']) as confidence,
  unnest([null, source]) as hospital_names, unnest([lang, null]) as hospital_param from documents""",
)
def guarded(spark, sf):
    def scope(direction, level, confidence):
        return F.struct(
            F.lit("9").alias("id"), F.lit(direction).cast("string").alias("def_direction"), F.lit(level).cast("string").alias("def_level"),
            F.lit(confidence).cast("string").alias("confidence"), F.col("source").alias("hospital_names"), F.col("lang").alias("hospital_param"),
        )

    scopes = F.array(scope(None, None, None), scope("2", "2", "0.5"))
    return load(spark, sf, "documents").select("doc_id", F.inline(A.guard_scopes(scopes)))
