"""Registered queries for dictionary coding. Each document gets phrases of every field by its number."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import coding as C, dims as D
from clausemill.functions.answers import bracket_values
from clausemill.plans.registry import query
from clausemill.session import load

PHRASES = {
    "accident": ["意外伤害", "疾病住院", "意外或疾病", "", "其他情形"],
    "treatment": ["住院治疗", "普通门诊、急诊", "ICU病房", "特需病房，特需门诊", "", "体检", "国际部住院及家庭病床", "特需病房"],
    "hospital": [
        "二级及以上公立医院", "非医保定点，公立医院", "三级甲等医院除外", "", "一级以上门诊部｛指定医院除外：协和特需部、同仁医院｝",
        "{指定医院包含: 人民医院，中心医院}", "私立医院、卫生所", "二级,三级乙等,医保定点", "   ",
    ],
    "fee": ["所有", "床位费、护理费", "", "美容费", "重症监护室床位费和其他费用"],
    "invoice": ["统筹支付且自费", "社保账单", "", "无要求", " 自费 "],
    "scene": [
        "非重大疾病住院", "除外疾病：先天畸形、遗传性疾病，癌。", "", "包含药品 阿司匹林;青霉素", "24小时内住院且ICU", "非恶性肿瘤 180天内",
        "一般情形", "第.*年出险", "不承担下列手术：整形手术", "非医保身份投保",
    ],
    "waiting": ["30天", "无等待期", "三十日", "", "90 日内没有等待期限制", "等待期为60天"],
    "preexisting": ["不承担严重既往症", "不承担既往症", "承担既往症", "", "未提及"],
    "liability": ["特定疾病津贴", "一般住院津贴", "生育津贴", "自费药品", "生育与自费", "体检费用艾滋病"],
    "exclusion": ["药品类免责", "手术及材料", "其他", "诊疗项目"],
}


def pick(name):
    phrases = PHRASES[name]
    return F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.col("doc_id") % len(phrases) + 1).cast("int"))


def sql_pick(name):
    phrases = PHRASES[name]
    return f"({phrases!r})[(doc_id % {len(phrases)} + 1)::int]"


def texts(spark, sf, *names):
    return load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source", *[pick(n).alias(n) for n in names])


def sql_texts(*names):
    return "t as (select doc_id, n_chars, lang, source, " + ", ".join(f"{sql_pick(n)} as {n}" for n in names) + " from documents)"


def sql_pairs(entries):
    return "[" + ", ".join(f"{{'k': '{k}', 'v': '{v}'}}" for k, v in entries) + "]"


def sql_matches(text, entries):
    return f"list_transform(list_filter({sql_pairs(entries)}, lambda kv: contains({text}, kv.k)), lambda kv: kv.v)"


def flip(table):
    return [(name, code) for code, name in table.items()]


@query("c01_claim_nature", f"with {sql_texts('accident')} select doc_id, case when contains(accident, '意外') and not contains(accident, '疾病') then '1' when contains(accident, '疾病') and not contains(accident, '意外') then '2' else '1,2' end as nature from t")
def nature(spark, sf):
    return texts(spark, sf, "accident").select("doc_id", C.claim_nature(F.col("accident")).alias("nature"))


_MEDICAL = [(n.lower(), c) for n, c in flip(D.MEDICAL_TYPES)] + [("icu", "ICUWard")]
_MEDICAL_SQL = f"""codes as (select doc_id, coalesce(nullif(array_to_string(l, ','), ''), 'hospital,generalOutpatient') as codes from
 (select doc_id, list_concat(m, case when contains(treatment, '住院') and not list_contains(m, 'ICUWard') then ['ICUWard'] else [] end) as l from
 (select doc_id, treatment, case when list_count(list_filter(m0, lambda x: x = 'ICUWard')) > 1 then list_filter(m0, lambda x, i: x <> 'ICUWard' or i = list_position(m0, 'ICUWard')) else m0 end as m from
 (select doc_id, treatment, {sql_matches("lower(treatment)", _MEDICAL)} as m0 from t))))"""


@query("c02_medical_type", f"with {sql_texts('treatment')}, {_MEDICAL_SQL} select doc_id, codes from codes")
def medical(spark, sf):
    return texts(spark, sf, "treatment").select("doc_id", C.medical_type(F.col("treatment")).alias("codes"))


@query(
    "c03_fee_category",
    f"with {sql_texts('fee')} select doc_id, case when fee in ('', '所有') then '{','.join(sorted(D.FEE_CATEGORIES))}' else coalesce(nullif(array_to_string({sql_matches('fee', flip(D.FEE_CATEGORIES))}, ','), ''), 'other') end as codes from t",
)
def fees(spark, sf):
    return texts(spark, sf, "fee").select("doc_id", C.fee_category(F.col("fee")).alias("codes"))


_FIRST = f"coalesce(({sql_matches('exclusion', flip(D.EXCLUSION_TYPES))})[1], '01')"


@query("c04_first_match_code", f"with {sql_texts('exclusion')} select doc_id, {_FIRST} as code from t")
def exclusion_code(spark, sf):
    return texts(spark, sf, "exclusion").select("doc_id", C.first_match_code(F.col("exclusion")).alias("code"))


def _level_sql(x):
    return f"case when contains({x}, '一级') then '1,2,3' when contains({x}, '二级') and (contains({x}, '三级') or contains({x}, '以上')) then '2,3' when contains({x}, '二级') then '2' when contains({x}, '三级') then '3' end"


def _attrs_sql(x):
    return {
        "levels": _level_sql(x),
        "grades": f"coalesce(({sql_matches(x, flip(D.HOSPITAL_GRADES))})[1], '0,1,2,3,4')",
        "natures": f"coalesce(({sql_matches(x, flip(D.HOSPITAL_NATURES))})[1], case when contains({x}, '私立') then '02' end)",
        "org_types": f"coalesce(({sql_matches(x, list(D.ORG_SYNONYMS.items()))})[1], ({sql_matches(x, flip(D.HOSPITAL_ORG_TYPES))})[1])",
        "nssf": f"case when contains({x}, '非医保定点') then 'N' when contains({x}, '医保定点') then 'Y' end",
    }


@query("c05_hospital_level", f"with {sql_texts('hospital')} select doc_id, {_level_sql('hospital')} as levels from t")
def level(spark, sf):
    return texts(spark, sf, "hospital").select("doc_id", C.hospital_level(F.col("hospital")).alias("levels"))


@query(
    "c06_hospital_attrs",
    f"with {sql_texts('hospital')} select doc_id, " + ", ".join(f"{e} as {n}" for n, e in _attrs_sql("hospital").items()) + " from t",
)
def attrs(spark, sf):
    return texts(spark, sf, "hospital").select("doc_id", C.hospital_attrs(F.col("hospital")).alias("a")).select("doc_id", "a.*")


_BR = "[｛{]指定医院(除外|包含)[：:]\\s*([^}｝]+)[｝}]"
_BRACE_SQL = f"""b as (select doc_id, unnest(regexp_extract_all(hospital, '{_BR}', 1)) as direction, unnest(regexp_extract_all(hospital, '{_BR}', 2)) as hospitals,
  unnest(range(1, len(regexp_extract_all(hospital, '{_BR}', 1)) + 1)) as pos from t)"""


@query("c07_brace_specs", f"with {sql_texts('hospital')}, {_BRACE_SQL} select doc_id, direction, trim(hospitals) as hospitals from b")
def braces(spark, sf):
    return texts(spark, sf, "hospital").select("doc_id", F.inline(C.brace_specs(F.col("hospital"))))


_NAMES = "array_to_string(list_filter(regexp_split_to_array({}, '[、。，；;,\\s]+'), lambda p: p <> ''), ',')"


@query("c08_normalize_names", f"select doc_id, {_NAMES.format('trim(lang) || chr(12289) || text')} as names from documents")
def names(spark, sf):
    docs = load(spark, sf, "documents")
    return docs.select("doc_id", C.normalize_names(F.concat("lang", F.lit("、"), "text")).alias("names"))


_COLS = "def_direction, def_level, hospital_names, levels, grades, natures, org_types, nssf, confidence"
_P = _attrs_sql("p")
_SCOPES_SQL = f"""{_BRACE_SQL},
base as (select doc_id, regexp_replace(trim(regexp_replace(hospital, '{_BR}', '', 'g')), '[、。，；;,\\s]+$', '') as s from t),
parts as (select doc_id, unnest(regexp_split_to_array(s, '[,，、]')) as p0, unnest(range(1, len(regexp_split_to_array(s, '[,，、]')) + 1)) as pos from base),
found as (select doc_id, 0 as grp, pos, case when contains(p, '除外') and not contains(p, '指定医院除外') then '2' else '1' end as def_direction, '1' as def_level, null as hospital_names,
   {', '.join(f'{e} as {n}' for n, e in _P.items())}, '1' as confidence from (select *, trim(p0) as p from parts) where p <> ''
  union all select doc_id, 1, pos, case when direction = '除外' then '2' else '1' end, '2', {_NAMES.format('trim(hospitals)')}, null, null, null, null, null, '1' from b),
scopes as (select doc_id, row_number() over (partition by doc_id order by grp, pos)::varchar as id, {_COLS} from found union all
  select doc_id, '1', '1', '1', null, '2,3', null, '04', null, null, '0' from t where doc_id not in (select doc_id from found))"""


@query("c09_hospital_scopes", f"with {sql_texts('hospital')}, {_SCOPES_SQL} select doc_id, id, {_COLS} from scopes")
def scopes(spark, sf):
    return texts(spark, sf, "hospital").select("doc_id", F.inline(C.hospital_scopes(F.col("hospital"))))


@query(
    "c10_scope_or_fallback",
    f"""with {sql_texts('hospital')}, {_SCOPES_SQL}, given as (select doc_id, lang from t where doc_id % 4 = 0 and trim(hospital) <> '')
select doc_id, id, {_COLS.replace('confidence', "case when confidence = '0' then '0' else '0.5' end as confidence")} from scopes where doc_id not in (select doc_id from given) union all
select doc_id, '1', '2', '1', null, '2,3', lang, null, null, null, '0.5' from given union all select doc_id, '2', '1', '1', null, null, null, null, null, null, '0.5' from given""",
)
def model_scopes(spark, sf):
    none = F.lit(None).cast("string")

    def scope(direction, grades):
        return F.struct(
            F.lit("x").alias("id"), F.lit(direction).alias("def_direction"), F.lit("1").alias("def_level"), none.alias("hospital_names"), none.alias("levels"),
            grades.alias("grades"), none.alias("natures"), none.alias("org_types"), none.alias("nssf"), F.lit("1").alias("confidence"),
        )

    given = F.when(F.col("doc_id") % 4 == 0, F.array(scope("2", F.col("lang")), scope("1", none)))
    found = C.scope_or_fallback(given, F.col("hospital"), F.lit("0.5"))
    return texts(spark, sf, "hospital").select("doc_id", F.inline(found))


@query(
    "c11_drop_special_care",
    f"""with {sql_texts('hospital', 'treatment')}, {_SCOPES_SQL}, {_MEDICAL_SQL},
bad as (select distinct doc_id from scopes where def_direction = '2' and def_level = '2' and contains(hospital_names, '特需'))
select doc_id, case when doc_id in (select doc_id from bad) then coalesce(nullif(array_to_string(list_filter(string_split(codes, ','), lambda c: c not in ('specialDemandWard', 'specialPatient')), ','), ''), 'hospital,generalOutpatient') else codes end as codes from codes""",
)
def special_care(spark, sf):
    return texts(spark, sf, "hospital", "treatment").select(
        "doc_id", C.drop_special_care(C.medical_type(F.col("treatment")), C.hospital_scopes(F.col("hospital"))).alias("codes")
    )


@query(
    "c12_invoice_rules",
    f"""with {sql_texts('invoice')}, r as (select doc_id, unnest({sql_matches('invoice', D.INVOICE_RULES)}) as rule_type, unnest(range(1, 9)) as n from t)
select doc_id, n::varchar as id, rule_type, '{{"P1":"Y"}}' as params, '0.7' as confidence from r where rule_type is not null""",
)
def invoices(spark, sf):
    return texts(spark, sf, "invoice").select("doc_id", F.inline(C.invoice_rules(F.col("invoice"), F.lit("0.7"))))


def _labels_sql(subject):
    tries = [
        f"case when contains(scene, '{w}{subject}') then nullif(array_to_string(list_filter(regexp_split_to_array(trim(scene[instr(scene, '{w}{subject}') + {len(w + subject)}:]), '[、。，；;,\\s]+'), lambda p: length(p) >= 2), ','), '') end"
        for w in ("除外", "包含", "除以下", "不承担下列")
    ]
    return f"coalesce({', '.join(tries)})"


def _scene_sql(strict=False):
    arms = []
    for pos, (words, rule, kind) in enumerate(D.SCENE_RULES):
        said = (lambda w: f"regexp_matches(scene, '(^|[^非])' || regexp_escape('{w}'))") if strict else (lambda w: f"contains(scene, '{w}')")
        cond = " or ".join(said(w) for w in words)
        if kind == "yes":
            params = "'{\"P1\":\"Y\"}'"
        elif kind == "none":
            params = "'{}'"
        else:
            flag = "Y" if kind == "include" else "N"
            params = f"'{{\"P1\":\"{flag}\"' || coalesce(',\"P2\":\"' || {_labels_sql(D.SCENE_SUBJECTS[rule])} || '\"', '') || '}}'"
        arms.append(f"select doc_id, {pos} as pos, '{rule}' as rule_type, {params} as params from t where scene <> '' and ({cond})")
    return (
        f"with {sql_texts('scene')}, m as (" + " union all ".join(arms) + ") "
        "select doc_id, row_number() over (partition by doc_id order by pos)::varchar as id, rule_type, params, '1' as confidence from m union all "
        "select doc_id, '1', 'E1_999', '{\"P1\":\"#' || scene || '#\"}', '1' from t where scene <> ''"
    )


@query("c13_scene_rules", _scene_sql())
def scenes(spark, sf):
    return texts(spark, sf, "scene").select("doc_id", F.inline(C.scene_rules(F.col("scene"))))


@query("c13_scene_rules_strict", _scene_sql(strict=True))
def scenes_strict(spark, sf):
    return texts(spark, sf, "scene").select("doc_id", F.inline(C.scene_rules(F.col("scene"), strict=True)))


@query("c14_scene_params", f"with {sql_texts('scene')} select doc_id, {_labels_sql('疾病')} as illness, {_labels_sql('药品')} as drugs, {_labels_sql('手术')} as surgery from t")
def scene_params(spark, sf):
    return texts(spark, sf, "scene").select(
        "doc_id", *[C.scene_labels(F.col("scene"), s).alias(a) for s, a in (("疾病", "illness"), ("药品", "drugs"), ("手术", "surgery"))]
    )


_DAYS = "try_cast(nullif(regexp_extract(waiting, '(\\d+)\\s*[天日]', 1), '') as int)"


@query("c15_days", f"with {sql_texts('waiting')} select doc_id, {_DAYS} as days from t")
def day_counts(spark, sf):
    return texts(spark, sf, "waiting").select("doc_id", C.days(F.col("waiting")).alias("days"))


@query(
    "c16_waiting_rules",
    f"""with {sql_texts('waiting')} select doc_id, c as id, 'E3_001' as rule_type, '{{"P1":"' || c || '","P2":"' || case when (contains(waiting, '无') or contains(waiting, '没有')) and contains(waiting, '等待期') then '0' else coalesce({_DAYS}::varchar, waiting) end || '"}}' as params, '1' as confidence
from t, unnest(['1', '2']) as u(c) where waiting <> ''""",
)
def waiting(spark, sf):
    return texts(spark, sf, "waiting").select("doc_id", F.inline(C.waiting_rules(F.col("waiting"), F.lit("1"))))


@query(
    "c17_preexisting_rules",
    f"""with {sql_texts('preexisting')} select doc_id, '1' as id, 'E3_004' as rule_type, '{{"P1":"N","P2":"' || case when doc_id % 2 = 0 then lang else '严重既往症' end || '"}}' as params, '1' as confidence from t where contains(preexisting, '不承担严重既往症')
union all select doc_id, '2', 'E3_003', '{{"P1":"Y"}}', '1' from t where contains(preexisting, '不承担严重既往症')
union all select doc_id, '1', 'E3_003', case when contains(preexisting, '不承担') then '{{"P1":"N"}}' else '{{"P1":"Y"}}' end, '1' from t where contains(preexisting, '承担') and not contains(preexisting, '不承担严重既往症')""",
)
def preexisting(spark, sf):
    severe = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return texts(spark, sf, "preexisting").select("doc_id", F.inline(C.preexisting_rules(F.col("preexisting"), severe, F.lit("1"))))


@query("c18_exclusion_rows", f"with {sql_texts('exclusion')} select doc_id, unnest([1, 2]) as id, unnest([{_FIRST}, '01']) as code, unnest([exclusion, source]) as info from t")
def exclusions(spark, sf):
    listed = F.array(F.col("exclusion"), F.col("source"))
    rows = texts(spark, sf, "exclusion").select("doc_id", F.posexplode(listed).alias("pos", "info"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("id"), C.first_match_code(F.col("info")).alias("code"), "info")


@query(
    "c19_field_confidence",
    """select doc_id, s as scenario, case when n_chars % 12 = 11 then '1' when doc_id % 3 = 0 or s in (0, 2) then ((n_chars % 12) / 10.0)::double::varchar else '0' end as confidence from documents, unnest([0, 1, 2]) as u(s)""",
)
def confidences(spark, sf):
    docs = load(spark, sf, "documents").withColumn("scenario", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    score = F.when(F.col("n_chars") % 12 != 11, F.col("n_chars") % 12)
    covered = F.when(F.col("doc_id") % 3 != 0, F.array(F.lit(0), F.lit(2)))
    return docs.select("doc_id", "scenario", C.field_confidence(score, covered, F.col("scenario")).alias("confidence"))


@query(
    "c20_invoice_scenarios",
    f"with {sql_texts('invoice')} select doc_id, case when trim(invoice) <> '' and doc_id % 2 = 0 then '0,2' when trim(invoice) <> '' then '0' when doc_id % 2 = 0 then '2' else '0,1,2' end as scenarios from t",
)
def scenarios(spark, sf):
    listed = F.array(F.col("invoice"), F.lit(" "), F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return texts(spark, sf, "invoice").select("doc_id", F.array_join(C.invoice_scenarios(listed).cast("array<string>"), ",").alias("scenarios"))


@query(
    "c21_code_to_text",
    """select doc_id, case code when '01' then '合资' when '02' then '民营' when '03' then '外资' when '04' then '公立' else code end as nature, code as unknown
from (select doc_id, ['01', '02', '03', '04', '05'][(doc_id % 5 + 1)::int] as code from documents)""",
)
def code_texts(spark, sf):
    code = F.element_at(F.array(*[F.lit(c) for c in ("01", "02", "03", "04", "05")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return load(spark, sf, "documents").select("doc_id", C.code_to_text("hospitalNatures", code).alias("nature"), C.code_to_text("noSuchField", code).alias("unknown"))


@query("c22_rank_names", f"with {sql_texts('liability')} select doc_id, case when contains(liability, '特定') then 0 when contains(liability, '一般') then 1 else 2 end as name_rank from t")
def ranks(spark, sf):
    return texts(spark, sf, "liability").select("doc_id", C.rank_name(F.col("liability")).alias("name_rank"))


@query(
    "c23_fill_pay_scope",
    """select doc_id, case when doc_id % 3 = 2 then lang else source || '、急诊' end as treatment, case when doc_id % 3 = 2 then lang else '未指定' end as costs from documents""",
)
def filled(spark, sf):
    scope = F.concat(F.lit("【治疗类型：急诊、"), "source", F.lit("】"))
    value = F.when(F.col("doc_id") % 3 == 2, F.col("lang")).when(F.col("doc_id") % 3 == 1, "未指定")
    return load(spark, sf, "documents").select(
        "doc_id", C.fill_unspecified(value, bracket_values(scope, "治疗类型")).alias("treatment"), C.fill_unspecified(value, bracket_values(scope, "费用类型")).alias("costs")
    )


@query("c24_flag_sensitive", f"with {sql_texts('liability')} select doc_id, array_to_string(list_filter({list(D.SENSITIVE_TAGS)!r}, lambda s: contains(liability, s)), '|') as terms from t")
def sensitive(spark, sf):
    return texts(spark, sf, "liability").select("doc_id", F.array_join(C.sensitive_terms(F.col("liability")), "|").alias("terms"))
