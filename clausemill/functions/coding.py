"""Free text to codes and rules. Dictionaries are literals, so nothing is joined or shuffled."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from clausemill.functions import dims as D
from clausemill.functions.binding import let
from clausemill.functions.coding_base import first_match, look_up, matches
from clausemill.functions.text import strip

_SEPARATORS = r"[、。，；;,\s]+"
_BRACES = r"[｛{]指定医院(除外|包含)[：:]\s*([^}｝]+)[｝}]"
_SCOPE = (
    "struct<id:string,def_direction:string,def_level:string,hospital_names:string,levels:string,"
    "grades:string,natures:string,org_types:string,nssf:string,confidence:string>"
)
_RULE = "struct<id:string,rule_type:string,params:string,confidence:string>"


def _has(text: Column, *words: str) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def claim_nature(text: Column) -> Column:
    accident, illness = _has(text, "意外"), _has(text, "疾病")
    return F.when(accident & ~illness, "1").when(illness & ~accident, "2").otherwise("1,2")


def medical_type(text: Column) -> Column:
    """Codes of all treatment names in the text, in dictionary order; inpatient care adds the ICU code."""
    names = [(name.lower(), code) for code, name in D.MEDICAL_TYPES.items()] + [("icu", "ICUWard")]
    inpatient = F.when(_has(text, "住院"), F.array(F.lit("ICUWard"))).otherwise(F.expr("cast(array() as array<string>)"))
    codes = F.array_distinct(F.concat(matches(F.lower(text), names), inpatient))
    return F.when(_blank(text) | (F.size(codes) == 0), D.DEFAULT_MEDICAL_TYPES).otherwise(F.array_join(codes, ","))


def fee_category(text: Column) -> Column:
    codes = F.array_join(matches(text, [(name, code) for code, name in D.FEE_CATEGORIES.items()]), ",")
    every = ",".join(sorted(D.FEE_CATEGORIES))
    return F.when(_blank(text) | (text == "所有"), every).when(codes == "", "other").otherwise(codes)


def first_match_code(text: Column, names: dict[str, str] | None = None, default: str = D.DEFAULT_EXCLUSION) -> Column:
    """Code of the first dictionary name that occurs in the text."""
    table = names if names is not None else D.EXCLUSION_TYPES
    return F.coalesce(first_match(text, [(name, code) for code, name in table.items()]), F.lit(default))


def hospital_level(text: Column) -> Column:
    one, two, three = _has(text, "一级"), _has(text, "二级"), _has(text, "三级")
    return (
        F.when(one, "1,2,3").when(two & (three | _has(text, "以上")), "2,3").when(two, "2").when(three, "3")
    )


def hospital_attrs(text: Column) -> Column:
    """``(levels, grades, natures, org_types, nssf)``; absent attributes are null, grades have a default."""

    def by_name(table: dict[str, str]) -> Column:
        return first_match(text, [(name, code) for code, name in table.items()])

    return F.struct(
        hospital_level(text).alias("levels"),
        F.coalesce(by_name(D.HOSPITAL_GRADES), F.lit(D.DEFAULT_GRADES)).alias("grades"),
        F.coalesce(by_name(D.HOSPITAL_NATURES), F.when(_has(text, "私立"), "02")).alias("natures"),
        F.coalesce(first_match(text, D.ORG_SYNONYMS.items()), by_name(D.HOSPITAL_ORG_TYPES)).alias("org_types"),
        F.when(_has(text, "非医保定点"), "N").when(_has(text, "医保定点"), "Y").alias("nssf"),
    )


def brace_specs(text: Column) -> Column:
    """Array of ``(direction, hospitals)`` from braces that name hospitals."""
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(_BRACES), F.lit(1)),
        F.regexp_extract_all(text, F.lit(_BRACES), F.lit(2)),
        lambda d, h: F.struct(d.alias("direction"), strip(h).alias("hospitals")),
    )


def normalize_names(text: Column) -> Column:
    return F.array_join(F.filter(F.split(strip(text), _SEPARATORS, -1), lambda p: p != ""), ",")


def _scope(direction: Column, level: str, names: Column, attrs: Column | None, confidence: Column) -> Column:
    none = F.lit(None).cast("string")
    fields = {f: (attrs[f] if attrs is not None else none) for f in ("levels", "grades", "natures", "org_types", "nssf")}
    return F.struct(
        none.alias("id"),
        direction.alias("def_direction"),
        F.lit(level).alias("def_level"),
        names.alias("hospital_names"),
        *[fields[f].alias(f) for f in fields],
        confidence.alias("confidence"),
    ).cast(_SCOPE)


def _numbered(scopes: Column, start: int = 1) -> Column:
    return F.transform(scopes, lambda s, i: s.withField("id", (i + start).cast("string")))


def hospital_scopes(text: Column, confidence: Column | None = None, start: int = 1) -> Column:
    """Scopes of a hospital text: one per comma part by attributes, then one per brace by names.

    An empty text, or one without any part, gets the default scope with confidence 0.
    """
    sure = confidence if confidence is not None else F.lit("1")
    none = F.lit(None).cast("string")
    base = F.regexp_replace(strip(F.regexp_replace(text, _BRACES, "")), rf"{_SEPARATORS}$", "")
    parts = F.filter(F.transform(F.split(base, "[,，、]", -1), strip), lambda p: p != "")
    by_attribute = F.transform(
        parts,
        lambda p: _scope(
            F.when(_has(p, "除外") & ~_has(p, "指定医院除外"), "2").otherwise("1"), "1", none, hospital_attrs(p), sure
        ),
    )
    by_name = F.transform(
        brace_specs(text),
        lambda s: _scope(F.when(s["direction"] == "除外", "2").otherwise("1"), "2", normalize_names(s["hospitals"]), None, sure),
    )
    default = F.array(
        F.struct(
            none.alias("id"), F.lit("1").alias("def_direction"), F.lit("1").alias("def_level"), none.alias("hospital_names"),
            F.lit("2,3").alias("levels"), none.alias("grades"), F.lit("04").alias("natures"), none.alias("org_types"),
            none.alias("nssf"), F.lit("0").alias("confidence"),
        ).cast(_SCOPE)
    )
    found = let(F.concat(by_attribute, by_name), lambda s: F.when(F.size(s) > 0, s).otherwise(default))
    return _numbered(F.when(_blank(text), default).otherwise(found), start)


def scope_or_fallback(model_scopes: Column, text: Column, confidence: Column) -> Column:
    """Scopes a model gave, the first one completed by defaults, else those read from the text."""

    def complete(s: Column, i: Column) -> Column:
        has_attrs = s["def_level"] != "2"

        def default(field: str, value: str) -> Column:
            return F.when((i == 0) & has_attrs & _blank(strip(s[field])), value).otherwise(s[field])

        return (
            s.withField("id", (i + 1).cast("string"))
            .withField("levels", default("levels", "2,3"))
            .withField("grades", default("grades", D.DEFAULT_GRADES))
            .withField("confidence", confidence)
        )

    given = F.coalesce(F.size(model_scopes), F.lit(0)) > 0
    return F.when(given & ~_blank(strip(text)), F.transform(model_scopes, complete)).otherwise(
        hospital_scopes(text, confidence)
    )


def drop_special_care(codes: Column, scopes: Column) -> Column:
    """Without the special-care codes where a named exclusion mentions special care."""
    excluded = F.exists(
        scopes, lambda s: (s["def_direction"] == "2") & (s["def_level"] == "2") & _has(F.coalesce(s["hospital_names"], F.lit("")), "特需")
    )
    kept = F.array_join(
        F.array_except(F.split(codes, ",", -1), F.array(*[F.lit(c) for c in D.SPECIAL_CARE_TYPES])), ","
    )
    return F.when(excluded, F.when(kept == "", D.DEFAULT_MEDICAL_TYPES).otherwise(kept)).otherwise(codes)


def _rule(rule: Column, params: Column, confidence: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("id"), rule.alias("rule_type"), params.alias("params"), confidence.alias("confidence")).cast(_RULE)


def _no_rules() -> Column:
    return F.expr(f"cast(array() as array<{_RULE}>)")


def invoice_rules(text: Column, confidence: Column, start: int = 1) -> Column:
    found = F.filter(
        F.array(*[F.when(_has(text, word), _rule(F.lit(rule), F.lit('{"P1":"Y"}'), confidence)) for word, rule in D.INVOICE_RULES]),
        lambda r: r.isNotNull(),
    )
    return F.when(_blank(strip(text)), _no_rules()).otherwise(_numbered(found, start))


def scene_labels(text: Column, subject: str) -> Column:
    """All labels of two characters or more after the first keyword of a subject that has any."""

    def after(keyword: str) -> Column:
        at = F.instr(text, F.lit(keyword))
        rest = strip(F.substr(text, at + len(keyword)))
        labels = F.filter(F.split(rest, r"[、。，；;,\s]+", -1), lambda p: F.length(p) >= 2)
        return F.when(at > 0, F.nullif(F.array_join(labels, ","), F.lit("")))

    return F.coalesce(*[after(word + subject) for word in ("除外", "包含", "除以下", "不承担下列")])


def scene_params(text: Column, rule: str, kind: str) -> Column:
    """Parameters of a scene rule as JSON text."""
    if kind == "yes":
        return F.lit('{"P1":"Y"}')
    if kind == "none":
        return F.lit("{}")
    return F.to_json(
        F.struct(F.lit("Y" if kind == "include" else "N").alias("P1"), scene_labels(text, D.SCENE_SUBJECTS[rule]).alias("P2"))
    )


def scene_rules(text: Column, start: int = 1, strict: bool = False) -> Column:
    """Rules of all keyword groups the text mentions, then the custom rule that holds the text.

    Matching is by substring, so "non-X" also fires the rule of "X" and a keyword
    with pattern signs is literal. ``strict=True`` does not count a keyword right after 非.
    """
    bare = strip(text)

    def mentioned(words: Sequence[str]) -> Column:
        if not strict:
            return _has(bare, *words)
        found = F.lit(False)
        for word in words:
            found = found | bare.rlike("(?<!非)" + re.escape(word))
        return found

    sure = F.lit("1")
    listed = F.array(
        *[F.when(mentioned(words), _rule(F.lit(rule), scene_params(bare, rule, kind), sure)) for words, rule, kind in D.SCENE_RULES]
    )
    found = _numbered(F.filter(listed, lambda r: r.isNotNull()), start)
    custom = _rule(F.lit(D.SCENE_CUSTOM), F.to_json(F.struct(F.concat(F.lit("#"), bare, F.lit("#")).alias("P1"))), sure)
    whole = F.concat(found, F.array(custom.withField("id", F.lit(str(start)))))
    return F.when(_blank(bare), F.lit(None).cast(f"array<{_RULE}>")).otherwise(whole)


def days(text: Column) -> Column:
    """First digits before a day sign; null without any (number words are not read)."""
    return F.regexp_extract(text, r"(\d+)\s*[天日]", 1).try_cast("int")


def waiting_rules(text: Column, confidence: Column, start: int = 1) -> Column:
    """An illness and an accident rule with the days; 0 where denied, the raw text where no days are given."""
    denied = _has(text, "无", "没有") & _has(text, "等待期")
    value = F.when(denied, "0").otherwise(F.coalesce(days(text).cast("string"), text))

    def rule(cause: str) -> Column:
        return _rule(F.lit("E3_001"), F.to_json(F.struct(F.lit(cause).alias("P1"), value.alias("P2"))), confidence)

    return F.when(_blank(text), _no_rules()).otherwise(_numbered(F.array(rule("1"), rule("2")), start))


def preexisting_rules(text: Column, severe: Column, confidence: Column, start: int = 1) -> Column:
    plain = {flag: _rule(F.lit("E3_003"), F.lit(f'{{"P1":"{flag}"}}'), confidence) for flag in "YN"}
    special = _rule(
        F.lit("E3_004"), F.to_json(F.struct(F.lit("N").alias("P1"), F.coalesce(severe, F.lit("严重既往症")).alias("P2"))), confidence
    )
    rules = (
        F.when(_has(text, "不承担严重既往症"), F.array(special, plain["Y"]))
        .when(_has(text, "不承担"), F.array(plain["N"]))
        .when(_has(text, "承担"), F.array(plain["Y"]))
        .otherwise(_no_rules())
    )
    return _numbered(rules, start)


def field_confidence(score: Column, scenarios: Column, scenario: Column) -> Column:
    """Score of 10 as text of 0..1: ``1`` if nothing was scored, ``0`` for a scenario that was not."""
    share = (score / 10).cast("string")
    return (
        F.when(score.isNull(), "1")
        .when(scenarios.isNull(), share)
        .when(F.coalesce(F.array_contains(scenarios, scenario), F.lit(False)), share)
        .otherwise("0")
    )


def invoice_scenarios(invoices: Column) -> Column:
    """Indexes of the scenarios with an invoice text; all of them if none has one."""
    indexes = F.transform(invoices, lambda _x, i: i)
    named = F.filter(indexes, lambda i: ~_blank(strip(F.coalesce(F.element_at(invoices, i + 1), F.lit("")))))
    return F.when(F.size(named) > 0, named).otherwise(indexes)


def code_to_text(field: str, code: Column) -> Column:
    table = D.CODE_TABLES.get(field)
    return look_up(table, code) if table else code


def rank_name(name: Column) -> Column:
    """Sort key: specific before general before the rest."""
    return F.when(_has(name, "特定"), 0).when(_has(name, "一般"), 1).otherwise(2)


def fill_unspecified(value: Column, found: Column, unset: str = "未指定") -> Column:
    return F.when(_blank(value) | (value == unset), found).otherwise(value)


def sensitive_terms(text: Column) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in D.SENSITIVE_TAGS]), lambda t: F.contains(text, t))
