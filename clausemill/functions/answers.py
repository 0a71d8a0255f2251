"""Semi-structured replies as columns. Text that is no valid JSON gives nulls, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clausemill.functions.binding import let
from clausemill.functions.text import sorted_json, strip

_STRINGS = "cast(array() as array<string>)"
UNSPECIFIED = "未指定"
# Which rule prefixes a field's confidence may cite.
FIELD_RULES = {"医院范围": "HOSP", "发票": "INV", "既往症": "PAST", "等待期": "WAIT"}
GENERAL_RULE, NO_RULE = "R_GEN_01", "无"


def fenced_json(reply: Column) -> Column:
    """Body of the first fenced block, else the whole reply."""
    fence = r"(?is)```(?:json)?\s*(.*?)\s*```"
    return F.when(reply.rlike(fence), strip(F.regexp_extract(reply, fence, 1))).otherwise(strip(reply))


def is_json(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()


def _is_object(text: Column) -> Column:
    return text.startswith("{") & is_json(text)


def _is_list(text: Column) -> Column:
    return text.startswith("[") & is_json(text)


def elements(body: Column) -> Column:
    """Elements of a JSON list as JSON texts; null for anything else."""
    return F.when(_is_list(body), F.from_json(body, "array<string>"))


def json_object(reply: Column) -> Column:
    """The reply's object, or the last element of its list if that is one, else ``{}``."""

    def pick(body: Column) -> Column:
        last = F.try_element_at(elements(body), F.lit(-1))
        return F.when(_is_object(body), body).when(_is_object(last), last).otherwise("{}")

    return let(fenced_json(reply), pick)


def json_object_list(reply: Column) -> Column:
    """The reply's list of objects; in nested lists the first sub-list of objects, else the last one."""
    empty = F.expr(_STRINGS)

    def pick(found: Column) -> Column:
        first = F.try_element_at(found, F.lit(1))
        sublists = F.transform(found, elements)
        with_objects = F.filter(sublists, lambda s: _is_object(F.try_element_at(s, F.lit(1))))
        nested = F.coalesce(
            F.try_element_at(with_objects, F.lit(1)), F.try_element_at(sublists, F.lit(-1)), empty
        )
        return F.when(_is_object(first), found).when(_is_list(first), nested).otherwise(empty)

    return F.coalesce(let(elements(fenced_json(reply)), pick), empty)


def _is_score_map(text: Column) -> Column:
    def scored(value: Column) -> Column:
        keys = F.map_keys(F.from_json(value, "map<string,string>"))
        return F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ("score", "reasoning", "matched_rule")])), F.lit(False))

    values = F.map_values(F.from_json(text, "map<string,string>"))
    return _is_object(text) & F.coalesce(F.exists(values, lambda v: _is_object(v) & scored(v)), F.lit(False))


def confidence_object(reply: Column) -> Column:
    """The reply's object, or the last score map among its elements and sub-elements, else ``{}``."""

    def last_match(found: Column) -> Column:
        flat = F.flatten(
            F.transform(found, lambda e: F.when(_is_list(e), elements(e)).otherwise(F.array(e)))
        )
        return F.try_element_at(F.filter(flat, _is_score_map), F.lit(-1))

    def pick(body: Column) -> Column:
        return F.when(_is_object(body), body).otherwise(F.coalesce(let(elements(body), last_match), F.lit("{}")))

    return let(fenced_json(reply), pick)


def int_indexes(reply: Column) -> Column:
    """Integer ``index`` fields of the reply's objects; order and duplicates kept, numbers in quotes left out."""
    values = F.transform(
        json_object_list(reply),
        lambda e: F.when(
            _is_object(e) & ~e.rlike(r'"index"\s*:\s*"') & F.get_json_object(e, "$.index").rlike(r"^-?\d+$"),
            F.get_json_object(e, "$.index").try_cast("int"),
        ),
    )
    return F.filter(values, lambda v: v.isNotNull())


def outer_slice(text: Column, opening: str = "{", closing: str = "}") -> Column:
    """From the first opening mark to the last closing one."""
    return F.regexp_extract(text, rf"(?s)\{opening}.*\{closing}", 0)


def numbered_bracket_pairs(text: Column) -> Column:
    """``(n)`` blocks as maps of their ``【key：value】`` pairs; blocks without pairs are dropped."""
    number = r"[(（]\d+[)）]"
    blocks = F.filter(
        F.regexp_extract_all(text, F.lit(rf"(?s){number}(.*?)(?=\s*{number}|\z)"), F.lit(1)), lambda b: b.isNotNull()
    )
    pair = r"【\s*([^:：]+?)\s*[:：]\s*([^】]*?)\s*】"

    def to_map(block: Column) -> Column:
        found = F.arrays_zip(
            F.regexp_extract_all(block, F.lit(pair), F.lit(1)).alias("k"),
            F.regexp_extract_all(block, F.lit(pair), F.lit(2)).alias("v"),
        )
        # The last value of a repeated key counts.
        return F.aggregate(
            found,
            F.expr("cast(map() as map<string,string>)"),
            lambda acc, p: F.map_concat(
                F.map_filter(acc, lambda k, _v: k != p["k"]), F.create_map(p["k"], p["v"])
            ),
        )

    return F.filter(F.transform(blocks, to_map), lambda m: F.size(m) > 0)


def bracket_values(text: Column, key: str, default: str = UNSPECIFIED) -> Column:
    """All values of ``【key：..】``, split at ``、``, distinct and sorted; a default where there are none."""
    found = F.regexp_extract_all(text, F.lit(f"【{key}：([^】]+)】"), F.lit(1))
    joined = F.array_join(F.array_sort(F.array_distinct(F.split(F.array_join(found, "、"), "、", -1))), "、")
    return F.when(F.size(found) > 0, joined).otherwise(default)


def normalize_keywords(text: Column) -> Column:
    """Keywords of a list written as text."""
    bare = F.translate(F.regexp_replace(strip(text), r"^[\[\](){}]+|[\[\](){}]+$", ""), "'\"", "")
    return F.filter(F.split(bare, r"[，,、\s]+", -1), lambda k: k != "")


def normalize_keyword_list(keywords: Column) -> Column:
    return F.filter(F.transform(keywords, strip), lambda k: k != "")


def dedup_objects(objects: Column) -> Column:
    """Distinct string maps in order of first appearance; key order does not matter."""
    keyed = F.transform(objects, sorted_json)
    return let(
        keyed,
        lambda ks: F.filter(objects, lambda _o, i: F.array_position(ks, F.element_at(ks, i + 1)) == i + 1),
    )


def split_triple(text: Column) -> Column:
    """``plan_clause_liability`` in three; the third keeps later separators, a shorter text stands for all three."""
    return let(
        F.split(text, "_", 3),
        lambda p: F.when(F.size(p) < 3, F.struct(text.alias("plan"), text.alias("clause"), text.alias("liability"))).otherwise(
            F.struct(p[0].alias("plan"), p[1].alias("clause"), p[2].alias("liability"))
        ),
    )


def factor_answers(reply: Column) -> Column:
    """Array of ``(value, fee_range, notes)`` from a list of objects or one object."""

    def row(e: Column) -> Column:
        return F.struct(
            F.coalesce(F.get_json_object(e, "$.因子值"), F.lit("")).alias("value"),
            F.coalesce(F.get_json_object(e, "$.费用范围"), F.lit("")).alias("fee_range"),
            F.coalesce(F.get_json_object(e, "$.额外描述"), F.lit("[]")).alias("notes"),
        )

    def rows(body: Column) -> Column:
        found = F.when(_is_object(body), F.array(body)).otherwise(F.coalesce(elements(body), F.expr(_STRINGS)))
        return F.transform(F.filter(found, _is_object), row)

    return let(fenced_json(reply), rows)


def answer_cache_key(kind: Column, leaf: Column, context: Column) -> Column:
    return F.sha2(F.concat_ws("|||", kind, leaf, context), 256)


def confidence_violation(field: Column, score: Column, rule: Column) -> Column:
    """Why a score and the rule it cites do not fit; null where they do."""
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for kv in FIELD_RULES.items() for x in kv]), field)
    cited = F.coalesce(rule, F.lit(""))
    return (
        F.when(score.isNull() | (score < 0) | (score > 10), "score out of range")
        .when(prefix.isNull(), "unknown field")
        .when((score == 10) & ~cited.startswith(F.concat(prefix, F.lit("_POS_"))), "full score without a positive rule")
        .when(
            (score == 0) & ~cited.startswith(F.concat(prefix, F.lit("_NEG_"))) & (cited != GENERAL_RULE),
            "zero score without a negative rule",
        )
        .when(score.between(1, 9) & (cited != NO_RULE), "middle score with a rule")
    )


def guard_scopes(scopes: Column) -> Column:
    """Renumber scopes from 1, fill defaults, drop the field that contradicts the level."""

    def guard(s: Column, i: Column) -> Column:
        level = F.coalesce(s["def_level"], F.lit("1"))
        return F.struct(
            (i + 1).cast("string").alias("id"),
            F.coalesce(s["def_direction"], F.lit("1")).alias("def_direction"),
            level.alias("def_level"),
            F.coalesce(s["confidence"], F.lit("1")).alias("confidence"),
            F.when(level != "1", s["hospital_names"]).alias("hospital_names"),
            F.when(level != "2", s["hospital_param"]).alias("hospital_param"),
        )

    return F.transform(scopes, guard)
