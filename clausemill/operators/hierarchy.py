"""Plan > clause > liability hierarchies: flatten, attach results, nest again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clausemill.functions import dims as D
from clausemill.functions.ordered import ordered_list
from clausemill.functions.text import sorted_json, strip
from clausemill.sources.stores import latest_containing

NAME_RULES = (("生育", "E1_002", '{"P1":"1","P2":"女性生育"}'), ("自费", "E1_999", "自费"))
NO_SCOPE = "拆解值为空，未能从文档中提取到赔付范围"


def _name(col: Column) -> Column:
    return strip(F.coalesce(col, F.lit("")))


def flatten(requests: DataFrame, key: str, plans: str = "plans") -> DataFrame:
    """One row per code triple with its name triple; of equal triples the last one counts.

    ``plans`` holds ``(plan_code, plan_name, clause_code, clause_name, liabilities)``,
    ``liabilities`` holds ``(liab_code, liab_name)``. Plans without liabilities keep a row.
    """
    rows = (
        requests.select(key, F.posexplode_outer(plans).alias("plan_pos", "p"))
        .select(key, "plan_pos", "p", F.posexplode_outer("p.liabilities").alias("liab_pos", "l"))
        .select(
            key,
            F.coalesce("p.plan_code", F.lit("")).alias("plan_code"),
            F.coalesce("p.clause_code", F.lit("")).alias("clause_code"),
            F.coalesce("l.liab_code", F.lit("")).alias("liab_code"),
            F.struct(F.coalesce("plan_pos", F.lit(-1)).alias("p"), F.coalesce("liab_pos", F.lit(-1)).alias("l")).alias("pos"),
            F.concat_ws("_", _name(F.col("p.plan_name")), _name(F.col("p.clause_name")), _name(F.col("l.liab_name"))).alias("name"),
        )
    )
    return rows.groupBy(key, "plan_code", "clause_code", "liab_code").agg(
        F.max_by("name", "pos").alias("name"), F.max("pos").alias("_pos")
    ).select(key, "plan_code", "clause_code", "liab_code", "name", F.col("_pos.p").alias("plan_pos"), F.col("_pos.l").alias("liab_pos"))


def attach_results(items: DataFrame, results: DataFrame, keys: list[str], scopes: str) -> DataFrame:
    """All items with their result; an item without one, or whose work failed, has an empty list."""
    element = dict(results.dtypes)[scopes]
    return items.join(results, keys, "left").withColumn(
        scopes, F.coalesce(scopes, F.expr(f"cast(array() as {element})"))
    )


def missing_results(items: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(results, keys, "left_anti")


def nest(rows: DataFrame, key: str) -> DataFrame:
    """Requests rebuilt from flat rows ``(plan.., clause.., liab.., plan_pos, liab_pos)`` in request order."""
    plan = [key, "plan_pos", "plan_code", "plan_name", "clause_code", "clause_name"]
    plans = rows.groupBy(*plan).agg(
        ordered_list([F.col("liab_pos")], F.struct("liab_code", "liab_name")).alias("liabilities")
    )
    return plans.groupBy(key).agg(
        ordered_list(
            [F.col("plan_pos")], F.struct("plan_code", "plan_name", "clause_code", "clause_name", "liabilities")
        ).alias("plans")
    )


def apply_shared_rules(scopes: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Every scope of a liability gets that liability's pay-parameter rules."""
    return scopes.join(rules, keys, "left")


def name_rules(name: Column, scene_rules: Column) -> Column:
    """Scene rules of all scopes plus the rules a liability's name asks for.

    ``scene_rules`` is an array, one entry per scope, of arrays of ``(id, rule_type,
    params)``. New ids follow the longest list of the liability.
    """
    rule_type = "array<struct<id:string,rule_type:string,params:string>>"
    longest = F.coalesce(F.array_max(F.transform(scene_rules, lambda r: F.coalesce(F.size(r), F.lit(0)))), F.lit(0))
    extra = F.filter(
        F.array(
            *[
                F.when(F.contains(name, F.lit(word)), F.struct(F.lit(rule).alias("rule_type"), F.lit(params).alias("params")))
                for word, rule, params in NAME_RULES
            ]
        ),
        lambda r: r.isNotNull(),
    )
    numbered = F.transform(
        extra, lambda r, i: F.struct((longest + i + 1).cast("string").alias("id"), r["rule_type"].alias("rule_type"), r["params"].alias("params"))
    )
    return F.transform(scene_rules, lambda rules: F.concat(F.coalesce(rules, F.expr(f"cast(array() as {rule_type})")), numbered))


def first_non_empty(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """The first non-empty value per group; groups without any are absent."""
    return rows.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*group).agg(F.min_by(value, order).alias(value))


def structure_table(plans: Column) -> Column:
    """Markdown table of a request's plans, a row per plan."""

    def cell(value: Column) -> Column:
        return F.coalesce(F.nullif(value, F.lit("")), F.lit("-"))

    def line(p: Column) -> Column:
        names = F.filter(F.transform(p["liabilities"], lambda l: F.coalesce(l["liab_name"], F.lit(""))), lambda n: n != "")
        bar = F.lit(" | ")
        return F.concat(
            F.lit("| "), cell(p["plan_name"]), bar, cell(p["clause_name"]), bar, cell(F.array_join(names, "<br>")), F.lit(" |")
        )

    head = F.array(F.lit("| 计划 | 条款 | 责任 |"), F.lit("|---|---|---|"))
    table = F.array_join(F.concat(head, F.transform(plans, line)), "\n")
    return F.when(F.coalesce(F.size(plans), F.lit(0)) == 0, "无计划数据").otherwise(table)


def tags_by_type(responses: DataFrame, key: str, items: str = "items") -> DataFrame:
    """``(key, tag_type, tags)`` from nested ``items array<(tags array<(type, name)>)>``; nulls left out."""
    flat = (
        responses.select(key, F.posexplode(items).alias("i", "item"))
        .select(key, "i", F.posexplode("item.tags").alias("j", "tag"))
        .filter(F.col("tag.type").isNotNull() & F.col("tag.name").isNotNull())
    )
    return flat.groupBy(key, F.col("tag.type").alias("tag_type")).agg(
        ordered_list([F.col("i"), F.col("j")], F.col("tag.name")).alias("tags")
    )


def known_tags(tags: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Asked names that are known, distinct and comma-joined; every category has a row, even an empty one."""
    kept = tags.join(asked, [key, "category", "name"], "left_semi")
    joined = kept.groupBy(key, "category").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    every = tags.select(key).distinct().withColumn(
        "category", F.explode(F.array(*[F.lit(c) for c in D.TAG_CATEGORIES]))
    )
    return every.join(joined, [key, "category"], "left").withColumn("names", F.coalesce("names", F.lit("")))


def std_tags(std_name: Column, item_name: Column, tags: Column) -> Column:
    """``(std_name, tag_names, tag_codes)``; the item's own name stands in for a missing standard one."""
    return F.struct(
        F.coalesce(F.nullif(std_name, F.lit("")), item_name).alias("std_name"),
        F.transform(tags, lambda t: t["name"]).alias("tag_names"),
        F.transform(tags, lambda t: t["code"]).alias("tag_codes"),
    )


def scope_text(scopes: Column) -> Column:
    """Numbered text of the distinct scopes, given as string maps, with their fields in fixed order.

    Of equal scopes the first keeps its place. A scope without a fee says ``所有``.
    """
    keys = F.transform(scopes, sorted_json)
    distinct = F.filter(scopes, lambda _s, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)

    def field(s: Column, name: str) -> Column:
        value = F.nullif(F.try_element_at(s, F.lit(name)), F.lit(""))
        value = F.coalesce(value, F.lit("所有")) if name == "费用类型" else value
        return F.when(value.isNotNull(), F.concat(F.lit(f"【{name}："), value, F.lit("】")))

    lines = F.transform(
        distinct,
        lambda s, i: F.concat(
            F.lit("("), (i + 1).cast("string"), F.lit(")"), F.array_join(F.array(*[field(s, n) for n in D.SCOPE_FIELDS]), " 且 ")
        ),
    )
    text = F.array_join(F.concat(F.array(F.lit("满足以下任一情形可以赔付：")), lines), "\n")
    return F.when(F.coalesce(F.size(scopes), F.lit(0)) == 0, NO_SCOPE).otherwise(text)


def param_text(waiting: Column, preexisting: Column, severe: Column) -> Column:
    """Waiting-period and pre-existing texts joined; empty parts are skipped."""
    wait = F.when(F.coalesce(waiting, F.lit("")) != "", F.concat(F.lit("新保等待期"), waiting))
    past = F.concat_ws(
        "，",
        F.nullif(preexisting, F.lit("")),
        F.when(F.coalesce(severe, F.lit("")) != "", F.concat(F.lit("不承担以下严重既往症："), severe)),
    )
    return F.concat_ws("；", wait, F.nullif(past, F.lit("")))


def reuse_previous(requests: DataFrame, stored: DataFrame, needle: str, overwrite: dict[str, str], schema: str) -> DataFrame:
    """The latest stored result that contains a request's needle, two of its fields replaced from the request.

    ``overwrite`` maps field names of the stored JSON (of ``schema``) to request columns.
    """
    found = latest_containing(stored, requests, needle).withColumn("result", F.from_json("body", schema))
    joined = requests.join(found, needle)
    result = F.col("result")
    for field, column in overwrite.items():
        result = result.withField(field, F.col(column))
    return joined.withColumn("result", result).drop("body")


def distinct_keep_order(keys: Column) -> Column:
    return F.array_distinct(keys)

