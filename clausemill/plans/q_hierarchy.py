"""Registered queries for hierarchies. A request is an order, its plans are return flags, its liabilities are lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import dims as D
from clausemill.operators import hierarchy as H
from clausemill.plans.fixtures import with_ctes
from clausemill.plans.q_coding import pick, sql_pick
from clausemill.plans.registry import query
from clausemill.session import load

_ROWS = """
hrows as (select o, plan_code, plan_name, clause_code, clause_name, dense_rank() over (partition by o order by plan_code, clause_code) - 1 as plan_pos,
   row_number() over (partition by o, plan_code, clause_code order by l_partkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) - 1 as liab_pos, liab_code, liab_name
  from (select *, l_orderkey as o, l_returnflag as plan_code, 'plan ' || l_returnflag as plan_name, l_linestatus as clause_code, case when l_orderkey % 5 = 0 then null else 'c' || l_linestatus end as clause_name,
     (l_partkey % 7)::varchar as liab_code, ' L' || l_linenumber || ' ' as liab_name from lineitem))
"""


def rows(spark, sf):
    from pyspark.sql import Window

    base = load(spark, sf, "lineitem").select(
        "*", F.col("l_orderkey").alias("o"), F.col("l_returnflag").alias("plan_code"), F.concat(F.lit("plan "), "l_returnflag").alias("plan_name"),
        F.col("l_linestatus").alias("clause_code"), F.when(F.col("l_orderkey") % 5 != 0, F.concat(F.lit("c"), "l_linestatus")).alias("clause_name"),
        (F.col("l_partkey") % 7).cast("string").alias("liab_code"), F.concat(F.lit(" L"), F.col("l_linenumber").cast("string"), F.lit(" ")).alias("liab_name"),
    )
    plan = Window.partitionBy("o").orderBy("plan_code", "clause_code")
    liab = Window.partitionBy("o", "plan_code", "clause_code").orderBy("l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    return base.select(
        "o", "plan_code", "plan_name", "clause_code", "clause_name", (F.dense_rank().over(plan) - 1).alias("plan_pos"),
        (F.row_number().over(liab) - 1).alias("liab_pos"), "liab_code", "liab_name",
    )


def requests(spark, sf):
    return H.nest(rows(spark, sf), "o")


_FLAT = """
flat as (select o, plan_code, clause_code, liab_code, arg_max(trim(plan_name) || '_' || coalesce(clause_name, '') || '_' || trim(liab_name), liab_pos) as name, max(plan_pos) as plan_pos, max(liab_pos) as liab_pos from hrows group by o, plan_code, clause_code, liab_code)
"""


@query("h01_flatten", with_ctes(_ROWS, _FLAT, "select o, plan_code, clause_code, liab_code, name, plan_pos, liab_pos from flat"))
def flatten(spark, sf):
    return H.flatten(requests(spark, sf), "o")


_TOTALS = """
customers as (select r_name as plan, n_name as clause, c_custkey, c_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey),
items as (select plan, clause, c_custkey from customers union all select r_name, n_name, -s_suppkey from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey),
results as (select o_custkey as c_custkey, 1 as done, case when count(*) filter (where o_orderstatus = 'P') > 0 then string_agg(distinct o_orderpriority, ',' order by o_orderpriority) end as scopes from orders group by o_custkey)
"""


def customers(spark, sf):
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    return (
        load(spark, sf, "customer")
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(F.col("r_name").alias("plan"), F.col("n_name").alias("clause"), "c_custkey", "c_name", "c_nationkey")
    )


@query(
    "h02_attach_results",
    with_ctes(_TOTALS, "select plan, clause, c_custkey, coalesce(scopes, '') as scopes, case when done is null then 1 else 0 end as missing from items left join results using (c_custkey)"),
)
def attach(spark, sf):
    # Work on a customer without a pending order has failed: its result has no scopes. For suppliers no work was done.
    pending = F.max(F.col("o_orderstatus") == "P")
    results = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.when(pending, F.sort_array(F.collect_set("o_orderpriority"))).alias("scopes")
    )
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    suppliers = (
        load(spark, sf, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(F.col("r_name").alias("plan"), F.col("n_name").alias("clause"), (-F.col("s_suppkey")).alias("c_custkey"))
    )
    items = customers(spark, sf).select("plan", "clause", "c_custkey").unionByName(suppliers)
    attached = H.attach_results(items, results, ["c_custkey"], "scopes")
    absent = H.missing_results(items, results, ["c_custkey"]).select("c_custkey", F.lit(1).alias("missing"))
    return attached.join(absent, "c_custkey", "left").select(
        "plan", "clause", "c_custkey", F.array_join("scopes", ",").alias("scopes"), F.coalesce("missing", F.lit(0)).alias("missing")
    )


@query(
    "h03_nest",
    with_ctes(_ROWS, """
p as (select o, plan_pos, '{"plan_code":"' || plan_code || '","plan_name":"' || plan_name || '","clause_code":"' || clause_code || '"' || coalesce(',"clause_name":"' || clause_name || '"', '') || ',"liabilities":[' ||
  string_agg('{"liab_code":"' || liab_code || '","liab_name":"' || liab_name || '"}', ',' order by liab_pos) || ']}' as j from hrows group by o, plan_pos, plan_code, plan_name, clause_code, clause_name)""", """
select o, '[' || string_agg(j, ',' order by plan_pos) || ']' as plans from p group by o"""),
)
def nest(spark, sf):
    return requests(spark, sf).select("o", F.to_json("plans").alias("plans"))


@query(
    "h04_apply_shared_rules",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 'rule ' || o_orderpriority as rules from lineitem left join orders on o_orderkey = l_orderkey",
)
def shared(spark, sf):
    scopes = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rules = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("rule "), "o_orderpriority").alias("rules"))
    return H.apply_shared_rules(scopes, rules, ["l_orderkey"])


@query(
    "h05_name_rules",
    f"""with t as (select doc_id, {sql_pick('liability')} as name, n_chars % 3 as n from documents),
e as (select doc_id, name, n, list_concat(case when contains(name, '生育') then ['E1_002:{{"P1":"1","P2":"女性生育"}}'] else [] end, case when contains(name, '自费') then ['E1_999:自费'] else [] end) as ex from t)
select doc_id, array_to_string(list_concat(list_transform(range(1, n + 1), lambda i: i || ':base:{{}}'), list_transform(ex, lambda x, i: (n + i) || ':' || x)), ';') as first_scope,
  array_to_string(list_transform(ex, lambda x, i: (n + i) || ':' || x), ';') as second_scope from e""",
)
def name_rules(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", pick("liability").alias("name"), (F.col("n_chars") % 3).cast("int").alias("n"))
    kind = "array<struct<id:string,rule_type:string,params:string>>"
    base = F.when(
        F.col("n") > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest("n", F.lit(1))),
            lambda i: F.struct(i.cast("string").alias("id"), F.lit("base").alias("rule_type"), F.lit("{}").alias("params")),
        ),
    ).cast(kind)
    found = H.name_rules(F.col("name"), F.array(base, F.lit(None).cast(kind)))

    def flat(rules):
        return F.array_join(F.transform(rules, lambda r: F.concat_ws(":", r["id"], r["rule_type"], r["params"])), ";")

    return docs.select("doc_id", flat(found[0]).alias("first_scope"), flat(found[1]).alias("second_scope"))


@query(
    "h06_first_non_empty",
    "select o_custkey, arg_min(o_orderpriority, o_orderkey) as notice from orders where o_orderstatus <> 'O' group by o_custkey",
)
def first_notice(spark, sf):
    notices = load(spark, sf, "orders").withColumn("notice", F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).otherwise(""))
    return H.first_non_empty(notices, ["o_custkey"], "notice", "o_orderkey")


_TABLE = r"""
p as (select o, plan_pos, plan_name, coalesce(clause_name, '-') as clause, string_agg(liab_name, '<br>' order by liab_pos) as resp from hrows group by all)
"""


@query(
    "h07_structure_table",
    with_ctes(_ROWS, _TABLE, f"""
select o, '| 计划 | 条款 | 责任 |' || chr(10) || '|---|---|---|' || chr(10) ||
  string_agg('| ' || plan_name || ' | ' || clause || ' | ' || resp || ' |', chr(10) order by plan_pos) as md
from p group by o"""),
)
def structure(spark, sf):
    return requests(spark, sf).select("o", H.structure_table(F.col("plans")).alias("md"))


_TAGS = """
tags as (select l_orderkey as o, l_linenumber, l_suppkey, l_extendedprice, l_partkey, ['药品非责标签', '诊疗非责标签', '材料非责标签', '诊断非责标签', '手术非责标签'][(l_partkey % 5 + 1)::int] as category, p_name as name, p_size from lineitem join part on p_partkey = l_partkey)
"""


def tags(spark, sf):
    category = F.element_at(F.array(*[F.lit(c) for c in D.TAG_CATEGORIES]), (F.col("l_partkey") % 5 + 1).cast("int"))
    part = load(spark, sf, "part")
    return load(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("o"), "l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey", category.alias("category"), F.col("p_name").alias("name"), "p_size"
    )


@query(
    "h08_tags_by_type",
    with_ctes(_TAGS, "select o, category as tag_type, string_agg(name, '|' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as tags from tags where p_size % 4 <> 0 group by o, category"),
)
def typed_tags(spark, sf):
    from clausemill.functions.ordered import ordered_list

    tag = F.struct(F.col("category").alias("type"), F.when(F.col("p_size") % 4 != 0, F.col("name")).alias("name"))
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    responses = tags(spark, sf).groupBy("o").agg(ordered_list(order, F.struct(F.array(tag).alias("tags"))).alias("items"))
    return H.tags_by_type(responses, "o").select("o", "tag_type", F.array_join("tags", "|").alias("tags"))


@query(
    "h09_known_tags",
    with_ctes(_TAGS, """
kept as (select o, category, string_agg(distinct name, ',' order by name) as names from tags where (o, category, name) in (select (o, category, name) from tags where p_size % 3 = 0) group by o, category)""", """
select e.o, e.category, coalesce(names, '') as names from (select distinct o, c as category from tags, unnest(['药品非责标签', '诊疗非责标签', '材料非责标签', '诊断非责标签', '手术非责标签']) as u(c)) e left join kept k on k.o = e.o and k.category = e.category"""),
)
def known(spark, sf):
    rows_ = tags(spark, sf)
    return H.known_tags(rows_, rows_.filter("p_size % 3 = 0").select("o", "category", "name"), "o")


@query(
    "h10_std_tags",
    "select p_partkey, case when p_size % 2 = 0 then p_type else p_name end as std_name, p_brand || ',x' as tag_names, p_size || ',' || p_partkey as tag_codes from part",
)
def standard(spark, sf):
    tag_list = F.array(
        F.struct(F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("code")), F.struct(F.lit("x").alias("name"), F.col("p_partkey").cast("string").alias("code"))
    )
    found = H.std_tags(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""), F.col("p_name"), tag_list)
    return load(spark, sf, "part").select("p_partkey", found.alias("t")).select(
        "p_partkey", "t.std_name", F.array_join("t.tag_names", ",").alias("tag_names"), F.array_join("t.tag_codes", ",").alias("tag_codes")
    )


@query(
    "h11_scope_text",
    f"""with t as (select doc_id, lang, {sql_pick('accident')} as a, {sql_pick('fee')} as f from documents)
select doc_id, '满足以下任一情形可以赔付：' || chr(10) || '(1)' || case when a <> '' then '【事故类型：' || a || '】 且 ' else '' end || '【费用类型：' || case when f = '' then '所有' else f end || '】' || chr(10) || '(2)【费用类型：所有】 且 【场景：' || lang || '】' as scope from t""",
)
def scope_texts(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "lang", pick("accident").alias("a"), pick("fee").alias("f"))
    first = F.create_map(F.lit("费用类型"), F.col("f"), F.lit("事故类型"), F.col("a"))
    again = F.create_map(F.lit("事故类型"), F.col("a"), F.lit("费用类型"), F.col("f"))
    second = F.create_map(F.lit("场景"), F.col("lang"))
    return docs.select("doc_id", H.scope_text(F.array(first, second, again)).alias("scope"))


@query(
    "h12_param_text",
    f"""with t as (select doc_id, lang, {sql_pick('waiting')} as w, {sql_pick('preexisting')} as p from documents)
select doc_id, concat_ws('；', case when w <> '' then '新保等待期' || w end, nullif(concat_ws('，', nullif(p, ''), case when doc_id % 2 = 0 then '不承担以下严重既往症：' || lang end), '')) as params from t""",
)
def param_texts(spark, sf):
    severe = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return load(spark, sf, "documents").select("doc_id", H.param_text(pick("waiting"), pick("preexisting"), severe).alias("params"))


@query(
    "h13_reuse_previous",
    """with s as (select o_custkey, max(o_orderkey) as id, arg_max(o_orderstatus, o_orderkey) as st from orders group by o_custkey)
select c_custkey, id, '{"plan":"p' || o_custkey || '","status":"' || st || '","scopes":["' || c_mktsegment || '"],"notices":["' || c_name || '"]}' as result from customer join s on o_custkey = c_custkey""",
)
def previous(spark, sf):
    stored = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.to_json(
            F.struct(
                F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("plan"), F.col("o_orderstatus").alias("status"),
                F.array(F.lit("old")).alias("scopes"), F.array(F.lit("old")).alias("notices"),
            )
        ).alias("body"),
    )
    asked = load(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit('"p'), F.col("c_custkey").cast("string"), F.lit('"')).alias("needle"), F.array("c_mktsegment").alias("new_scopes"), F.array("c_name").alias("new_notices")
    )
    schema = "plan string, status string, scopes array<string>, notices array<string>"
    found = H.reuse_previous(asked, stored, "needle", {"scopes": "new_scopes", "notices": "new_notices"}, schema)
    return found.select("c_custkey", "id", F.to_json("result").alias("result"))


@query(
    "h14_distinct_keep_order",
    """with l as (select doc_id, unnest(string_split(text, ' ')) as k, unnest(range(1, len(string_split(text, ' ')) + 1)) as i from documents),
f as (select doc_id, k, min(i) as i from l group by all) select doc_id, string_agg(k, ' ' order by i) as keys from f group by doc_id""",
)
def distinct_keys(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.array_join(H.distinct_keep_order(F.split("text", " ", -1)), " ").alias("keys"))
