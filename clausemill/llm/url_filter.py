"""URL verdicts by fixed rules and by a tree of path templates learnt from labelled pages.

Per host, path segments become templates: digits are wildcards, and a segment position
with many different values is a wildcard as a whole. Sibling templates whose labelled
shares don't differ significantly are merged. A template is blocked when its smoothed share of good
pages is below a limit. Pages are reduced to counts per host and digit-free path before the tree is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.llm.common import cut_lineage, small_side

# Digits vary, whatever their number.
DIGITS = "[0-9]+"
WILD = "*"
REST = "**"


@dataclass(frozen=True)
class Tree:
    max_children: int = 20
    """A position with more values than this is a wildcard."""
    max_depth: int = 8
    """Deeper segments of a path are one segment of the template."""
    prior_weight: float = 10.0
    """Labelled pages' worth of the overall share of good ones in each template's share."""
    max_z: float = 2.0
    """Siblings whose shares differ by less than so many standard errors are one template."""
    min_good: float = 0.5
    """A template below this smoothed share is blocked."""


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", text)
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest of ``(verdict, rule)`` that fits, else null.

    A rule ``name/path`` fits the host and its subdomains if the path starts with the rule's.
    """
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        ok = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<length: int, rule: string, verdict: string>")
    return F.array_max(F.filter(F.array(none, *fits), lambda x: x.isNotNull()))


def lexical(path: Column, tree: Tree) -> Column:
    """Segments of a path with digits as wildcards, at most ``max_depth`` of them."""
    segments = F.split(F.regexp_replace(F.regexp_replace(path, r"^/", ""), DIGITS, WILD), "/")
    deep = F.size(segments) > tree.max_depth
    return F.when(deep, F.concat(F.slice(segments, 1, tree.max_depth - 1), F.array(F.lit(REST)))).otherwise(segments)


def templates(labelled: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """``(host, key, template, n, labelled, good, share, verdict)`` per host and digit-free path ``key``.

    ``labelled`` has host, path and good (boolean, null where there is no label).
    """
    rows = labelled.select("host", lexical(F.col("path"), tree).alias("segments"), "good")
    rows = rows.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count("good").alias("labelled"), F.sum(F.col("good").cast("long")).alias("good")
    ).withColumn("good", F.coalesce("good", F.lit(0).cast("long"))).withColumn("key", F.array_join("segments", "/"))
    rows = cut_lineage(rows)
    depth = rows.agg(F.max(F.size("segments"))).first()[0] or 0  # at most max_depth
    for level in range(1, depth + 1):
        prefix, segment = F.array_join(F.slice("segments", 1, level - 1), "/"), F.col("segments")[level - 1]
        here = rows.filter(F.size("segments") >= level).select("host", prefix.alias("prefix"), segment.alias("segment"))
        wide = here.distinct().groupBy("host", "prefix").count().filter(F.col("count") > tree.max_children)
        wide = wide.select("host", "prefix", F.lit(True).alias("wide"))
        wild = F.transform("segments", lambda s, i: F.when(i == level - 1, F.lit(WILD)).otherwise(s))
        rows = rows.withColumn("prefix", prefix).join(small_side(wide), ["host", "prefix"], "left")
        rows = rows.withColumn("segments", F.when(F.col("wide") & (F.size("segments") >= level), wild).otherwise(F.col("segments")))
        rows = cut_lineage(rows.drop("prefix", "wide"))
    return _judged(rows, tree)


def _judged(rows: DataFrame, tree: Tree) -> DataFrame:
    total = rows.agg(F.sum("labelled"), F.sum("good")).first()
    overall = (total[1] or 0) / total[0] if total[0] else 1.0
    smooth = lambda good, n: (good + tree.prior_weight * overall) / (n + tree.prior_weight)
    leaves = rows.groupBy("host", "segments").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good")
    )
    # Siblings number at most max_children, as wider positions are wildcards.
    leaves = leaves.withColumn("parent", F.array_join(F.slice("segments", 1, F.size("segments") - 1), "/"))
    leaves = leaves.withColumn("share", smooth(F.col("good"), F.col("labelled")))
    order = Window.partitionBy("host", "parent").orderBy("share", "segments")
    weight = F.col("labelled") + tree.prior_weight
    before = lambda c: F.lag(c).over(order)
    pooled = (F.col("share") * weight + before("share") * before(weight)) / (weight + before(weight))
    error = F.sqrt(pooled * (1 - pooled) * (1 / weight + 1 / before(weight)))
    apart = F.coalesce((F.col("share") - before("share")) > tree.max_z * error, F.lit(False))
    branch = F.sum(F.col("branch_starts").cast("int")).over(order)
    leaves = leaves.withColumn("branch_starts", apart).withColumn("branch", branch)
    merged = Window.partitionBy("host", "parent", "branch")
    share = smooth(F.sum("good").over(merged), F.sum("labelled").over(merged))
    name = F.array_join(F.array_sort(F.collect_set(F.element_at("segments", -1)).over(merged)), "|")
    leaves = leaves.select(
        "host", "segments", F.concat(F.lit("/"), F.when(F.col("parent") != "", F.concat("parent", F.lit("/"))).otherwise(""), name).alias("template"),
        share.alias("share"), F.when(share < tree.min_good, "block").otherwise("allow").alias("verdict"),
    )
    kept = rows.select("host", "segments", "key", "n", "labelled", "good")
    return kept.join(leaves, ["host", "segments"]).drop("segments")


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]], tree: Tree = Tree()) -> DataFrame:
    """``(page_id, url, host, path, rule, template, share, verdict)`` of every row of ``pages``.

    ``pages`` has page_id, url and good (boolean label or null). A fixed rule decides where one
    fits, else the template. Null urls and urls without ``://`` have an empty host and path and
    form a host like others. Each row is judged for itself; no rows give no rows.
    """
    rows = pages.select("page_id", "url", "good", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    learnt = templates(rows, tree).select("host", "key", "template", "share", F.col("verdict").alias("learnt"))
    rows = rows.withColumn("key", F.array_join(lexical(F.col("path"), tree), "/"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(small_side(learnt), ["host", "key"], "left").withColumn("fit", rule).select(
        "page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), "template", "share",
        F.coalesce("fit.verdict", "learnt", F.lit("allow")).alias("verdict"),
    )
