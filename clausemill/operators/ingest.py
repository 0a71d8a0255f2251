"""Corpus ingest: dedup, signatures, version choice, merging, page selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.functions.coding_base import look_up
from clausemill.functions.dims import FILE_CLASSES
from clausemill.functions.ordered import ordered_join
from clausemill.functions import urls

SIGNATURE_PREFIX = 3  # hex digits: 4,096 buckets of tokens per policy


def exact_dedup(rows: DataFrame, content: str, order: list[str]) -> DataFrame:
    """Keep the first row of equal content in the given total order.

    The rank limit runs before the shuffle as well, so each task sends one row per
    content: a content that makes up a third of the corpus costs a row per task.
    """
    hashed = rows.withColumn("content_md5", F.md5(content))
    w = Window.partitionBy("content_md5").orderBy(*order)
    return hashed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def extract_links(pages: DataFrame, key: str, html: str, needle: str = "pdf") -> DataFrame:
    return pages.select(key, F.explode(urls.link_targets(F.col(html), needle)).alias("link"))


def expand_one_hop(docs: DataFrame, links: DataFrame, store: DataFrame) -> DataFrame:
    """Listed documents plus the linked ones found in ``store(url, content)``, then exact dedup.

    Columns ``(url, content, ord)``; linked documents are tagged as attachments and
    come after all listed ones. Links that lead nowhere are ignored.
    """
    wanted = links.groupBy(F.col("link").alias("url")).agg(F.min("ord").alias("ord"))
    linked = store.join(wanted, "url").select(
        "url", "content", "ord", F.lit("附件下载").alias("file_class"), F.lit(1).alias("source_rank")
    )
    listed = docs.select("url", "content", "ord", "file_class", F.lit(0).alias("source_rank"))
    return exact_dedup(listed.unionByName(linked), "content", ["source_rank", "ord", "url"])


def corpus_signature(files: DataFrame, policy: str, name: str, etag: str) -> DataFrame:
    """``(policy, n_files, signature)`` over the ``name:etag`` tokens of each policy.

    Tokens are put in buckets by the first digits of their md5. A bucket's digest is the md5 of
    its sorted tokens, the signature is the md5 of the digests in bucket order, both joined by
    ``|``; so it is the same for every order of files and no task holds a policy whole. Files
    without etag are left out; policies without any are in :func:`unsigned_policies`.
    """
    tokens = files.filter(F.coalesce(F.col(etag), F.lit("")) != "").select(
        policy, F.concat_ws(":", F.coalesce(F.col(name), F.lit("")), F.col(etag)).alias("token")
    )
    digests = tokens.groupBy(policy, F.substring(F.md5("token"), 1, SIGNATURE_PREFIX).alias("bucket")).agg(
        F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("token")), "|")).alias("digest")
    )
    return digests.groupBy(policy).agg(
        F.sum("n").alias("n_files"), F.md5(ordered_join([F.col("bucket")], F.col("digest"), "|")).alias("signature")
    )


def unsigned_policies(files: DataFrame, policy: str, etag: str) -> DataFrame:
    """``(policy, n_files)`` of the policies that have no file with an etag, for the rejects table."""
    signed = F.max(F.coalesce(F.col(etag), F.lit("")) != "")
    return files.groupBy(policy).agg(F.count("*").alias("n_files"), signed.alias("_signed")).filter("not _signed").drop("_signed")


def plan_work(corpora: DataFrame, entries: DataFrame, keys: list[str], n_kinds: int = 3) -> DataFrame:
    """Corpora whose artefacts are not all there yet for their signature."""
    done = entries.groupBy(*keys).agg(F.count_distinct("kind").alias("n")).filter(F.col("n") >= n_kinds)
    return corpora.join(done, keys, "left_anti")


def latest_version(entries: DataFrame, policy: str) -> DataFrame:
    """The signature of greatest ``created_at`` per policy.

    Only a policy where no entry has metadata falls back to file time.
    """
    order = F.struct(
        F.col("created_at").isNotNull().alias("has"), F.col("created_at").alias("at"),
        F.col("file_time").alias("ft"), F.col("signature").alias("tie"),
    )
    return entries.groupBy(policy).agg(F.max_by("signature", order).alias("signature"))


def derive_policy_no(policy_type: Column, group_no: Column, plan_codes: Column) -> Column:
    """Group policies keep their number; individual ones are named by their distinct plan codes, sorted."""
    named = F.concat(F.lit("individual_"), F.array_join(F.array_sort(F.array_distinct(plan_codes)), "_"))
    return F.when((policy_type == "2") & (group_no != ""), group_no).when(
        (policy_type == "1") & (F.size(plan_codes) > 0), named
    )


def file_class_text(code: Column) -> Column:
    return look_up(FILE_CLASSES, code)


def md_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf$", ".md")


def marked_text(name: Column, file_class: Column, text: Column) -> Column:
    """A file's text under its marker heading."""
    kind = F.when(F.coalesce(file_class, F.lit("")) != "", F.concat(F.lit(" | "), file_class_text(file_class)))
    return F.concat(F.lit("# FILE: "), md_name(name), F.coalesce(kind, F.lit("")), F.lit("\n\n"), text, F.lit("\n\n"))


def merge_docs(files: DataFrame, policy: str, order: list[str]) -> DataFrame:
    """One Markdown text per policy from ``(file_name, file_class, text)``, in input order."""
    body = marked_text(F.col("file_name"), F.col("file_class"), F.col("text"))
    return files.groupBy(policy).agg(ordered_join([F.col(o) for o in order], body, "").alias("merged"))


def append_typed_texts(merged: Column, texts: Column) -> Column:
    """Add special agreements and protocols, given as array of ``(kind, text)``, under their own headings."""
    added = F.transform(
        texts,
        lambda t: F.when(t["kind"] == "特别约定", F.concat(F.lit("# 特别约定如下：\n"), F.coalesce(t["text"], F.lit(""))))
        .when(t["kind"] == "协议", F.concat(F.lit("# 协议补充如下：\n"), F.coalesce(t["text"], F.lit(""))))
        .otherwise(""),
    )
    return F.concat(merged, F.array_join(added, ""))


def sample_pages(pages: DataFrame, doc: str, page: str, n: int) -> DataFrame:
    """At most ``n`` pages per document, chosen by hash so that a rerun chooses the same."""
    pick = F.md5(F.concat_ws(":", F.col(doc).cast("string"), F.col(page).cast("string")))
    w = Window.partitionBy(doc).orderBy("_pick", page)
    return pages.withColumn("_pick", pick).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_pick", "_rn")


def classify_text_yield(pages: DataFrame, doc: str, text: str, image_share: str | None = None) -> DataFrame:
    """``ocr`` or ``txt`` per document from its pages.

    ``ocr`` with under 50 non-space characters per page on average, more than 5%
    undecodable characters, or 80% of pages covered by images to 80% or more.
    """
    cover = F.coalesce(F.col(image_share), F.lit(0.0)) if image_share else F.lit(0.0)
    stats = pages.groupBy(doc).agg(
        F.count("*").alias("n_pages"),
        F.sum(F.length(F.regexp_replace(text, r"[\s\p{Z}]+", ""))).alias("n_chars"),
        F.sum(F.length(text)).alias("n_all"),
        F.sum(F.regexp_count(F.col(text), F.lit("[�]|\\(cid:\\d+\\)"))).alias("n_bad"),
        F.sum((cover >= 0.8).cast("int")).alias("n_covered"),
    )
    is_ocr = (
        (F.col("n_chars") < 50 * F.col("n_pages"))
        | (F.col("n_bad") * 20 > F.col("n_all"))
        | (F.col("n_covered") * 10 >= F.col("n_pages") * 8)
    )
    return stats.withColumn("kind", F.when(is_ocr, "ocr").otherwise("txt"))


def page_range(pages: DataFrame, page: str, start: int, end: int | None = None) -> DataFrame:
    """Pages from ``start`` to ``end``; an end that is missing, negative or past the last page means the last."""
    kept = F.col(page) >= start
    return pages.filter(kept if end is None or end < 0 else kept & (F.col(page) <= end))
