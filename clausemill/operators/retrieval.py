"""Hybrid retrieval: BM25, string match and vectors, fused by arm priority, all queries in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.functions.ordered import ordered_join
from clausemill.functions.text import strip
from clausemill.operators import topk
from clausemill.operators.postings import PostingIndex, bm25_topk, build_index, open_index  # noqa: F401

BM25_TOP, STRING_TOP, VECTOR_TOP = 50, 50, 10
RRF_K = 60
ARM_PRIORITY = {"vector": 0, "bm25": 1, "string_match": 2}
PASS_THROUGH_TYPES = ("既往症", "特别约定")
CHECKED_TYPES = ("理算因子", "等待期", "责任免除")
NEGATIVE_PHRASE = "不包含"
NO_ANSWER = "无"
SCORE_DIGITS = 9


def string_match_topk(chunks: DataFrame, key: str, text: str, queries: DataFrame, query: str, k: int = STRING_TOP, **kw) -> DataFrame:
    """``(query_id, key, score, rank)``: 1 per query character and 3 per character pair found in the text."""
    prepare, scorer = topk.string_match_scorer()
    return topk.score_topk(chunks, key, text, queries, query, prepare, scorer, k, **kw).withColumnRenamed("key", key)


def vector_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query: str, k: int = VECTOR_TOP, **kw) -> DataFrame:
    """``(query_id, key, distance, score, rank)`` by squared L2; score is ``1 / (1 + distance)``."""
    prepare, scorer = topk.l2_scorer(k)
    found = topk.score_topk(vectors, key, vector, queries, query, prepare, scorer, k, **kw)
    distance = -F.col("score")
    return found.select("query_id", F.col("key").alias(key), distance.alias("distance"), similarity(distance).alias("score"), "rank")


def cosine_rank(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query: str, k: int = VECTOR_TOP, **kw) -> DataFrame:
    prepare, scorer = topk.cosine_scorer()
    return topk.score_topk(vectors, key, vector, queries, query, prepare, scorer, k, **kw).withColumnRenamed("key", key)


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def arm_priority(arm: Column) -> Column:
    return F.coalesce(*[F.when(arm == name, F.lit(p)) for name, p in ARM_PRIORITY.items()], F.lit(len(ARM_PRIORITY)))


def hits(found: DataFrame, key: str, arm: str) -> DataFrame:
    return found.select("query_id", F.lit(arm).alias("arm"), "rank", F.col("score").cast("double").alias("score"), F.col(key).cast("long").alias("chunk"))


def chunk_identity(original_index: Column, split_part: Column, text: Column, parent_level: bool = False) -> Column:
    """What makes two hits the same chunk: its index and part, or its text where it has no index.

    ``parent_level=True`` treats all parts of a split chunk as one.
    """
    own = original_index.cast("string") if parent_level else F.concat_ws(":", original_index.cast("string"), split_part.cast("string"))
    return F.when(original_index.isNotNull(), own).otherwise(F.concat(F.lit("t"), F.xxhash64(text).cast("string")))


def fuse_priority(arms: DataFrame, identity: str = "chunk") -> DataFrame:
    """One row per query and chunk from the best arm that found it, with all arms that did.

    Result order is arm order, then rank within the arm.
    """
    ranked = arms.withColumn("_pri", arm_priority(F.col("arm")))
    fused = ranked.groupBy("query_id", identity).agg(
        F.min_by(F.struct("arm", "rank", "score"), F.struct("_pri", "rank")).alias("best"),
        F.transform(F.array_sort(F.collect_set(F.struct("_pri", "arm"))), lambda x: x["arm"]).alias("sources"),
    )
    w = Window.partitionBy("query_id").orderBy(arm_priority(F.col("best.arm")), "best.rank", identity)
    return fused.select(
        "query_id",
        identity,
        F.col("best.arm").alias("arm"),
        F.col("best.rank").alias("rank"),
        F.col("best.score").alias("score"),
        "sources",
        F.row_number().over(w).alias("position"),
    )


def fuse_rrf(arms: DataFrame, identity: str = "chunk", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion."""
    summed = arms.groupBy("query_id", identity).agg(
        F.round(F.sum(1 / (k + F.col("rank"))), SCORE_DIGITS).alias("rrf_score"), F.count("*").alias("n_arms")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), identity)
    return summed.withColumn("position", F.row_number().over(w))


def _tagged(reply: Column, tag: str) -> Column:
    return F.regexp_extract(reply, f"(?s)<{tag}>(.*?)</{tag}>", 1)


def parse_verdict(reply: Column) -> Column:
    """``(relevant, note)``: relevant unless the output, or the whole reply, has the negative phrase."""
    decision = F.when(reply.rlike("(?s)<output>.*?</output>"), _tagged(reply, "output")).otherwise(reply)
    return F.struct(
        (~F.contains(F.coalesce(decision, F.lit("")), F.lit(NEGATIVE_PHRASE))).alias("relevant"),
        strip(F.coalesce(_tagged(reply, "thought"), F.lit(""))).alias("note"),
    )


def parse_verdict_batch(rows: DataFrame, reply: str, n_segments: str) -> DataFrame:
    """One row per asked segment of a batch reply; a segment without a block is not relevant."""
    pattern = r"(?s)<segment_(\d+)>(.*?)</segment_\1>"
    ids = F.regexp_extract_all(reply, F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(reply, F.lit(pattern), F.lit(2))
    asked = rows.withColumn("_ids", ids).withColumn("_bodies", bodies).withColumn(
        "segment", F.explode(F.sequence(F.lit(1), F.col(n_segments).cast("int")))
    )
    at = F.array_position("_ids", F.col("segment").cast("string")).cast("int")
    body = F.when(at > 0, strip(F.try_element_at("_bodies", F.nullif(at, F.lit(0)))))
    verdict = parse_verdict(body)
    return asked.withColumns(
        {
            "relevant": F.when(body.isNull(), False).otherwise(verdict["relevant"]),
            "note": F.when(body.isNull(), "").otherwise(verdict["note"]),
        }
    ).drop("_ids", "_bodies")


def relevance_filter(found: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Hits of checked query types that the validator accepts, with its note; other types pass."""
    judged = verdicts.withColumn("_v", parse_verdict(F.col("reply"))).select(
        *keys, F.col("_v.relevant").alias("_ok"), F.col("_v.note").alias("note")
    )
    checked = F.col("query_type").isin(*CHECKED_TYPES)
    return (
        found.join(judged, keys, "left")
        .filter(~checked | F.coalesce(F.col("_ok"), F.lit(False)))
        .withColumn("note", F.when(checked, F.col("note")))
        .drop("_ok")
    )


def union_recall(catalogue: DataFrame, vector: DataFrame, keys: list[str]) -> DataFrame:
    """Hits by index from catalogue and vector recall; the catalogue's content wins."""
    a = catalogue.select(*keys, F.struct("content", "structure_path").alias("_c"))
    b = vector.select(*keys, F.struct("content", "structure_path").alias("_v"))
    return a.join(b, keys, "full_outer").select(
        *keys,
        F.coalesce("_c.content", "_v.content").alias("content"),
        F.coalesce("_c.structure_path", "_v.structure_path").alias("structure_path"),
        F.when(F.col("_c").isNotNull(), "catalog").otherwise("vector").alias("origin"),
    )


def assemble_context(found: DataFrame, group: str, order: list[str], title: str = "目录检索内容") -> DataFrame:
    """Numbered paragraphs with their source path per group; empty content is skipped but counted."""
    w = Window.partitionBy(group).orderBy(*order)
    numbered = found.withColumn("_n", F.row_number().over(w))
    line = F.when(
        F.coalesce(F.col("content"), F.lit("")) != "",
        F.concat(
            F.lit("- 第"), F.col("_n").cast("string"), F.lit("段文本：文本来源："),
            F.coalesce(F.col("structure_path"), F.lit("")), F.lit("\n"), F.col("content"),
        ),
    )
    joined = numbered.filter(line.isNotNull()).groupBy(group).agg(ordered_join([F.col("_n")], line, "\n").alias("body"))
    return joined.select(group, F.concat(F.lit(f"【{title}】\n\n"), strip(F.col("body"))).alias("context"))


def merge_scope_lines(parts: Column) -> Column:
    """Non-blank lines of all parts in order; a part that only says "none" is dropped."""
    kept = F.filter(parts, lambda p: p.isNotNull() & (strip(p) != NO_ANSWER))
    found = F.flatten(F.transform(kept, lambda p: F.filter(F.split(p, "\n", -1), lambda s: strip(s) != "")))
    return F.array_join(found, "\n")


def expand_query(factors: DataFrame, scopes: DataFrame, synonyms: DataFrame, factor: str) -> DataFrame:
    """Query texts of each factor: the name itself, its allowed scopes, its synonyms."""
    own = factors.select(factor, F.lit(0).alias("kind"), F.lit(0).alias("pos"), F.col(factor).alias("query"))
    allowed = factors.select(factor).join(scopes, factor).select(factor, F.lit(1).alias("kind"), "pos", F.col("scope").alias("query"))
    other = factors.select(factor).join(synonyms, factor).select(factor, F.lit(2).alias("kind"), "pos", F.col("term").alias("query"))
    return own.unionByName(allowed).unionByName(other)


def multi_query_recall(found: DataFrame, factor: str, order: list[str]) -> DataFrame:
    """Union of the hits of all queries of a factor, equal texts kept once, first one wins."""
    w = Window.partitionBy(factor, F.md5("content")).orderBy(*order)
    return found.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def recall_pivot(contexts: DataFrame, group: str, factor: str, context: str) -> DataFrame:
    """One map factor -> context per plan; a plan has few factors."""
    entries = F.array_sort(F.collect_list(F.struct(factor, context)))
    return contexts.groupBy(group).agg(F.map_from_entries(entries).alias("recall"))


def embedding_batches(rows: DataFrame, key: str, size: int = 10, span: int = 100_000) -> DataFrame:
    """Fixed batches of ids in order. Ids are numbered within spans, so no task ranks the whole table."""
    w = Window.partitionBy("span").orderBy(key)
    return rows.withColumn("span", F.floor(F.col(key) / span)).withColumn(
        "batch", F.floor((F.row_number().over(w) - 1) / size)
    )


def wrong_dimension(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector is missing or has another length."""
    return rows.filter(F.coalesce(F.size(vector), F.lit(-1)) != dim)
