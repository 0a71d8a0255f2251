"""Registered queries for retrieval, fusion and the result cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions.terms import tokenize
from clausemill.operators import cache as C, retrieval as R
from clausemill.operators.structure import split_oversize
from clausemill.plans.fixtures import MD_CHUNKS, MD_DOCS, with_ctes
from clausemill.plans.scratch import kept
from clausemill.plans.q_structure import doc_chunks, md_chunks
from clausemill.plans.registry import query
from clausemill.session import load


def corpus(spark, sf):
    """Passages: documents cut to windows, stored once. ``chunk`` numbers them as document * 1000 + part."""
    def build(folder):
        rows = split_oversize(doc_chunks(spark, sf))
        rows.select((F.col("doc_id") * 1000 + F.col("split_part")).alias("chunk"), F.col("page_content").alias("text")).write.parquet(folder)

    return spark.read.schema("chunk long, text string").parquet(kept(spark, "passages", f"{sf}/documents.parquet", build))


def phrases(spark, sf):
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def term_index(spark, sf):
    """The inverted index of the passages, stored once."""
    def build(folder):
        R.build_index(corpus(spark, sf), "chunk", "text", folder)

    return R.open_index(spark, kept(spark, "index", f"{sf}/documents.parquet", build))


_CORPUS = """
corpus as (select doc_id * 1000 + case when n > 1 then k + 1 else 0 end as chunk, substring(text, (k * 5800 + 1)::bigint, 6000) as text
from (select doc_id, text, case when length(text) <= 6000 then 1 else ceil((length(text) - 6000) / 5800.0)::int + 1 end as n from documents), unnest(range(0, n)) as u(k))
"""
_TOKENS = r"等待期|责任免除|免责条款|既往症|\p{Han}|[\pL\pN]+"


@query(
    "r01_tokenize",
    rf"""select doc_id, array_to_string(regexp_extract_all('等待期内 责任免除以外 ' || text, '{_TOKENS}'), '|') as tokens from documents""",
)
def tokens(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", F.array_join(tokenize(F.concat(F.lit("等待期内 责任免除以外 "), "text")), "|").alias("tokens")
    )


_STATS = rf"""
toks as (select chunk, unnest(regexp_extract_all(text, '{_TOKENS}')) as term from corpus),
tfs as (select chunk, term, count(*) as tf from toks group by all),
lens as (select chunk, len(regexp_extract_all(text, '{_TOKENS}')) as doc_len from corpus),
totals as (select count(*) as n, avg(doc_len) as mean_len from lens),
dfs as (select term, count(*) as df, sum(tf)::bigint as cf from tfs group by term)
"""


@query(
    "r02_term_stats",
    with_ctes(_CORPUS, _STATS, "select term, df, cf, n, round(mean_len, 6) as mean_len from dfs, totals"),
)
def term_stats(spark, sf):
    index = term_index(spark, sf)
    return index.terms.select("term", "df", "cf", F.lit(index.n).cast("long").alias("n"), F.lit(round(index.mean_len, 6)).alias("mean_len"))


_BM25 = rf"""
raws as (select term, ln((n - df + 0.5) / (df + 0.5)) as raw, n, mean_len from dfs, totals),
idfs as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raws) else raw end as idf, mean_len from raws),
asked as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest(regexp_extract_all(text, '{_TOKENS}')) as term from benchmark) group by all),
bm25 as (select query_id, chunk, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * doc_len / mean_len))), 9) as score
  from asked join idfs using (term) join tfs using (term) join lens using (chunk) group by all),
bm25_top as (select *, row_number() over (partition by query_id order by score desc, chunk) as rank from bm25 qualify rank <= 50)
"""


def bm25(spark, sf):
    index = term_index(spark, sf)
    return R.bm25_topk(index, "chunk", phrases(spark, sf), "query")


@query("r03_bm25_topk", with_ctes(_CORPUS, _STATS, _BM25, "select query_id, chunk, rank, round(score, 6) as score from bm25_top"))
def bm25_top(spark, sf):
    return bm25(spark, sf).select("query_id", "chunk", "rank", F.round("score", 6).alias("score"))


_STRING = """
pos as (select item_id as query_id, text, unnest(range(1, length(text) + 1)) as i from benchmark),
grams as (select query_id, g, sum(w) as w from (select query_id, substring(text, i, 1) as g, 1 as w from pos union all select query_id, substring(text, i, 2), 3 from pos where i < length(text)) group by all),
seen as (select chunk, g from corpus, (select distinct g from grams) where contains(text, g)),
strings as (select query_id, chunk, sum(w)::double as score from grams join seen using (g) group by all),
string_top as (select *, row_number() over (partition by query_id order by score desc, chunk) as rank from strings qualify rank <= 50)
"""


def string_match(spark, sf):
    return R.string_match_topk(corpus(spark, sf), "chunk", "text", phrases(spark, sf), "query")


@query("r04_string_match_topk", with_ctes(_CORPUS, _STRING, "select query_id, chunk, rank, score from string_top"))
def string_top(spark, sf):
    return string_match(spark, sf).select("query_id", "chunk", "rank", "score")


_VECTOR = """
vqueries as (select item_id as query_id, e.embedding::double[] as qv from benchmark b join embeddings e on e.vec_id = b.item_id),
dists as (select query_id, vec_id * 1000 as chunk, round(list_distance(embedding::double[], qv) ** 2, 9) as distance from embeddings, vqueries),
vector_top as (select *, 1 / (1 + distance) as score, row_number() over (partition by query_id order by distance, chunk) as rank from dists qualify rank <= 10)
"""


def vectors(spark, sf):
    return load(spark, sf, "embeddings").select((F.col("vec_id") * 1000).alias("chunk"), "vec_id", "embedding")


def vector_queries(spark, sf):
    return vectors(spark, sf).join(load(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")
    )


def vector_hits(spark, sf):
    return R.vector_topk(vectors(spark, sf), "chunk", "embedding", vector_queries(spark, sf), "qv")


@query("r05_vector_topk", with_ctes(_VECTOR, "select query_id, chunk, rank, round(distance, 6) as distance from vector_top"))
def vector_top(spark, sf):
    return vector_hits(spark, sf).select("query_id", "chunk", "rank", F.round("distance", 6).alias("distance"))


@query("r06_similarity", with_ctes(_VECTOR, "select query_id, chunk, round(score, 6) as score from vector_top"))
def similarities(spark, sf):
    return vector_hits(spark, sf).select("query_id", "chunk", F.round("score", 6).alias("score"))


_ARMS = """
arms as (select query_id, 'vector' as arm, 0 as pri, rank, score, chunk from vector_top union all select query_id, 'bm25', 1, rank, score, chunk from bm25_top
  union all select query_id, 'string_match', 2, rank, score, chunk from string_top)
"""
_ALL_ARMS = (_CORPUS, _STATS, _BM25, _STRING, _VECTOR, _ARMS)


def arms(spark, sf):
    return (
        R.hits(vector_hits(spark, sf), "chunk", "vector")
        .unionByName(R.hits(bm25(spark, sf), "chunk", "bm25"))
        .unionByName(R.hits(string_match(spark, sf), "chunk", "string_match"))
    )


@query(
    "r07_fuse_priority",
    with_ctes(*_ALL_ARMS, """
best as (select query_id, chunk, arg_min({'arm': arm, 'rank': rank, 'score': score, 'pri': pri}, pri) as b, string_agg(arm, ',' order by pri) as sources from arms group by all)""", """
select query_id, chunk, b.arm as arm, b.rank as rank, round(b.score, 6) as score, sources, row_number() over (partition by query_id order by b.pri, b.rank, chunk) as position from best"""),
)
def fused(spark, sf):
    return R.fuse_priority(arms(spark, sf)).select(
        "query_id", "chunk", "arm", "rank", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"), "position"
    )


@query(
    "r08_fuse_rrf",
    with_ctes(*_ALL_ARMS, """
rrf as (select query_id, chunk, round(sum(1 / (60 + rank)), 9) as s, count(*) as n_arms from arms group by all)""", """
select query_id, chunk, round(s, 6) as rrf_score, n_arms, row_number() over (partition by query_id order by s desc, chunk) as position from rrf"""),
)
def rrf(spark, sf):
    return R.fuse_rrf(arms(spark, sf)).select("query_id", "chunk", F.round("rrf_score", 6).alias("rrf_score"), "n_arms", "position")


# Verdict replies stated from labels; each document is a hit of a query type.
_VERDICTS = """
verdicts as (select doc_id, quality, case doc_id % 3 when 0 then '<thought> seen ' || doc_id || ' </thought><output>' || case when quality = 1 then '包含数值' else '不包含' end || '</output>'
   when 1 then case when quality = 1 then '包含' else '结论：不包含' end else '<output>' || chr(10) || case when quality = 1 then 'yes' else '不包含任何' end || '</output><thought></thought>' end as reply from labels)
"""


def _verdicts(spark, sf):
    good, n = F.col("quality") == 1, F.col("doc_id") % 3
    reply = (
        F.when(
            n == 0,
            F.concat(
                F.lit("<thought> seen "), F.col("doc_id").cast("string"), F.lit(" </thought><output>"),
                F.when(good, "包含数值").otherwise("不包含"), F.lit("</output>"),
            ),
        )
        .when(n == 1, F.when(good, "包含").otherwise("结论：不包含"))
        .otherwise(F.concat(F.lit("<output>\n"), F.when(good, "yes").otherwise("不包含任何"), F.lit("</output><thought></thought>")))
    )
    return load(spark, sf, "labels").select("doc_id", "quality", reply.alias("reply"))


_TYPES = ("既往症", "特别约定", "理算因子", "等待期", "责任免除", "其他")


@query(
    "r09_relevance_filter",
    with_ctes(_VERDICTS, """
typed as (select doc_id, ['既往症', '特别约定', '理算因子', '等待期', '责任免除', '其他'][(doc_id % 6 + 1)::int] as query_type from documents)""", """
select t.doc_id, query_type, case when query_type in ('理算因子', '等待期', '责任免除') then case when v.doc_id % 3 = 0 then 'seen ' || v.doc_id else '' end end as note
from typed t left join verdicts v on v.doc_id = t.doc_id where query_type not in ('理算因子', '等待期', '责任免除') or v.quality = 1"""),
)
def relevant(spark, sf):
    kinds = F.array(*[F.lit(t) for t in _TYPES])
    found = load(spark, sf, "documents").select("doc_id", F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("query_type"))
    return R.relevance_filter(found, _verdicts(spark, sf), ["doc_id"]).select("doc_id", "query_type", "note")


@query(
    "r10_parse_verdict",
    with_ctes(_VERDICTS, "select doc_id, quality as relevant, case when doc_id % 3 = 0 then 'seen ' || doc_id else '' end as note from verdicts"),
)
def verdict(spark, sf):
    parsed = _verdicts(spark, sf).withColumn("v", R.parse_verdict(F.col("reply")))
    return parsed.select("doc_id", F.col("v.relevant").cast("int").alias("relevant"), "v.note")


@query(
    "r11_parse_verdict_batch",
    """select doc_id, segment::int as segment, case when segment = 3 then 0 when segment = 2 then toxic else quality end as relevant,
  case when segment = 1 then 'why ' || doc_id else '' end as note from labels, unnest(range(1, 4)) as u(segment)""",
)
def verdict_batch(spark, sf):
    def word(flag):
        return F.when(F.col(flag) == 1, "包含").otherwise("不包含")

    reply = F.concat(
        F.lit("<segment_2>\n"), word("toxic"), F.lit("\n</segment_2> text <segment_1><thought>why "), F.col("doc_id").cast("string"),
        F.lit("</thought><output>"), word("quality"), F.lit("</output></segment_1>"),
    )
    rows = load(spark, sf, "labels").select("doc_id", reply.alias("reply"), F.lit(3).alias("n"))
    parsed = R.parse_verdict_batch(rows, "reply", "n")
    return parsed.select("doc_id", "segment", F.col("relevant").cast("int").alias("relevant"), "note")


_RECALL = """
catalogue as (select doc_id, original_index, page_content as content, structure_path from md_chunks where structure_level <= 1),
vector as (select doc_id, original_index, 'v:' || page_content as content, structure_path from md_chunks where original_index % 2 = 0),
recalled as (select coalesce(c.doc_id, v.doc_id) as doc_id, coalesce(c.original_index, v.original_index) as original_index, coalesce(c.content, v.content) as content,
  coalesce(c.structure_path, v.structure_path) as structure_path, case when c.doc_id is not null then 'catalog' else 'vector' end as origin
  from catalogue c full join vector v on c.doc_id = v.doc_id and c.original_index = v.original_index)
"""


def recalled(spark, sf):
    rows = md_chunks(spark, sf).withColumnRenamed("page_content", "content")
    vector = rows.filter("original_index % 2 = 0").withColumn("content", F.concat(F.lit("v:"), "content"))
    return R.union_recall(rows.filter("structure_level <= 1"), vector, ["doc_id", "original_index"])


@query("r12_union_recall", with_ctes(MD_DOCS, MD_CHUNKS, _RECALL, "select doc_id, original_index, content, structure_path, origin from recalled"))
def union_recall(spark, sf):
    return recalled(spark, sf)


@query(
    "r13_assemble_context",
    with_ctes(MD_DOCS, MD_CHUNKS, _RECALL, r"""
numbered as (select doc_id, row_number() over (partition by doc_id order by original_index) as n, structure_path, case when original_index % 3 = 1 then '' else content end as content from recalled)""", r"""
select doc_id, '【目录检索内容】' || chr(10) || chr(10) || regexp_replace(string_agg('- 第' || n || '段文本：文本来源：' || structure_path || chr(10) || content, chr(10) order by n), '[\s\pZ]+$', '') as context
from numbered where content <> '' group by doc_id"""),
)
def contexts(spark, sf):
    blanked = recalled(spark, sf).withColumn("content", F.when(F.col("original_index") % 3 == 1, "").otherwise(F.col("content")))
    return R.assemble_context(blanked, "doc_id", ["original_index"])


@query(
    "r14_merge_scope_lines",
    """with p as (select doc_id, unnest([text, case when doc_id % 2 = 0 then ' 无 ' else 'second' || chr(10) || chr(10) || lang end, null]) as part, unnest([1, 2, 3]) as pos from documents),
l as (select doc_id, pos, i, string_split(part, chr(10))[i] as s from p, unnest(range(1, len(string_split(part, chr(10))) + 1)) as u(i) where trim(part) <> '无')
select doc_id, coalesce(string_agg(s, chr(10) order by pos, i), '') as merged from l where regexp_replace(s, '[\\s\\pZ]+', '', 'g') <> '' group by doc_id""".replace("\\\\", "\\"),
)
def scope_lines(spark, sf):
    second = F.when(F.col("doc_id") % 2 == 0, " 无 ").otherwise(F.concat(F.lit("second\n\n"), "lang"))
    return load(spark, sf, "documents").select(
        "doc_id", R.merge_scope_lines(F.array("text", second, F.lit(None).cast("string"))).alias("merged")
    )


_FACTORS = """
factors as (select distinct p_brand as factor from part),
fscopes as (select distinct p_brand as factor, p_type as scope, length(p_type) as pos from part),
fsyn as (select p_brand as factor, p_name as term, min(p_partkey) as pos from part group by all),
expanded as (select factor, 0 as kind, 0 as pos, factor as query from factors union all select factor, 1, pos, scope from fscopes union all select factor, 2, pos, term from fsyn)
"""


def expanded(spark, sf):
    part = load(spark, sf, "part").withColumnRenamed("p_brand", "factor")
    scopes = part.select("factor", F.col("p_type").alias("scope"), F.length("p_type").cast("long").alias("pos")).distinct()
    synonyms = part.groupBy("factor", F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("pos"))
    factors = part.select("factor").distinct()
    scopes = scopes.withColumn("pos", F.col("pos"))
    return R.expand_query(factors, scopes, synonyms, "factor")


@query("r15_expand_query", with_ctes(_FACTORS, "select factor, kind, pos, query from expanded"))
def expand(spark, sf):
    return expanded(spark, sf)


_MULTI = """
multi as (select conv_id, turn, role, text as content, row_number() over (partition by conv_id, md5(text) order by turn, role) as rn from
   (select conv_id, turn, role, text from conversations union all select conv_id, turn + 100, 'again', text from conversations))
"""


def recalled_turns(spark, sf):
    turns = load(spark, sf, "conversations")
    again = turns.withColumns({"turn": F.col("turn") + 100, "role": F.lit("again")})
    return R.multi_query_recall(turns.unionByName(again).withColumnRenamed("text", "content"), "conv_id", ["turn", "role"])


@query("r16_multi_query_recall", with_ctes(_MULTI, "select conv_id, turn, role, content from multi where rn = 1"))
def multi_recall(spark, sf):
    return recalled_turns(spark, sf).select("conv_id", "turn", "role", "content")


@query(
    "r17_recall_pivot",
    with_ctes("ctx as (select conv_id, role, string_agg(text, chr(10) order by turn) as c from conversations group by all)", """
select conv_id, string_agg(role || '=' || c, ';' order by role) as recall from ctx group by conv_id"""),
)
def pivoted(spark, sf):
    from clausemill.functions.ordered import ordered_join

    per_role = load(spark, sf, "conversations").groupBy("conv_id", "role").agg(ordered_join([F.col("turn")], F.col("text"), "\n").alias("c"))
    recall = R.recall_pivot(per_role, "conv_id", "role", "c")
    flat = F.transform(F.map_entries("recall"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return recall.select("conv_id", F.array_join(flat, ";").alias("recall"))


@query(
    "r18_embedding_batches",
    "select vec_id, vec_id // 100 as span, (row_number() over (partition by vec_id // 100 order by vec_id) - 1) // 10 as batch, (len(embedding) <> 64)::int as wrong from embeddings",
)
def batches(spark, sf):
    rows = load(spark, sf, "embeddings")
    wrong = R.wrong_dimension(rows, "embedding", 64).select("vec_id", F.lit(1).alias("wrong"))
    return (
        R.embedding_batches(rows, "vec_id", 10, 100).join(wrong, "vec_id", "left").select("vec_id", "span", "batch", F.coalesce("wrong", F.lit(0)).alias("wrong"))
    )


_DAY = 86_400_000_000


def query_log(spark, sf):
    return load(spark, sf, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")
    )


_REPLAY = f"""
qlog as (select user_id || ':' || event_type as key, epoch_us(ts) as ts from events),
misses as (select key, min(ts) as ts from qlog group by key union all
   select m.key, (select min(q.ts) from qlog q where q.key = m.key and q.ts > m.ts + {_DAY}) as ts from misses m where m.ts is not null),
replayed as (select q.key, q.ts, case when q.ts = m.ts then 0 else 1 end as hit from qlog q asof join (select * from misses where ts is not null) m on q.key = m.key and q.ts >= m.ts)
"""


@query("r19_query_cache", with_ctes(_REPLAY, "select key, ts, hit from replayed"))
def cached(spark, sf):
    return C.query_cache(query_log(spark, sf), "key", "ts", _DAY).withColumn("hit", F.col("hit").cast("int"))


@query(
    "r20_cache_stats",
    with_ctes(_REPLAY, """
select split_part(key, ':', 2) as event_type, sum(hit)::bigint as hits, sum(1 - hit)::bigint as misses, round(sum(hit) / count(*), 6) as hit_rate from replayed group by 1"""),
)
def cache_stats(spark, sf):
    replayed = C.query_cache(query_log(spark, sf), "key", "ts", _DAY)
    return C.cache_stats(replayed.withColumn("event_type", F.split_part("key", F.lit(":"), F.lit(2))), "event_type")


@query(
    "r21_cosine_rank",
    with_ctes(_VECTOR, """
cos as (select query_id, vec_id * 1000 as chunk, round(list_cosine_similarity(embedding::double[], qv), 9) as s from embeddings, vqueries)""", """
select query_id, chunk, round(s, 6) as score, row_number() over (partition by query_id order by s desc, chunk) as rank from cos qualify rank <= 10"""),
)
def cosine(spark, sf):
    found = R.cosine_rank(vectors(spark, sf), "chunk", "embedding", vector_queries(spark, sf), "qv")
    return found.select("query_id", "chunk", F.round("score", 6).alias("score"), "rank")
