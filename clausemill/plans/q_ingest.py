"""Registered queries for sources, sinks and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import urls
from clausemill.functions.text import sorted_json
from clausemill.operators import ingest as I
from clausemill.plans.fixtures import MD_CHUNKS, MD_DOCS, md_docs, with_ctes
from clausemill.plans.q_structure import md_chunks
from clausemill.plans.registry import query
from clausemill.plans.scratch import scratch
from clausemill.session import cut_lineage, load
from clausemill.sources import files as SF, stores as SS


@query(
    "s01_read_chunks",
    with_ctes(MD_DOCS, MD_CHUNKS, "select doc_id, original_index, 0 as split_part, page_content, structure_path from md_chunks"),
)
def read_chunks(spark, sf):
    path = scratch(spark, "chunks") + "/json"
    record = F.struct(
        F.col("original_index").cast("string").alias("index"),
        "page_content",
        F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("structure_path"), F.col("structure_path")).alias("metadata"),
    )
    md_chunks(spark, sf).groupBy("doc_id").agg(F.to_json(F.collect_list(record)).alias("value")).select("value").write.text(path)
    rows = SF.chunk_key(SF.read_chunks(spark, path, multi_line=False))
    return rows.select(
        F.col("metadata")["doc_id"].cast("bigint").alias("doc_id"), "original_index", "split_part", "page_content",
        F.col("metadata")["structure_path"].alias("structure_path"),
    )


@query("s02_read_text", "select source, sum(length(text) + 1)::bigint as n_chars from documents group by source")
def read_text(spark, sf):
    path = scratch(spark, "text") + "/txt"
    docs = load(spark, sf, "documents").select("source", "text")
    docs.write.partitionBy("source").option("maxRecordsPerFile", 500).text(path)
    rows = SF.read_text(spark, f"{path}/source=*")
    source = F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source")
    return rows.groupBy(source).agg(F.sum(F.length("text")).alias("n_chars"))


_FILES = """
files as (select page_id, url, case when page_id % 5 = 0 then '' else url end as file_url, case when page_id % 3 = 0 then 'text/html' else 'application/pdf' end as file_format from pages)
"""


def _files(spark, sf):
    return load(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url")).alias("file_url"),
        F.when(F.col("page_id") % 3 == 0, "text/html").otherwise("application/pdf").alias("file_format"),
    )


@query(
    "s03_pdf_files",
    with_ctes(_FILES, """
select page_id, file_url, case when file_url = '' then 'no url' when file_format <> 'application/pdf' then 'not a pdf' else 'kept' end as outcome from files"""),
)
def pdf_files(spark, sf):
    kept, rejected = SF.pdf_files(_files(spark, sf))
    return kept.withColumn("outcome", F.lit("kept")).unionByName(rejected.withColumnRenamed("reason", "outcome")).select(
        "page_id", "file_url", "outcome"
    )


@query(
    "s03_read_files",
    """select page_id % 8 as bucket, 1 as n_files, sum(strlen(coalesce(html, '')) + 1)::bigint as n_bytes, sum(strlen(coalesce(html, '')) - strlen(replace(coalesce(html, ''), '<', '')))::bigint as n_tags from pages group by 1""",
)
def file_bytes(spark, sf):
    """The pages as eight files of raw text, read back as bytes."""
    path = scratch(spark, "files") + "/files"
    pages = load(spark, sf, "pages").select((F.col("page_id") % 8).alias("bucket"), F.coalesce("html", F.lit("")).alias("html"))
    pages.repartition(8, "bucket").write.partitionBy("bucket").text(path)
    files = SF.read_files(spark, f"{path}/bucket=*", "*.txt")
    tags = F.length(F.regexp_replace(F.decode("content", "iso-8859-1"), "[^<]", ""))
    return files.groupBy(F.regexp_extract("path", "/bucket=([0-9]+)/", 1).cast("long").alias("bucket")).agg(
        F.count("*").cast("int").alias("n_files"), F.sum("length").alias("n_bytes"), F.sum(tags).cast("long").alias("n_tags")
    )


@query("s04_list_by_substring", "select url from pages where starts_with(url, 'https://') and contains(url, '/en/') and ends_with(url, '.html')")
def by_substring(spark, sf):
    return SF.list_by_substring(load(spark, sf, "pages"), "url", "https://", "/en/", ".html").select("url")


@query(
    "s05_list_subdirs",
    """select distinct split_part(substring(url, 9), '/', 1) as subdir from pages where starts_with(url, 'https://') and contains(substring(url, 9), '/') and split_part(substring(url, 9), '/', 1) <> ''""",
)
def subdirs(spark, sf):
    return SF.list_subdirs(load(spark, sf, "pages"), "url", "https:/" + "/")


_PREFIXES = "prefixes as (select page_id, regexp_extract(replace(url, 'http://', 'https://'), '^(https://[^/]*/[^/]*/)', 1) as prefix from pages)"


@query("s06_prefix_exists", with_ctes(_PREFIXES, "select page_id, prefix from prefixes p where exists (select 1 from pages g where prefix <> '' and starts_with(g.url, p.prefix))"))
def prefixes_exist(spark, sf):
    pages = load(spark, sf, "pages")
    wanted = pages.select(
        "page_id", F.regexp_extract(F.replace("url", F.lit("http://"), F.lit("https://")), "^(https://[^/]*/[^/]*/)", 1).alias("prefix")
    ).filter("prefix <> ''")
    return SF.existing_prefixes(wanted, "prefix", pages, "url").select("page_id", "prefix")


@query(
    "s07_object_meta",
    r"""select page_id, url_decode(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)) as key, md5(html) as etag, octet_length(html::blob)::bigint as length from pages""".replace("octet_length(html::blob)", "strlen(html)"),
)
def object_meta(spark, sf):
    return SF.object_meta(load(spark, sf, "pages"), "url", "html").select("page_id", "key", "etag", "length")


@query(
    "s07_object_type_and_time",
    r"""with k as (select page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) as key, html from pages),
t as (select *, lower(regexp_extract(key, '\.([A-Za-z0-9]+)$', 1)) as ending from k)
select page_id, case when ending in ('html', 'htm') then 'text/html' when ending = 'md' then 'text/markdown' when ending = 'txt' then 'text/plain' when ending = 'json' then 'application/json' when ending = 'pdf' then 'application/pdf'
  when ending = 'png' then 'image/png' when ending in ('jpg', 'jpeg') then 'image/jpeg' else 'application/octet-stream' end as content_type, md5(html) as etag, page_id * 1000000 as modified_us from t""",
)
def object_type(spark, sf):
    found = SF.object_meta(load(spark, sf, "pages"), "url", "html", F.timestamp_seconds("page_id"))
    return found.select("page_id", "content_type", "etag", F.unix_micros("modified").alias("modified_us"))


@query(
    "s08_load_code_table",
    """select p_brand as code_category, p_partkey::varchar as key_code, p_name as key_name from part where p_size % 7 <> 0 and p_size % 5 <> 0""",
)
def code_table(spark, sf):
    rows = load(spark, sf, "part").select(
        F.col("p_brand").alias("code_category"), F.col("p_partkey").alias("key_code"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("key_name"),
        F.when(F.col("p_size") % 7 == 0, "Y").when(F.col("p_size") % 2 == 0, "N").alias("is_deleted"),
    )
    return SS.load_code_table(rows)


@query(
    "s09_latest_containing",
    """select '"cust":' || o_custkey || ',' as needle, max(o_orderkey) as id, arg_max('{"cust":' || o_custkey || ',"status":"' || o_orderstatus || '"}', o_orderkey) as body
from orders where o_custkey in (select c_custkey from customer) group by o_custkey""",
)
def latest_containing(spark, sf):
    stored = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.to_json(F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))).alias("body"),
    )
    needles = load(spark, sf, "customer").select(F.concat(F.lit('"cust":'), F.col("c_custkey").cast("string"), F.lit(",")).alias("needle"))
    return SS.latest_containing(stored, needles, "needle")


@query(
    "s10_append_run",
    """select '{"order":' || o_orderkey || '}' as input_json, '{"status":"' || o_orderstatus || '"}' as output_json, count(*) as n
from (select * from orders union all select * from orders where o_orderstatus = 'F') group by all""",
)
def append_run(spark, sf):
    path = scratch(spark, "runs") + "/runs"
    orders = load(spark, sf, "orders")
    for part in (orders, orders.filter("o_orderstatus = 'F'")):
        rows = part.select(
            F.struct(F.col("o_orderkey").alias("order")).alias("input"), F.struct(F.col("o_custkey").alias("prompt")).alias("prompts"),
            F.struct(F.col("o_orderstatus").alias("status")).alias("output"), F.col("o_orderdate").alias("at"),
        )
        SS.append_rows(SS.run_record(rows, F.col("at")), path)
    return spark.read.parquet(path).groupBy("input_json", "output_json").agg(F.count("*").alias("n"))


@query("s11_batch_insert", "select c_mktsegment, count(*) as n, sum(c_custkey)::bigint as keys from customer group by c_mktsegment")
def batch_insert(spark, sf):
    path = scratch(spark, "insert") + "/rows"
    SS.append_rows(load(spark, sf, "customer"), path)
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query(
    "s12_enabled_mapping",
    """select s_nationkey as tenant, s_suppkey as key, s_name as value from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey <> 2 and n_nationkey % 4 <> 1)""",
)
def enabled_mapping(spark, sf):
    tenants = load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("tenant"), F.when(F.col("n_regionkey") != 2, "Y").otherwise("N").alias("enabled"),
        F.when(F.col("n_nationkey") % 4 == 1, "Y").otherwise("N").alias("is_deleted"),
    )
    config = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("tenant"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    return SS.enabled_mapping(config, tenants, "tenant")


@query("s13_write_artifacts", "select source as policy_no, count(*) as n_chunks, sum(n_chars)::bigint as n_chars from documents group by source")
def write_artifacts(spark, sf):
    root = scratch(spark, "artifacts")
    docs = load(spark, sf, "documents").select(
        F.col("source").alias("policy_no"), F.lit("v1").alias("signature"), F.col("doc_id").alias("original_index"), F.col("text").alias("page_content"), "n_chars"
    )
    SF.write_artifacts(spark, root, chunks=docs)
    stored = spark.read.parquet(f"{root}/chunks").filter("signature = 'v1'")
    return stored.groupBy("policy_no").agg(F.count("*").alias("n_chunks"), F.sum("n_chars").alias("n_chars"))


@query(
    "s13_write_all_artifacts",
    with_ctes(MD_DOCS, MD_CHUNKS, """
parts as (select doc_id, 'chunks' as kind, md5(page_content) as h from md_chunks union all select doc_id, 'catalog', md5(original_index || ':' || structure_path) from md_chunks where structure_path <> ''
  union all select doc_id, 'parsed', md5(md) from md_docs union all select doc_id, 'metadata', md5('{"n_chars":' || length(md) || ',"kind":"md"}') from md_docs)""", """
select doc_id::varchar as policy_no, kind, count(*) as n, md5(string_agg(h, '' order by h)) as digest from parts group by all"""),
)
def all_artifacts(spark, sf):
    """Headings, whole text, chunks and a record of each document, written by kind and read back."""
    root = scratch(spark, "artifacts")
    docs = md_docs(spark, sf).select("doc_id", "md")
    chunks = cut_lineage(md_chunks(spark, sf))
    kinds = {
        "chunks": chunks.select("doc_id", F.col("page_content").alias("body")),
        "catalog": chunks.filter("structure_path <> ''").select("doc_id", F.concat_ws(":", F.col("original_index").cast("string"), "structure_path").alias("body")),
        "parsed": docs.select("doc_id", F.col("md").alias("body")),
        "metadata": docs.select("doc_id", F.to_json(F.struct(F.length("md").alias("n_chars"), F.lit("md").alias("kind"))).alias("body")),
    }
    SF.write_artifacts(spark, root, **{
        kind: rows.select(F.col("doc_id").cast("string").alias("policy_no"), F.lit("v1").alias("signature"), "body") for kind, rows in kinds.items()
    })
    schema, stored = "body string, policy_no string, signature string", None
    for kind in kinds:
        rows = spark.read.schema(schema).parquet(f"{root}/{kind}").select("policy_no", F.lit(kind).alias("kind"), F.md5("body").alias("h"))
        stored = rows if stored is None else stored.unionByName(rows)
    return stored.groupBy("policy_no", "kind").agg(
        F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("h")), "")).alias("digest")
    )


@query("i01_filename_from_url", r"""select page_id, nullif(url_decode(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([^/]*)$', 1)), '') as file_name from pages""")
def filenames(spark, sf):
    return load(spark, sf, "pages").select("page_id", urls.filename_from_url(F.col("url")).alias("file_name"))


@query(
    "i02_exact_dedup",
    "select doc_id, md5(text) as content_md5 from documents qualify row_number() over (partition by md5(text) order by n_chars, doc_id desc) = 1",
)
def dedup(spark, sf):
    docs = load(spark, sf, "documents").withColumn("ord", -F.col("doc_id"))
    return I.exact_dedup(docs, "text", ["n_chars", "ord"]).select("doc_id", "content_md5")


_LINKS = r"""links as (select distinct page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']*)["'']', 1)) as link from pages)"""


@query("i03_extract_links", with_ctes(_LINKS, "select page_id, link from links where contains(link, 'en')"))
def links(spark, sf):
    return I.extract_links(load(spark, sf, "pages"), "page_id", "html", "en")


@query(
    "i04_expand_one_hop",
    with_ctes(_LINKS, """
store as (select '/' || split_part(text, ' ', 1) as url, text as content from documents)""", """
joined as (select url, html as content, page_id as ord, '01' as file_class, 0 as source_rank from pages union all
  select s.url, s.content, w.ord, '附件下载', 1 from store s join (select link, min(page_id) as ord from links where contains(link, 'e') group by link) w on w.link = s.url)""", """
select url, ord, file_class, source_rank, md5(content) as content_md5 from joined qualify row_number() over (partition by md5(content) order by source_rank, ord, url) = 1"""),
)
def one_hop(spark, sf):
    pages = load(spark, sf, "pages")
    found = I.extract_links(pages, "page_id", "html", "e").withColumnRenamed("page_id", "ord")
    # All documents that begin with a word are stored under its url.
    store = load(spark, sf, "documents").select(
        F.concat(F.lit("/"), F.split_part("text", F.lit(" "), F.lit(1))).alias("url"), F.col("text").alias("content")
    )
    listed = pages.select("url", F.col("html").alias("content"), F.col("page_id").alias("ord"), F.lit("01").alias("file_class"))
    return I.expand_one_hop(listed, found, store).select("url", "ord", "file_class", "source_rank", "content_md5")


@query(
    "i05_corpus_signature",
    """
with tokens as (select source, 'doc_' || doc_id || ':' || md5(text) as token from documents where text is not null),
digests as (select source, left(md5(token), 3) as bucket, count(*) as n, md5(string_agg(token, '|' order by token)) as digest from tokens group by all)
select source as policy_no, sum(n)::bigint as n_files, md5(string_agg(digest, '|' order by bucket)) as signature from digests group by source""",
)
def signatures(spark, sf):
    files = load(spark, sf, "documents").select(
        F.col("source").alias("policy_no"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.md5("text").alias("etag")
    )
    return I.corpus_signature(files, "policy_no", "name", "etag")


@query(
    "i05_unsigned_policies",
    "select o_custkey as policy_no, count(*) as n_files from orders group by o_custkey having count(*) filter (where o_orderstatus = 'P') = 0",
)
def unsigned(spark, sf):
    files = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("policy_no"), F.when(F.col("o_orderstatus") == "P", F.md5(F.col("o_orderkey").cast("string"))).alias("etag")
    )
    return I.unsigned_policies(files, "policy_no", "etag")


_ENTRIES = """
entries as (select o_custkey as policy_no, o_orderkey as signature, unnest(case o_orderkey % 4 when 0 then ['catalog', 'parsed', 'chunks'] when 1 then ['catalog', 'chunks'] when 2 then ['parsed'] else ['catalog', 'catalog', 'parsed', 'chunks'] end) as kind from orders)
"""


@query(
    "i06_plan_work",
    with_ctes(_ENTRIES, "select o_custkey as policy_no, o_orderkey as signature from orders o where o_orderkey not in (select signature from entries group by signature, policy_no having count(distinct kind) >= 3)"),
)
def work(spark, sf):
    corpora = load(spark, sf, "orders").select(F.col("o_custkey").alias("policy_no"), F.col("o_orderkey").alias("signature"))
    kinds = F.element_at(
        F.array(
            F.array(F.lit("catalog"), F.lit("parsed"), F.lit("chunks")), F.array(F.lit("catalog"), F.lit("chunks")),
            F.array(F.lit("parsed")), F.array(F.lit("catalog"), F.lit("catalog"), F.lit("parsed"), F.lit("chunks")),
        ),
        (F.col("signature") % 4 + 1).cast("int"),
    )
    return I.plan_work(corpora, corpora.withColumn("kind", F.explode(kinds)), ["policy_no", "signature"])


@query(
    "i07_latest_version",
    """with v as (select o_custkey as policy_no, o_orderkey as signature, case when o_custkey % 3 = 0 or o_orderkey % 5 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00+08:00' end as created_at, o_orderdate as file_time from orders)
select policy_no, signature from v qualify row_number() over (partition by policy_no order by created_at is null, created_at desc, file_time desc, signature desc) = 1""",
)
def latest(spark, sf):
    entries = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("policy_no"), F.col("o_orderkey").alias("signature"),
        F.when(
            (F.col("o_custkey") % 3 != 0) & (F.col("o_orderkey") % 5 != 0), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00+08:00"))
        ).alias("created_at"),
        F.col("o_orderdate").alias("file_time"),
    )
    return I.latest_version(entries, "policy_no")


@query(
    "i08_derive_policy_no",
    """select c_custkey, case when c_custkey % 2 = 1 then c_name else 'individual_' || codes end as policy_no from customer join
 (select o_custkey, string_agg(distinct o_orderpriority, '_' order by o_orderpriority) as codes from orders group by o_custkey) on o_custkey = c_custkey""",
)
def policy_numbers(spark, sf):
    plans = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("codes"))
    kind = F.when(F.col("c_custkey") % 2 == 1, "2").otherwise("1")
    return load(spark, sf, "customer").join(plans, "c_custkey").select("c_custkey", I.derive_policy_no(kind, F.col("c_name"), F.col("codes")).alias("policy_no"))


@query(
    "i09_file_class_text",
    """select doc_id, case code when '01' then '协议文档' when '02' then '特别约定文档' when '03' then '条款文档' when '04' then '其他文档' when '附件下载' then '附件下载文档' else code end as file_class
from (select doc_id, ['01', '02', '03', '04', '附件下载', '99'][(doc_id % 6 + 1)::int] as code from documents)""",
)
def class_texts(spark, sf):
    return load(spark, sf, "documents").select("doc_id", I.file_class_text(_class_code()).alias("file_class"))


def _class_code():
    return F.element_at(F.array(*[F.lit(c) for c in ("01", "02", "03", "04", "附件下载", "99")]), (F.col("doc_id") % 6 + 1).cast("int"))


_MERGED = """
merged as (select conv_id, string_agg('# FILE: turn_' || turn || '.md' || case turn % 3 when 0 then ' | 条款文档' when 1 then '' else ' | x' end || chr(10) || chr(10) || text || chr(10) || chr(10), '' order by turn, role, text) as merged from conversations group by conv_id)
"""


def _merged(spark, sf):
    files = load(spark, sf, "conversations").select(
        "conv_id", "turn", "role", "text", F.concat(F.lit("turn_"), F.col("turn").cast("string"), F.lit(".PDF")).alias("file_name"),
        F.when(F.col("turn") % 3 == 0, "03").when(F.col("turn") % 3 == 2, "x").alias("file_class"),
    )
    return I.merge_docs(files, "conv_id", ["turn", "role", "text"])


@query("i10_merge_docs", with_ctes(_MERGED, "select conv_id, merged from merged"))
def merged(spark, sf):
    return _merged(spark, sf)


@query(
    "i11_append_typed_texts",
    with_ctes(_MERGED, """
select conv_id, merged || '# 特别约定如下：' || chr(10) || 'note ' || conv_id || '# 协议补充如下：' || chr(10) as merged from merged"""),
)
def typed_texts(spark, sf):
    texts = F.array(
        F.struct(F.lit("特别约定").alias("kind"), F.concat(F.lit("note "), F.col("conv_id").cast("string")).alias("text")),
        F.struct(F.lit("其他").alias("kind"), F.lit("left out").alias("text")),
        F.struct(F.lit("协议").alias("kind"), F.lit(None).cast("string").alias("text")),
    )
    return _merged(spark, sf).select("conv_id", I.append_typed_texts(F.col("merged"), texts).alias("merged"))


_PAGES = """
turn_pages as (select conv_id, turn, case when conv_id % 7 = 0 then repeat('(cid:12)', turn::int + 40) || text else text end as text, case when conv_id % 11 = 0 then 0.9 else 0.1 end as cover from conversations
  union all select conv_id, turn, ' ' || chr(10), 0.0 from conversations, range(20) where conv_id % 5 = 0)
"""


def _turn_pages(spark, sf):
    """Whole texts as pages; every fifth conversation has twenty blank pages after each, every seventh undecodable characters."""
    turns = load(spark, sf, "conversations")
    text = F.when(F.col("conv_id") % 7 == 0, F.concat(F.repeat(F.lit("(cid:12)"), (F.col("turn") + 40).cast("int")), "text")).otherwise(F.col("text"))
    told = turns.select("conv_id", "turn", text.alias("text"), F.when(F.col("conv_id") % 11 == 0, 0.9).otherwise(0.1).alias("cover"))
    blank = turns.filter("conv_id % 5 = 0").select(
        "conv_id", "turn", F.explode(F.array_repeat(F.lit(" \n"), 20)).alias("text"), F.lit(0.0).alias("cover")
    )
    return told.unionByName(blank)


@query(
    "i12_classify_text_yield",
    with_ctes(_PAGES, r"""
stats as (select conv_id, count(*) as n_pages, sum(length(regexp_replace(text, '[\s\pZ]+', '', 'g')))::bigint as n_chars, sum(length(text)) as n_all,
   sum(len(regexp_extract_all(text, '\(cid:\d+\)'))) as n_bad, sum((cover >= 0.8)::int) as n_cov from turn_pages group by conv_id)""", """
select conv_id, n_pages, n_chars, case when n_chars < 50 * n_pages or n_bad * 20 > n_all or n_cov * 10 >= n_pages * 8 then 'ocr' else 'txt' end as kind from stats"""),
)
def text_yield(spark, sf):
    return I.classify_text_yield(_turn_pages(spark, sf), "conv_id", "text", "cover").select("conv_id", "n_pages", "n_chars", "kind")


@query(
    "i13_sample_pages",
    "select conv_id, turn from conversations qualify row_number() over (partition by conv_id order by md5(conv_id || ':' || turn), turn) <= 3",
)
def sampled(spark, sf):
    return I.sample_pages(load(spark, sf, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn")


@query("i14_page_range", "select conv_id, turn from conversations c where turn >= 2 and turn <= least(5, (select max(turn) from conversations d where d.conv_id = c.conv_id))")
def ranged(spark, sf):
    return I.page_range(load(spark, sf, "conversations"), "turn", 2, 5).select("conv_id", "turn")
