"""Registered queries of the training-data operators, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from clausemill.llm import (
    classifier, decontaminate, lexical, line_dedup, near_dedup, packing, quality, records, runs, sharding, suffix_dedup, url_filter, warc,
)
from clausemill.llm.common import shared_folder
from clausemill.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SHARD_BYTES = 16 << 20
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_best_fit_packing")
def best_fit_packing(spark, sf):
    return packing.packed_rows(load(spark, sf, "documents"), BYTE_BPE)


@query("op2_minhash_near_dedup")
def minhash_near_dedup(spark, sf):
    return near_dedup.near_duplicates(load(spark, sf, "documents"))


@query("op3_benchmark_decontamination")
def benchmark_decontamination(spark, sf):
    return decontaminate.leaks(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


@query("op4_suffix_array_dedup")
def suffix_array_dedup(spark, sf):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return suffix_dedup.suffix_dedup(load(spark, sf, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op5_url_filters")
def url_filters(spark, sf):
    pages, labels = load(spark, sf, "pages"), load(spark, sf, "labels")
    # A page's path ends with the number of the document it shows; labels are by document.
    doc = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    pages = pages.select("page_id", "url", F.when(doc != "", doc).cast("long").alias("shows"))
    good = labels.groupBy(F.col("doc_id").alias("shows")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    found = url_filter.url_verdicts(pages.join(good, "shows", "left"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template")


@query("op6_line_dedup")
def content_defined_line_dedup(spark, sf):
    return line_dedup.run_dedup(load(spark, sf, "documents").select("doc_id", "text", "n_chars")).select(
        "doc_id", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")
    )


@query("op7_token_id_output")
def token_id_output(spark, sf):
    folder = shared_folder(spark, "records")
    records.write(load(spark, sf, "documents"), folder, WORD_BPE)
    found = records.read(records.index(spark, folder), folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# Words are split at the six characters, so that SQL, like the operator, sees no other white space.
_QUALITY_SQL = r"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
w as (select doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
p as (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8),
g as (select doc_id, i, array_to_string(words[i:i+7], ' ') as gram from p),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, gram) > 1),
c as (select doc_id, count(distinct i + k) as n from r, range(8) as t(k) group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
u as (select doc_id, count(*) - count(distinct line) as n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
b as (select w.doc_id, host, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(u.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
  from w left join u using (doc_id) left join c using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b),
h as (select host, count(*) as n, sum(base_failed::bigint) as failed from f group by host),
m as (select count(*) as hosts, sum(n) as n, sum(failed) as failed, sum(failed::double * failed / n) as square from h),
v as (select *, failed / n as mean, square / n - (failed / n) * (failed / n) - (failed / n) * (1 - failed / n) * hosts / n as variance from m),
s as (select mean, least(1000.0, greatest(1.0, case when variance > 1e-12 then mean * (1 - mean) / variance - 1 else 1000.0 end)) as strength from v),
k as (select host, (failed + greatest(mean * strength, 1e-6)) / (n + greatest(mean * strength, 1e-6) + greatest((1 - mean) * strength, 1e-6)) <= 0.5 as host_kept from h, s)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and host_kept as kept from f join k using (host)
"""


@query("op8_quality_rules", _QUALITY_SQL)
def quality_rules(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "source", "text")
    name = quality.verdict_column(docs)
    return quality.quality_rules(docs).select(
        "doc_id", *(f"{name}.{k}" for k in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    )


_PREFIX = "array_to_string(list_transform(string_split(md5(concat(coalesce(doc_id::varchar, ''), '|', coalesce(text, '')))[1:15], ''), lambda x: right(bin(('0x' || x)::int + 16), 4)), '')"


@query(
    "op9_extendible_sharding",
    f"""with recursive d as (select doc_id, strlen(coalesce(text, '')) as n_bytes, {_PREFIX} as bits from documents),
t(depth, shard, shard_bytes) as (
  select 0, '', sum(n_bytes)::bigint from d
  union all
  select t.depth + 1, d.bits[1:t.depth + 1], sum(d.n_bytes)::bigint from t join d on d.bits[1:t.depth] = t.shard
  where t.shard_bytes > {SHARD_BYTES} and t.depth < 60 group by t.depth, d.bits[1:t.depth + 1])
select doc_id, n_bytes::bigint as n_bytes, shard, depth, shard_bytes from d join t on d.bits[1:t.depth] = t.shard
where t.shard_bytes <= {SHARD_BYTES} or t.depth = 60""",
)
def extendible_sharding(spark, sf):
    docs, folder = load(spark, sf, "documents"), f"{shared_folder(spark, 'shards')}/shards"
    sharding.write_shards(docs, SHARD_BYTES, folder)
    return sharding.read_shards(spark, docs.schema, folder)


@query(
    "op10_warc",
    """with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_digest, max(page_id) as last from p where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, p.payload_digest, case when last is not null and last is distinct from page_id then 'revisit' else 'response' end as record_type,
  case when last is distinct from page_id then last end as refers_to from p left join m using (payload_digest)""",
)
def warc_archives(spark, sf):
    folder = shared_folder(spark, "warc")
    warc.write(warc.typed(load(spark, sf, "pages")), folder)
    found = warc.read(spark.read.schema("file string, bytes long").parquet(f"{folder}/manifest"), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _echoed(docs):
    """``(doc_id, text)``; where the id's checksum says so, the text's words repeat from some place on to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(F.pmod(h, F.lit(10)) == 0, words).alias("words"))
    n, g = F.size("words"), F.col("g")
    rows = rows.select("*", n.alias("n"), F.when(n > 0, F.pmod(g, n).cast("int")).alias("a"))
    rest = F.col("n") - F.col("a")
    rows = rows.select("*", (F.floor(rest / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int").alias("p"))
    # A period of more words than are left is cut with the rest.
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    told = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, told).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def periodic_runs(spark, sf):
    docs = _echoed(load(spark, sf, "documents"))
    name = runs.runs_column(docs)
    found = runs.periodic_runs(docs).select("doc_id", f"{name}.runs", f"{name}.collapsed")
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = found.select("*", runs.strongest(F.col("runs")).alias("best"))
    milli = 1000 * F.col("best.length")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        ((milli - F.pmod(milli, F.col("best.period"))) / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def held_out():
    """Whether a document's label is kept for the test."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@query("op13_quality_classifier")
def quality_classifier(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    labels = load(spark, sf, "labels").filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    net = classifier.fit(docs, labels)
    scored = classifier.score(docs, net).withColumnRenamed(classifier.score_column(docs), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


_TERMS = r"regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_LOWER = "translate(unnest(%s), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" % _TERMS


@query(
    "op12_ranked_lexical_search",
    f"""with t as (select doc_id, {_LOWER} as term from documents),
p as (select doc_id, term, count(*) as tf from t group by all),
d as (select doc_id, sum(tf)::bigint as n from p group by doc_id),
s as (select count(*) as n_docs, sum(n)::bigint as n_terms from d),
z as (select doc_id, 25 + (75 * n * n_docs) // n_terms as m from d, s),
f as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w from p, s group by term),
q as (select item_id, term, count(*) as times from (select item_id, {_LOWER} as term from benchmark) group by all),
r as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from q join f using (term) join p using (term) join z using (doc_id) group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from r where score > 0 qualify rank <= 10""",
)
def ranked_lexical_search(spark, sf):
    index = lexical.build_index(load(spark, sf, "documents"), f"{shared_folder(spark, 'lexical')}/index")
    return lexical.search(index, load(spark, sf, "benchmark")).select("item_id", "rank", "doc_id", "score")


@query("pipeline")
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
