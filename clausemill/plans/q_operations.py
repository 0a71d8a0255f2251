"""Registered queries for log reports, streams and hooks."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from clausemill.operators import call_logs as O, hooks as H, retrieval as R
from clausemill.operators.structure import split_oversize
from clausemill.plans import q_retrieval as QR
from clausemill.plans.fixtures import BOXES, boxes, with_ctes
from clausemill.plans.registry import query
from clausemill.plans.scratch import scratch
from clausemill.session import load
from clausemill.streaming import streams as K

_HOUR = 3_600_000_000


def calls(spark, sf):
    return load(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("model"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        (F.col("event_id") % 997).alias("prompt_tokens"), (F.col("event_id") % 313).alias("completion_tokens"), F.col("value").alias("latency_s"),
    )


@query(
    "o01_rolling_rate",
    f"""with c as (select event_id, event_type as model, epoch_us(ts) as ts from events)
select event_id, model, count(*) over (partition by model order by ts range between {_HOUR} preceding and current row) as hour, count(*) over (partition by model order by ts range between {6 * _HOUR} preceding and current row) as six_hours from c""",
)
def rolling(spark, sf):
    rates = O.rolling_rate(calls(spark, sf), "model", "ts", {"hour": _HOUR, "six_hours": 6 * _HOUR}, chunk=24 * _HOUR)
    return rates.select("event_id", "model", "hour", "six_hours")


@query(
    "o01_breaches",
    f"""with c as (select event_id, event_type as model, epoch_us(ts) as ts from events)
select event_id, hour from (select event_id, count(*) over (partition by model order by ts range between {_HOUR} preceding and current row) as hour from c) where hour > 4""",
)
def breaches(spark, sf):
    rates = O.rolling_rate(calls(spark, sf), "model", "ts", {"hour": _HOUR}, chunk=24 * _HOUR)
    return O.breaches(rates, {"hour": 4}).select("event_id", "hour")


@query(
    "o02_call_cost",
    """with c as (select event_type as model, event_id % 997 as p, event_id % 313 as t, case event_type when 'click' then 0.03 when 'purchase' then 0.0015 else case when contains(event_type, 'r') then 0.012 else 0.01 end end as pi,
  case event_type when 'click' then 0.06 when 'purchase' then 0.002 else case when contains(event_type, 'r') then 0.012 else 0.03 end end as po from events)
select model, round(sum(p / 1000.0 * pi::double), 4) as input_cost, round(sum(t / 1000.0 * po::double), 4) as output_cost from c group by model""",
)
def cost(spark, sf):
    prices = {"click": (0.03, 0.06), "purchase": (0.0015, 0.002), "r": (0.012, 0.012)}
    costed = O.call_cost(calls(spark, sf), "model", prices)
    return costed.groupBy("model").agg(F.round(F.sum("input_cost"), 4).alias("input_cost"), F.round(F.sum("output_cost"), 4).alias("output_cost"))


@query(
    "o03_slow_calls",
    "select event_type as model, count(*) as n, sum((value > 50)::int)::bigint as n_slow, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by 1",
)
def slow(spark, sf):
    return O.latency_report(calls(spark, sf), "model", "latency_s", 50.0)


@query(
    "o04_recall_report",
    with_ctes(*QR._ALL_ARMS, """
m as (select query_id, chunk, count(*) as k from arms group by all)""", """
select query_id, sum((arm = 'vector')::int)::bigint as vector, sum((arm = 'bm25')::int)::bigint as bm25, sum((arm = 'string_match')::int)::bigint as string_match, count(*) as n_hits,
  (select count(*) from m where m.query_id = a.query_id) as n_chunks, (select count(*) from m where m.query_id = a.query_id and k > 1) as n_shared, count(*) - (select count(*) from m where m.query_id = a.query_id) as n_dropped from arms a group by query_id"""),
)
def recall_report(spark, sf):
    from clausemill.session import cut_lineage

    arms = cut_lineage(QR.arms(spark, sf))
    return O.recall_report(arms, R.fuse_priority(arms))


@query("o05_cache_report", "select source, sum((doc_id in (select doc_id from labels))::int)::bigint as hits, sum((doc_id not in (select doc_id from labels))::int)::bigint as misses from documents group by source")
def cache_report(spark, sf):
    known = load(spark, sf, "labels").select("doc_id", F.lit(True).alias("known"))
    answers = load(spark, sf, "documents").select("doc_id", "source").join(known, "doc_id", "left")
    return O.cache_report(answers, "source", F.coalesce("known", F.lit(False)))


@query(
    "k01_stream_ingest",
    """select doc_id, case when n > 1 then k + 1 else 0 end as split_part, md5(substring(text, (k * 5800 + 1)::bigint, 6000)) as chunk_md5
from (select doc_id, text, case when length(text) <= 6000 then 1 else ceil((length(text) - 6000) / 5800.0)::int + 1 end as n from documents), unnest(range(0, n)) as u(k)""",
)
def stream_ingest(spark, sf):
    root = scratch(spark, "ingest")

    def operator(docs):
        rows = docs.select("doc_id", F.lit(0).alias("original_index"), F.lit(0).alias("split_part"), F.col("text").alias("page_content"))
        return split_oversize(rows).select("doc_id", "split_part", F.md5("page_content").alias("chunk_md5"))

    K.ingest(K.read_table_stream(spark, sf, "documents"), operator, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").drop("batch")


@query("k02_stream_dedup", "select distinct md5(text) as content_md5 from documents")
def stream_dedup(spark, sf):
    root = scratch(spark, "dedup")
    K.dedup_into(K.read_table_stream(spark, sf, "documents"), "text", ["doc_id"], f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").select("content_md5")


def event_stream(spark, sf):
    load(spark, sf, "events")
    return K.read_table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _counts(spark, stream, name, mode="complete"):
    root = scratch(spark, name)
    K.run_available(stream, K.batch_writer(f"{root}/out", mode), f"{root}/state", mode)
    return spark.read.parquet(f"{root}/out").select(
        F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "event_type", "n"
    )


_DAY = 24 * _HOUR


@query("k03_tumbling_counts", f"select epoch_us(ts) // {_HOUR} * {_HOUR} as start_us, epoch_us(ts) // {_HOUR} * {_HOUR} + {_HOUR} as end_us, event_type, count(*) as n from events group by all")
def tumbling(spark, sf):
    return _counts(spark, K.window_counts(event_stream(spark, sf), "event_type", "ts", "1 hour"), "tumbling")


@query(
    "k03_sliding_counts",
    f"select (epoch_us(ts) // {_HOUR} - k) * {_HOUR} as start_us, (epoch_us(ts) // {_HOUR} - k + 2) * {_HOUR} as end_us, event_type, count(*) as n from events, unnest([0, 1]) as u(k) group by all",
)
def sliding(spark, sf):
    return _counts(spark, K.window_counts(event_stream(spark, sf), "event_type", "ts", "2 hours", "1 hour"), "sliding")


@query(
    "k03_session_counts",
    f"""with e as (select event_type, epoch_us(ts) as t, case when epoch_us(ts) - lag(epoch_us(ts)) over w < 600000000 then 0 else 1 end as o from events window w as (partition by event_type order by ts, event_id)),
s as (select *, sum(o) over (partition by event_type order by t rows unbounded preceding) as g from e) select min(t) as start_us, max(t) + 600000000 as end_us, event_type, count(*) as n from s group by event_type, g""",
)
def sessions(spark, sf):
    return _counts(spark, K.session_counts(event_stream(spark, sf), "event_type", "ts", "10 minutes"), "sessions")


@query(
    "k04_closed_windows",
    f"select epoch_us(ts) // {_DAY} * {_DAY} as start_us, epoch_us(ts) // {_DAY} * {_DAY} + {_DAY} as end_us, event_type, count(*) as n from events group by all having epoch_us(max(ts)) // {_DAY} * {_DAY} + {_DAY} <= (select max(epoch_us(ts)) - {_HOUR} from events)",
)
def closed(spark, sf):
    return _counts(spark, K.window_counts(event_stream(spark, sf), "event_type", "ts", "1 day"), "closed", "append")


@query("k05_ttl_cache", with_ctes(QR._REPLAY, "select key, ts, hit from replayed"))
def ttl_stream(spark, sf):
    root = scratch(spark, "ttl")
    log = event_stream(spark, sf).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.unix_micros("ts").alias("ts"))
    K.run_available(K.ttl_cache(log, "key", "ts", QR._DAY), K.batch_writer(f"{root}/out"), f"{root}/state")
    return spark.read.parquet(f"{root}/out").select("key", "ts", F.col("hit").cast("int").alias("hit"))


@query("k06_stream_coding", "select event_id, case event_type when 'click' then 'C' when 'purchase' then 'P' end as code from events")
def coded(spark, sf):
    root = scratch(spark, "coded")
    static = load(spark, sf, "events").select("event_type").distinct().filter("event_type in ('click', 'purchase')").withColumn("code", F.upper(F.substring("event_type", 1, 1)))
    K.run_available(K.code_stream(event_stream(spark, sf), static, ["event_type"]).select("event_id", "code"), K.batch_writer(f"{root}/out"), f"{root}/state")
    return spark.read.parquet(f"{root}/out").select("event_id", "code")


@query(
    "u01_sql_functions",
    "select event_id, event_id % 90 as days, round(1 / (1 + value), 6) as similarity, 'title' as title from events",
)
def sql_functions(spark, sf):
    H.register_sql_functions(spark)
    load(spark, sf, "events").createOrReplaceTempView("cm_events")
    return spark.sql(
        "select event_id, cm_days(concat(event_id % 90, '天')) as days, round(cm_similarity(value), 6) as similarity, cm_strip_index_mark(concat('title [', event_id, ']')) as title from cm_events"
    )


@query("u02_score_with", "select doc_id, ('0x' || left(md5(text), 7))::bigint % 101 as score from documents")
def scored(spark, sf):
    def scorer(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pdf["doc_id"], "score": [int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % 101 for t in pdf["text"]]})

    return H.score_with(load(spark, sf, "documents").select("doc_id", "text"), scorer, "doc_id long, score long", 10)


@query("u03_box_union", with_ctes(BOXES, "select page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from boxes group by page"))
def union(spark, sf):
    return H.box_union(boxes(spark, sf), ["page"])


@query(
    "u04_table_function",
    """select doc_id, k as part, substring(text, (k * 5800 + 1)::bigint, 6000) as chunk
from (select doc_id, text, case when length(text) <= 6000 then 1 else ceil((length(text) - 6000) / 5800.0)::int + 1 end as n from documents), unnest(range(0, n)) as u(k)""",
)
def table_function(spark, sf):
    H.register_table_functions(spark)
    load(spark, sf, "documents").createOrReplaceTempView("cm_documents")
    return spark.sql("select doc_id, w.part, w.chunk from cm_documents, lateral cm_windows(text, 6000, 200) w")


@query("u05_per_page", with_ctes(BOXES, "select page, count(*) as n, max(y1) - min(y0) as height from boxes group by page"))
def hook(spark, sf):
    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page": [pdf["page"].iloc[0]], "n": [len(pdf)], "height": [pdf["y1"].max() - pdf["y0"].min()]})

    return H.per_page(boxes(spark, sf), ["page"], rule, "page long, n long, height long")
