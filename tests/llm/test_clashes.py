"""Extra columns with the operators' own names, and benchmark items shorter than the masks."""

from pyspark.sql import functions as F

from clausemill.llm import decontaminate, quality, sharding
from clausemill.llm.common import shared_folder
from tests.llm import brute

NAMES = ["quality_verdict", "quality_verdict_host", "quality_verdict_rate", "quality_verdict_kept", "text_key", "shard_name", "_shard_name", "seed", "item_key"]


def docs_of(spark, texts):
    docs = spark.createDataFrame([(i, t, f"host{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


def test_clashing_names(spark):
    docs = docs_of(spark, ["one two three " * 30, None, "", "a text of some twenty words " * 4, "held held2 held3 held4 held5 held6 held7 held8 held9"])
    rows = sorted(map(tuple, docs.collect()))
    judged = quality.quality_rules(docs)
    name = quality.verdict_column(docs)
    assert judged.columns == [*docs.columns, name] and sorted(map(tuple, judged.drop(name).collect())) == rows
    bench = spark.createDataFrame([(1, "held held2 held3 held4 held5 held6 held7 held8 held9")], "item_id long, text string")
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == rows[:4]
    folder = f"{shared_folder(spark, 'clash')}/shards"
    sharding.write_shards(docs, 60, folder)
    back = sharding.read_shards(spark, docs.schema, folder)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sharding.shards(docs, 60).collect()))
    assert sorted(tuple(r)[: len(docs.columns)] for r in spark.read.schema(docs.schema).parquet(folder).collect()) == rows


def test_short_items(spark):
    texts = ["zero one two three four five six seven eight", "One, TWO three-four five six seven", "one two three four five six other", "six seven", "seven", None, "", "one one two"]
    items = ["one two three four five six seven", "six seven", "one two three four five", "", None, "...", "one one two", "three four four five", "Seven six"]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.item_words, r.matched) for r in decontaminate.leaks(docs, bench).collect()}
    want = {(d, i, len(brute.plain_words(b)), len(brute.plain_words(b))) for d, t in enumerate(texts) for i, b in enumerate(items) if brute.is_leak(t, b)}
    assert got == want and (0, 0, 7, 7) in got and (1, 0, 7, 7) in got
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == sorted({d for d in range(len(texts))} - {d for d, *_ in want})
