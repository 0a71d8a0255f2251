"""Benchmark passages in documents, found by spaced seeds and verified word by word.

A mask says which of a few neighbouring words a seed hashes; the others may differ. Seeds
of benchmark items and of documents meet in a join, each hit names a diagonal (document
position less item position), and on that diagonal the item is compared with the document
word for word. Everything is DataFrame functions: neighbours come from zipped slices of
the word array, so hashing and joining stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clausemill.functions.binding import let
from clausemill.llm.common import free_name, small_side, stored, text_of

# Fixed masks: 1 is a word that must match, 0 one that may differ.
MASKS = ("1101011", "11100101")
SPAN = max(map(len, MASKS))
MISMATCH = 4  # a mismatch costs as much as four matches earn: segments keep four matches of five
MIN_SHARE = 0.8
SEGMENT = 13


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(*keys, pos, seed)`` at every position of every text, for all masks.

    At the end of a text, words beyond it count as null; a seed with such a word isn't made.
    """
    codes = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    shifted = let(codes, lambda c: F.arrays_zip(
        F.transform(c, lambda _, i: i).alias("pos"),
        *(F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0))).alias(f"w{k}") for k in range(SPAN)),
    ))
    rows = rows.select(*keys, F.inline(shifted).alias("pos", *(f"w{k}" for k in range(SPAN))))
    made = []
    for n, mask in enumerate(MASKS):
        used = [F.col(f"w{k}") for k, bit in enumerate(mask) if bit == "1"]
        made.append(F.when(F.col(f"w{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(n), *used)))
    return rows.select(*keys, "pos", F.explode(F.array(*made)).alias("seed")).filter(F.col("seed").isNotNull())


def _overlap(document: Column, item: Column, diagonal: Column) -> Column:
    """Struct (matched, segment): equal words on the diagonal, and those of its best stretch."""
    start = F.greatest(diagonal, F.lit(0))
    skip = start - diagonal
    n = F.greatest(F.least(F.size(item) - skip, F.size(document) - start), F.lit(0))
    same = F.zip_with(F.slice(document, start + 1, n), F.slice(item, skip + 1, n), lambda a, b: a == b)
    zero = F.struct(*(F.lit(0).alias(k) for k in ("score", "run", "segment", "matched")))

    def step(s: Column, equal: Column) -> Column:
        score = F.when(equal, s["score"] + 1).otherwise(F.greatest(s["score"] - MISMATCH, F.lit(0)))
        run = F.when(equal, s["run"] + 1).otherwise(F.when(s["score"] > MISMATCH, s["run"]).otherwise(F.lit(0)))
        return F.struct(
            score.alias("score"), run.alias("run"),
            F.greatest(s["segment"], run).alias("segment"), (s["matched"] + equal.cast("int")).alias("matched"),
        )

    return F.aggregate(same, zero, step)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(text_key, item_id, item_words, matched, segment)``: texts (by MD5) and the items they hold.

    An item is held if on one diagonal at least ``MIN_SHARE`` of its words are equal, or a
    stretch with four matches of five has ``SEGMENT`` equal words. Items with equal words count once,
    under their smallest id (null is smallest). Items of fewer words than the longest mask are held
    where they stand word for word; items without words nowhere. Null texts have no words. Empty
    tables give no rows.
    """
    items = benchmark.select(F.col("item_id"), words(text_of()).alias("item"))
    items = items.groupBy("item").agg(F.min(F.struct("item_id")).alias("id")).select(
        F.col("id.item_id").alias("item_id"), "item", F.array_join("item", " ").alias("item_text")
    ).withColumn("item_key", F.md5("item_text")).filter(F.size("item") > 0)
    items = stored(items, "items")
    short, items = items.filter(F.size("item") < SPAN), items.filter(F.size("item") >= SPAN)
    test = seeds(items, ["item_key"], "item_text").select("seed", "item_key", F.col("pos").alias("item_pos"))
    train = seeds(docs.select(F.md5(text_of()).alias("text_key"), text_of().alias("text")), ["text_key"], "text")
    hits = train.join(small_side(test.distinct()), "seed").select(
        "text_key", "item_key", (F.col("pos") - F.col("item_pos")).alias("diagonal")
    )
    hits = stored(hits.distinct(), "hits")
    held = hits.groupBy("text_key", "item_key").agg(F.collect_list("diagonal").alias("diagonals"))
    found = docs.select(F.md5(text_of()).alias("text_key"), text_of().alias("text")).join(
        small_side(hits.select("text_key").distinct()), "text_key", "left_semi"
    )
    # A text that several rows share is verified once.
    found = found.dropDuplicates(["text_key"]).withColumn("document", words(F.col("text"))).drop("text")
    pairs = found.join(held, "text_key").join(small_side(items.select("item_key", "item_id", "item")), "item_key")
    checked = pairs.withColumn("o", let(F.col("document"), lambda d: let(F.col("item"), lambda i: F.aggregate(
        F.col("diagonals"), F.struct(F.lit(0).alias("matched"), F.lit(0).alias("segment")),
        lambda best, g: let(_overlap(d, i, g), lambda o: F.struct(
            F.greatest(best["matched"], o["matched"]).alias("matched"), F.greatest(best["segment"], o["segment"]).alias("segment"),
        )),
    ))))
    long_ones = checked.select(
        "text_key", "item_id", F.size("item").alias("item_words"), "o.matched", "o.segment"
    ).filter((F.col("matched") >= MIN_SHARE * F.col("item_words")) | (F.col("segment") >= SEGMENT))
    return long_ones.unionByName(_verbatim(docs, short))


def _verbatim(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Texts that hold all words of a short item in a row: their runs of that many words meet the items by equality."""
    sizes = sorted(r[0] for r in items.select(F.size("item").alias("n")).distinct().collect())  # fewer than SPAN
    texts = docs.select(F.md5(text_of()).alias("text_key"), words(text_of()).alias("document"))

    def runs(n: int):
        every = F.transform(F.sequence(F.lit(1), F.size("document") - n + 1), lambda i: F.array_join(F.slice("document", i, n), " "))
        return F.when(F.size("document") >= n, every).otherwise(F.array().cast("array<string>"))

    run = F.explode(F.array_distinct(F.flatten(F.array(*(runs(n) for n in sizes))))) if sizes else F.lit(None).cast("string")
    texts = texts.select("text_key", run.alias("item_text")) if sizes else texts.select("text_key", run.alias("item_text")).limit(0)
    n = F.size("item").alias("item_words")
    return texts.distinct().join(small_side(items.select("item_text", "item_id", "item")), "item_text").select(
        "text_key", "item_id", n, F.size("item").alias("matched"), F.size("item").alias("segment")
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, item_words, matched, segment)``: a row for each document and item it holds."""
    found = contaminated(docs, benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_of()).alias("text_key")).distinct()
    return rows.join(found, "text_key").drop("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, whatever their names."""
    name = free_name(docs, "text_key")
    found = contaminated(docs, benchmark).select(F.col("text_key").alias(name)).distinct()
    return docs.join(small_side(found), F.md5(text_of()) == F.col(name), "left_anti")
