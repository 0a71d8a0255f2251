"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clausemill.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for every end of ``edges (a, b)``; the label is the smallest id that is connected.

    Each round takes the smallest label among neighbours and then the label's label, so the number of
    rounds grows with the logarithm of the longest path. Labels only fall; the loop ends when none does.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    labels = cut_lineage(labels)
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("id") == F.col("a")).select(
            "id", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        roots = labels.select(F.col("id").alias("root"), F.col("label").alias("root_label"))
        fresh = cut_lineage(hooked.join(roots, F.col("label") == F.col("root")).select(
            "id", "old", F.least("label", "root_label").alias("label")
        ))
        labels = fresh.select("id", "label")
        if fresh.filter("label < old").isEmpty():
            return labels
