"""Reply tables: rejects, stored answers, factor rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clausemill.functions import answers as A


def split_rejects(replies: DataFrame, reply: str) -> tuple[DataFrame, DataFrame]:
    """``(parseable, rejected)`` replies; nothing is repaired, nothing is lost."""
    ok = A.is_json(A.fenced_json(F.col(reply)))
    return replies.filter(ok), replies.filter(~ok)


def factor_rows(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """One row per answer; the first updates the asked factor, later ones add to it."""
    return replies.select(key, F.posexplode(A.factor_answers(F.col(reply))).alias("pos", "a")).select(
        key, "pos", "a.*", F.when(F.col("pos") == 0, "update").otherwise("add").alias("action")
    )


def reuse_answers(asked: DataFrame, responses: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """``(answered, open)``: questions with a stored reply, and the work list without one."""
    stored = responses.groupBy(key).agg(F.min("reply").alias("reply"))
    return asked.join(stored, key), asked.join(stored, key, "left_anti")


def dedup_rows(rows: DataFrame, group: list[str], json_key: str, order: list[str]) -> DataFrame:
    """First row per group and key-sorted JSON; the rank limit runs before the shuffle too."""
    w = Window.partitionBy(*group, json_key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
