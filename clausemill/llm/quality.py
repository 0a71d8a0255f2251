"""Quality rules per document and per host.

A document fails by its own words; a host fails when too many of its documents do. A
host's failure rate is shrunk towards all hosts by a beta prior that is fitted to the
hosts' rates by the method of moments, so that few documents never condemn a host.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from clausemill.llm.common import arrow_batches, free_name, small_side, text_of

# White space between words, characters that count as symbols.
SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    max_host_rate: float = 0.5
    """A host goes when the shrunk share of its documents that fail is above this."""


def repeated_words(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that lie in windows found twice or more in it.

    ``codes`` numbers the words of all documents in a row, ``doc`` names each one's document (ascending).
    Equal hashes only choose windows that are then compared word by word.
    """
    n = len(codes) - WINDOW + 1
    if n < 2:
        return np.zeros(n_docs, dtype=np.int64)
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
        h ^= doc[:n].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    inside = inside[np.argsort(h[inside], kind="stable")]
    same = h[inside][1:] == h[inside][:-1]
    chosen = inside[np.append(same, False) | np.insert(same, 0, False)]
    if not len(chosen):
        return np.zeros(n_docs, dtype=np.int64)
    windows = np.column_stack([doc[chosen], *(codes[chosen + k] for k in range(WINDOW))])
    order = np.lexsort(windows.T[::-1])
    windows, chosen = windows[order], chosen[order]
    same = (windows[1:] == windows[:-1]).all(1)
    starts = chosen[np.append(same, False) | np.insert(same, 0, False)]
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n_docs)


def _counts_of(texts: list[str]) -> pd.DataFrame:
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at exactly SPACE
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    codes, _ = pd.factorize(np.array([x for w in words for x in w], dtype=object))
    dup_lines = []
    for t in texts:
        lines = [line for line in t.split("\n") if line.strip(SPACE)]
        dup_lines.append(len(lines) - len(set(lines)))
    return pd.DataFrame({
        "n_words": n_words,
        "word_chars": [len(t) - sum(map(t.count, SPACE)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": np.array(dup_lines, dtype=np.int64),
        "n_repeat_words": repeated_words(codes, np.repeat(np.arange(len(texts)), n_words), len(texts)),
    })


_CHARS_AT_ONCE = 2_000_000


def _counts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        done, some, chars = [], [], 0
        for t in texts:
            some.append(t)
            chars += len(t)
            if chars > _CHARS_AT_ONCE:
                done.append(_counts_of(some))
                some, chars = [], 0
        if some or not done:
            done.append(_counts_of(some))
        yield pd.concat(done, ignore_index=True)


def counts(text: str = "text") -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null text has no words."""
    return F.pandas_udf(_counts, _COUNTS)(text_of(text))


def base_failed(c: Column, rules: Rules) -> Column:
    return (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"])


def host_verdicts(failures: DataFrame, rules: Rules) -> DataFrame:
    """``(host, n, failed, rate, kept)`` of rows ``(host, failed boolean)``; a null host is a host like others."""
    hosts = failures.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failed")
    )
    p = F.col("failed") / F.col("n")
    # One row: the mean rate and its variance among hosts, weighted by their documents.
    m = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum("failed").alias("failed"),
        F.sum(F.col("n") * p * p).alias("square"),
    ).first()
    alpha, beta = prior(m["hosts"], m["n"] or 0, m["failed"] or 0, m["square"] or 0.0)
    rate = (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.withColumn("rate", rate).withColumn("kept", F.col("rate") <= rules.max_host_rate)


def prior(hosts: int, n: int, failed: int, square: float) -> tuple[float, float]:
    """Beta prior of the hosts' failure rates from moments: ``square`` is the sum of n * rate ** 2.

    The strength lies between 1 and 1,000 documents; without variance among hosts it is 1,000.
    """
    if not n:
        return 0.5, 0.5
    mean = failed / n
    within = mean * (1 - mean) * hosts / n  # what sampling alone adds to the variance
    variance = square / n - mean * mean - within
    strength = mean * (1 - mean) / variance - 1 if variance > 1e-12 else 1_000.0
    strength = min(1_000.0, max(1.0, strength))
    return max(mean * strength, 1e-6), max((1 - mean) * strength, 1e-6)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """``docs`` with a struct column (named by :func:`verdict_column`) of counts, base_failed, host_rate and kept.

    Each row is judged for itself, so repeated rows, null ids and extra columns of any name need no care.
    The counts are made twice, once for the hosts and once for the rows, which costs less
    than moving texts. No rows give no rows.
    """
    arrow_batches(docs.sparkSession)
    name = verdict_column(docs)
    c = F.col(name)
    judged = docs.select(F.col(host).cast("string").alias("host"), counts().alias(name))
    verdicts = host_verdicts(judged.select("host", base_failed(c, rules).alias("failed")), rules)
    on, rate, fine = (free_name(docs, f"{name}_{part}") for part in ("host", "rate", "kept"))
    side = verdicts.select(F.struct("host").alias(on), F.col("rate").alias(rate), F.col("kept").alias(fine))
    rows = docs.withColumn(name, counts())
    joined = rows.join(small_side(side), F.struct(F.col(host).cast("string").alias("host")) == F.col(on), "left")
    failed = base_failed(c, rules)
    verdict = F.struct(
        *(c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"), F.col(rate).alias("host_rate"),
        (~failed & F.col(fine)).alias("kept"),
    )
    return joined.withColumn(name, verdict).select(*docs.columns, name)


def verdict_column(docs: DataFrame) -> str:
    return free_name(docs, "quality_verdict")
