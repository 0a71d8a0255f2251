"""Runs of repeated words: maximal stretches with a period, found from Lyndon arrays.

Baier's suffix sorter begins by grouping suffixes: from the greatest group down, each
group tells the nearest smaller suffix on its left to append the group's context to
its own. When all groups are done, a suffix's context is the longest Lyndon word that
starts there, so the grouping itself yields the Lyndon array. It runs once with the
words in some order and once in the opposite one; the two arrays hold a Lyndon root of
every run, and a root grows into its run by longest common extensions both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from clausemill.llm.common import arrow_batches, free_name, text_of

MIN_LENGTH, MIN_COPIES = 6, 4
CHARS_AT_ONCE = 1_000_000

FOUND = "starts array<long>, lengths array<long>, periods array<long>, n_words long, collapsed string"


def lyndon_lengths(codes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each position.

    ``codes`` are words as numbers; 0 stands before, between and after texts and is
    less than every word, so that no Lyndon word leaves its text. Positions of a group
    are kept in ascending order, and positions of finished groups are taken out of a
    linked list: what is then left of a position is its nearest smaller suffix.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    ends = np.flatnonzero(np.diff(codes[order])) + 1
    ends = [0, *ends.tolist(), n]
    group = np.empty(n, dtype=np.int64)
    group[order] = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = order.tolist()
    members = [order[a:b] for a, b in zip(ends, ends[1:])]
    group = group.tolist()
    context = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    found = [1] * n
    g = len(members) - 1
    while g > 0:
        size = context[g]
        asked = []  # (times, position): each position that is nearest smaller for a stretch of the group
        last, times = 0, 0
        for i in members[g]:
            if group[i] != g:
                continue  # moved to a greater group before
            found[i] = size
            p, r = left[i], right[i]
            right[p] = r
            left[r] = p
            if p == last:
                times += 1
            else:
                if group[last]:
                    asked.append((times, last))
                last, times = p, 1
        if group[last]:
            asked.append((times, last))
        if len(asked) == 1:
            times, p = asked[0]
            groups = [(times, group[p], [p])]
        else:
            by_group: dict[tuple[int, int], list[int]] = {}
            for times, p in asked:
                by_group.setdefault((times, group[p]), []).append(p)
            groups = sorted(((*key, positions) for key, positions in by_group.items()), key=lambda x: -x[0])
        for times, old, positions in groups:  # more copies first, so that they end up higher
            new = len(context)
            context.append(context[old] + times * size)
            members.append(positions)
            for p in positions:
                group[p] = new
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            below[up] = new
        members[g] = None
        g = below[g]
    return np.array(found, dtype=np.int64)


def eligible(codes: np.ndarray, min_length: int, min_copies: int) -> np.ndarray:
    """``codes`` with 0 for words that no run can hold, by counts alone.

    Every word of a run stands in it ``min_copies`` times, so a run lies wholly between
    words that are rarer in their stretch. Cutting at those, and dropping stretches below
    ``min_length``, is repeated on what is left. No run is cut, and none loses a neighbour
    that would extend it: that neighbour would be a word of the run.
    """
    at = np.flatnonzero(codes)
    while len(at):
        breaks = np.flatnonzero(np.diff(at) > 1) + 1
        lengths = np.diff(np.concatenate(([0], breaks, [len(at)])))
        stretch = np.repeat(np.arange(len(lengths)), lengths)
        word, _ = pd.factorize(stretch * (codes.max() + 1) + codes[at])
        keep = (np.bincount(word)[word] >= min_copies) & (lengths[stretch] >= min_length)
        if keep.all():
            break
        at = at[keep]
    out = np.zeros_like(codes)
    out[at] = codes[at]
    return out


def common_extension(codes: np.ndarray, a: int, b: int, step: int) -> int:
    """Number of equal words from ``a`` and ``b`` on, rightwards (step 1) or leftwards (step -1)."""
    done, width = 0, 16
    limit = len(codes) - b if step > 0 else a + 1
    while done < limit:
        take = min(width, limit - done)
        if step > 0:
            x, y = codes[a + done : a + done + take], codes[b + done : b + done + take]
        else:
            x, y = codes[a - done - take + 1 : a - done + 1][::-1], codes[b - done - take + 1 : b - done + 1][::-1]
        differs = x != y
        if differs.any():
            return done + int(differs.argmax())
        done += take
        width *= 2
    return done


def runs_of(codes: np.ndarray, min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES) -> np.ndarray:
    """Rows (start, length, period) by start, then period, of all runs of at least ``max(min_length, min_copies * period)``.

    ``min_copies`` is at least 2. A run with that many copies holds ``min_copies - 1``
    whole roots one after the other, and each of them is the longest Lyndon word at its
    start; positions without such neighbours are not tried.
    """
    codes = eligible(codes, min_length, min_copies)
    kept = np.flatnonzero(codes)
    if not len(kept):
        return np.empty((0, 3), dtype=np.int64)
    # Only stretches that may hold runs are grouped, with one 0 around each.
    near = np.unique(np.concatenate([kept - 1, kept, kept + 1]))
    runs = _runs(codes[near], min_length, min_copies)
    runs[:, 0] = near[runs[:, 0]]
    return runs


def _runs(codes: np.ndarray, min_length: int, min_copies: int) -> np.ndarray:
    top = codes.max() + 1
    n, found = len(codes), set()
    for ranks in (codes, np.where(codes > 0, top - codes, 0)):
        size = lyndon_lengths(ranks)
        at = np.flatnonzero(codes > 0)
        for _ in range(1, min_copies - 1):
            at = at[at + size[at] < n]
        for k in range(1, min_copies - 1):
            nxt = at + k * size[at]
            at = at[nxt + size[at] <= n]
            nxt = at + k * size[at]
            same = (size[nxt] == size[at]) & (codes[nxt] == codes[at]) & (codes[nxt + size[at] - 1] == codes[at + size[at] - 1])
            at = at[same]
        at = at[np.lexsort((at, size[at]))]
        period, end = 0, 0
        for i in at.tolist():
            p = int(size[i])
            if p == period and i + p <= end:
                continue  # another root of the run that was found last
            right = common_extension(codes, i, i + p, 1)
            left = common_extension(codes, i - 1, i + p - 1, -1) if i else 0
            length = left + p + right
            if length >= max(min_length, min_copies * p):
                found.add((i - left, length, p))
                period, end = p, i + p + right
    return np.array(sorted((s, p, length) for s, length, p in found), dtype=np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _some(texts: list[str], min_length: int, min_copies: int) -> pd.DataFrame:
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.zeros(n_words.sum() + len(texts) + 1, dtype=np.int64)
    first = np.cumsum(n_words + 1) - n_words  # of each text's words; a 0 before each
    is_word = np.ones(len(codes), dtype=bool)
    is_word[first - 1] = is_word[-1] = False
    codes[is_word] = pd.factorize(np.array([x for w in words for x in w], dtype=object))[0] + 1
    runs = runs_of(codes, min_length, min_copies)
    text = np.searchsorted(first, runs[:, 0], side="right") - 1
    drop = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(drop[:-1]) > 0
    cuts = np.searchsorted(text, np.arange(1, len(texts)))
    collapsed = []
    has_runs = np.bincount(text, minlength=len(texts)) > 0
    for w, f, some in zip(words, first.tolist(), has_runs.tolist()):
        if some:
            gone = dropped[f : f + len(w)].tolist()
            w = [x for x, d in zip(w, gone) if not d]
        collapsed.append(b" ".join(w).decode("utf-8", "replace"))
    return pd.DataFrame({
        "starts": np.split(runs[:, 0] - first[text], cuts) if len(texts) else [],
        "lengths": np.split(runs[:, 1], cuts) if len(texts) else [],
        "periods": np.split(runs[:, 2], cuts) if len(texts) else [],
        "n_words": n_words,
        "collapsed": collapsed,
    })


def _search(min_length: int, min_copies: int):
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            done, some, chars = [], [], 0
            for t in texts:
                some.append(t)
                chars += len(t)
                if chars > CHARS_AT_ONCE:
                    done.append(_some(some, min_length, min_copies))
                    some, chars = [], 0
            if some or not done:
                done.append(_some(some, min_length, min_copies))
            yield pd.concat(done, ignore_index=True)

    return search


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES) -> DataFrame:
    """``docs`` with a struct column (named by :func:`runs_column`) of what each text repeats.

    ``runs`` is an array of (start, length, period) in words, by start, then period: stretches
    of at least ``max(min_length, min_copies * period)`` words, with ``period`` the smallest
    one, that no neighbouring word extends. ``n_words`` counts the text's words (stretches
    without space, tab, line and page breaks) and ``collapsed`` holds, joined by one space,
    the words that no run contains after its first ``period`` words.

    Each row is judged for itself: repeated rows, null ids and extra columns with whatever
    names need no care. A null or blank text has no words, no runs and an empty ``collapsed``.
    No rows give no rows.
    """
    if min_copies < 2:
        raise ValueError("a run has at least two copies")
    arrow_batches(docs.sparkSession)
    name = runs_column(docs)
    found = F.pandas_udf(_search(min_length, min_copies), FOUND)(text_of(text))
    c = F.col(name)
    run = F.transform(
        F.arrays_zip(c["starts"], c["lengths"], c["periods"]),
        lambda x: F.struct(x["starts"].alias("start"), x["lengths"].alias("length"), x["periods"].alias("period")),
    )
    return docs.withColumn(name, found).withColumn(
        name, F.struct(run.alias("runs"), c["n_words"].alias("n_words"), c["collapsed"].alias("collapsed"))
    )


def runs_column(docs: DataFrame) -> str:
    return free_name(docs, "periodic_runs")


def strongest(runs):
    """The run with the greatest exact ``length / period``, the first of equal ones; null without runs.

    ``runs`` is an array of (start, length, period) by start, then period.
    """
    better = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda best, x: F.when(better(x, best), x).otherwise(best))
