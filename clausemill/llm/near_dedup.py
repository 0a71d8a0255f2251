"""Near-duplicate documents by weighted Jaccard similarity of their word shingles.

Signatures follow BagMinHash: every shingle carries one Poisson process per dyadic range of
weights (0-1, 1-2, 2-4, ...), whose points have a time, a discretised weight inside the range
and a slot of the signature; a point counts if its weight is at most the shingle's
count. A slot keeps its earliest time, and two texts agree in a slot with a probability of
exactly their weighted Jaccard similarity. Only points up to the time that fills all slots
are made, so a long text costs little more than one step per shingle.

Signatures are cut into bands. Texts of a bucket are compared with one pivot of it first, the one
that shares most buckets. What this leaves in different components is compared inside
blocks of a bucket: by whole signatures, then by the overlap of the hashed shingles, which travel with
the texts. Only pairs that pass both and connect two components of their block become rows and are
verified word by word. So no component is split, but a large group never becomes all of its pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clausemill.llm.common import arrow_batches, cut_lineage, free_name, small_side, stored, text_of
from clausemill.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
PIVOT_ROUNDS = 2
BLOCK = 1_000
# Shingles of a block: 16 MB as hashes.
BLOCK_WEIGHT = 2_000_000
# Five standard errors of a signature's estimate below the limit: a pair at the limit falls short in 2 of 10 million cases.
ESTIMATE = 0.68


@dataclass(frozen=True)
class Bands:
    """At a similarity of 0.8 a pair misses all of 48 bands of 6 slots in 5 of 10 million cases."""

    bands: int = 48
    rows: int = 6

    @property
    def slots(self) -> int:
        return self.bands * self.rows


_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHARS_AT_ONCE = 1_500_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, shingle hash, count)`` of all shingles, sorted by text.

    A text of fewer than five words is one shingle of them all; a text without words has none.
    Words are runs of anything but ASCII white space.
    """
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.array([x for w in words for x in w], dtype=object)
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    codes, distinct = pd.factorize(flat)
    h = pd.util.hash_array(distinct, categorize=False)[codes]
    start = np.cumsum(n) - n
    made = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(len(texts)), made)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made) + start[doc]
    with np.errstate(over="ignore"):
        value = np.zeros(len(doc), dtype=np.uint64)
        for k in range(SHINGLE):
            inside = at + k < start[doc] + n[doc]
            word = h[np.minimum(at + k, len(h) - 1)]
            value = np.where(inside, _mix(value + word + _MIX), value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))
    return doc[first], value[first], np.diff(np.append(first, len(doc)))


def signatures(doc: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Signature (n texts times ``slots`` times of first points) of weighted shingles; no shingles: infinite."""
    weight = np.bincount(doc, weights=count, minlength=n)
    times = np.full((n, slots), np.inf)
    horizon = np.full(n, np.log(slots) + 4.0) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        chosen = todo[doc]
        _add_points(times, doc[chosen], value[chosen], count[chosen], horizon, slots)
        todo &= np.isinf(times).any(1)  # rarely; with a later horizon these texts' points are made again
        horizon *= 2
    return times


def _add_points(times: np.ndarray, doc: np.ndarray, value: np.ndarray, count: np.ndarray, horizon: np.ndarray, slots: int) -> None:
    flat = times.reshape(-1)
    low, width = 0, 1
    while len(doc):  # one range of weights after the other: (0, 1], (1, 2], (2, 4], ...
        with np.errstate(over="ignore"):
            seed = _mix(value + np.uint64(low + 1) * _MIX)
        d, w, limit, t = doc, count, horizon[doc], np.zeros(len(doc))
        rate = float(slots * width)
        step = np.uint64(0)
        while len(d):
            step += np.uint64(1)
            with np.errstate(over="ignore"):
                u = _mix(seed + step * _MIX)
                v = _mix(u + _MIX)
            t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            on = t < limit
            if not on.all():
                d, w, limit, t, seed, v = d[on], w[on], limit[on], t[on], seed[on], v[on]
            slot = (v >> np.uint64(32)) % np.uint64(slots)
            at = d * slots + slot.astype(np.int64)
            if width > 1:
                level = low + 1 + ((v & np.uint64(0xFFFFFFFF)).astype(np.int64) * width >> 32)
                inside = level <= w
                np.minimum.at(flat, at[inside], t[inside])
            else:
                np.minimum.at(flat, at, t)
        low, width = low + width, max(low + width, 1)
        more = count > low
        doc, value, count = doc[more], value[more], count[more]


def band_hashes(times: np.ndarray, bands: Bands) -> np.ndarray:
    """A number per band; equal for texts that agree in all its slots."""
    bits = times.view(np.uint64).reshape(len(times), bands.bands, bands.rows)
    out = np.broadcast_to(np.arange(bands.bands, dtype=np.uint64), bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(bands.rows):
            out = _mix(out * _MIX + bits[:, :, k])
    return out.view(np.int64)


def _marks(times: np.ndarray) -> np.ndarray:
    """A byte per slot; equal where the times are."""
    with np.errstate(over="ignore"):
        return (_mix(times.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def _signed(docs: DataFrame, bands: Bands) -> DataFrame:
    """``(digest, weight, bands, marks)``; without words the bands are empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in _portions(batch.column(1).to_pylist()):
                doc, value, count = shingles(some)
                weight = np.bincount(doc, weights=count, minlength=len(some)).astype(np.int64)
                times = signatures(doc, value, count, len(some), bands.slots)
                hashes, marks = band_hashes(times, bands), _marks(times)
                has = weight > 0
                ends = np.cumsum(has * bands.bands)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, ends), pa.int32()), pa.array(hashes[has].reshape(-1), pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(some)), pa.array(weight), lists, pa.array([m.tobytes() for m in marks], pa.binary())],
                    ["digest", "weight", "bands", "marks"],
                )

    rows = docs.select(_digest().alias("digest"), text_of().alias("text"))
    return rows.mapInArrow(sign, "digest string, weight long, bands array<long>, marks binary")


def _portions(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """``texts`` in pieces of bounded length, each with its first index."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= _CHARS_AT_ONCE):
            chars += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def bags(texts: list[str]) -> list[np.ndarray]:
    """Each text's shingles as sorted numbers; the n-th occurrence of a shingle has a number of its own."""
    doc, value, count = shingles(texts)
    row = np.repeat(np.arange(len(doc)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        number = _mix(value[row] + nth.astype(np.uint64) * _MIX)
    order = np.lexsort((number, doc[row]))
    return np.split(number[order], np.cumsum(np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64))[:-1])


def _bagged(texts: DataFrame) -> DataFrame:
    """``(id, bag)``: the shingles of ``texts (id, text)`` as bytes of :func:`bags`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in _portions(batch.column(1).to_pylist()):
                held = pa.array([b.tobytes() for b in bags(some)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), held], ["id", "bag"])

    return texts.select("id", "text").mapInArrow(count, "id long, bag binary")


def _digest() -> Column:
    return F.md5(text_of())


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts' shingles, counted exactly; texts without words are equal."""
    x, y = _bag(a), _bag(b)
    if not x and not y:
        return 1.0
    least = sum(min(n, y[k]) for k, n in x.items() if k in y)
    return least / (sum(x.values()) + sum(y.values()) - least)


def _bag(text: str) -> Counter:
    words = text.encode("utf-8", "surrogatepass").split()
    if len(words) < SHINGLE:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(SHINGLE))))


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    out, last, bag = [], None, None
    for x, y in zip(a, b):
        if x != last:  # pairs of one pivot often follow each other
            last, bag = x, _bag(x)
        other = _bag(y)
        least = sum(min(n, bag[k]) for k, n in other.items() if k in bag)
        total = sum(bag.values()) + sum(other.values()) - least
        out.append(least / total if total else 1.0)
    return pd.Series(out, dtype="float64")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs (a, b)`` whose texts ``(id, text)`` are at least as similar as the limit."""
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(right, "b").join(left, "a")
    return both.filter(F.pandas_udf(_similarities, "double")("text_a", "text_b") >= SIMILARITY - 1e-12).select("a", "b")


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """``members`` with the label of their component, their own id where there is no link."""
    if links is None:
        return members.withColumn("label", F.col("id"))
    named = components(links)
    return members.join(named, "id", "left").withColumn("label", F.coalesce("label", "id"))


def links_of(members: DataFrame, texts: DataFrame, marks: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Verified links ``(a, b)`` that connect all texts which buckets and similarity connect.

    ``members`` has ``(bucket, band, n, id, weight)`` of buckets with ``n > 1`` texts, ``texts`` has
    ``(id, text)`` and ``marks`` ``(id, marks)``.
    """
    links = None
    central = members.groupBy("id").agg(F.sum("n").alias("central"))
    narrow = members.select("bucket", "id", "weight").join(small_side(central), "id")
    for turn in range(PIVOT_ROUNDS):
        labelled = _labelled(narrow, links)
        first = -F.col("central") if turn == 0 else F.xxhash64("id", F.lit(turn))
        rank = F.struct(first.alias("rank"), F.col("id"), F.col("label"), F.col("weight"))
        pivots = labelled.groupBy("bucket").agg(
            F.min(rank).alias("p"), F.min("label").alias("low"), F.max("label").alias("high")
        ).filter("low < high").select("bucket", "p")
        meets = labelled.join(pivots, "bucket").filter((F.col("label") != F.col("p.label")) & _comparable("weight", "p.weight"))
        # One pivot for each text that isn't connected with it yet.
        pairs = meets.groupBy(F.col("id").alias("b")).agg(F.min("p").alias("p")).select(F.col("p.id").alias("a"), "b")
        found = verified(stored(pairs, "pairs"), texts)
        links = cut_lineage(found if links is None else links.union(found))
    labelled = _labelled(members, links)
    mixed = labelled.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.sum("weight").alias("total")
    ).filter("low < high").select("bucket", "total")
    rest = stored(labelled.join(mixed, "bucket"), "rest")
    wanted = texts.join(rest.select("id").distinct(), "id", "left_semi")
    held = stored(_bagged(wanted).join(marks, "id").join(_places(rest), "id"), "bags")
    return links.union(verified(stored(_likely(rest.join(held, "id"), bands).distinct(), "pairs"), texts))


def _places(rest: DataFrame) -> DataFrame:
    """``(id, places)``: the bands and buckets of each text of ``rest``."""
    return rest.groupBy("id").agg(F.collect_list(F.struct("band", "bucket")).alias("places"))


def _likely(rest: DataFrame, bands: Bands) -> DataFrame:
    """Pairs ``(a, b)`` of a bucket with the similarity by hashed shingles that connect different labels.

    A bucket is cut into blocks of about ``BLOCK`` texts and ``BLOCK_WEIGHT`` shingles; a task compares two
    blocks at a time. A pair comes from the first band whose bucket (``places``) it shares, not from every one, and a pair whose labels
    other pairs of the same blocks connect does not come at all.
    """
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_WEIGHT)).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = rest.withColumn("block", block).withColumn("other", other).select(
        "bucket", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "id", "weight", "label", "marks", "bag", "places",
    )
    keys = ["bucket", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            starts = _group_starts(held)
            for i, j in zip(starts, starts[1:]):  # the last group may go on in the next batch
                yield from _close(held.slice(i, j - i), bands)
            held = held.slice(starts[-1])
        if held is not None:
            yield from _close(held, bands)

    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(compare, "a long, b long")


def _group_starts(rows: pa.Table) -> list[int]:
    keys = np.column_stack([rows.column(k).to_numpy().astype(np.int64) for k in ("bucket", "low", "high")])
    return [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()]


def _close(rows: pa.Table, bands: Bands) -> Iterator[pa.RecordBatch]:
    """Similar pairs of one group: between its two blocks, or within its one block."""
    ids, weight, label, block = (rows.column(k).to_numpy().copy() for k in ("id", "weight", "label", "block"))
    band, low, high = (rows.column(k)[0].as_py() for k in ("band", "low", "high"))
    marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), dtype=np.uint8).reshape(len(ids), bands.slots)
    held = [np.frombuffer(b, dtype=np.uint64) for b in rows.column("bag").to_pylist()]
    bucket, has = _bucket_table(rows.column("places"), bands)
    left = np.flatnonzero(block == low)
    right = np.flatnonzero(block == high)
    found: list[tuple[int, int]] = []
    for i in left:
        j = right[(label[right] != label[i]) & (np.minimum(weight[right], weight[i]) >= (SIMILARITY - 1e-9) * np.maximum(weight[right], weight[i]))]
        j = j[ids[j] > ids[i]] if low == high else j
        share = (marks[j] == marks[i]).mean(1)
        j = j[share - (1 - share) / 255 >= ESTIMATE]
        first = ((bucket[j] == bucket[i]) & has[j] & has[i]).argmax(1)
        for k in j[first == band]:
            if label[k] != label[i] and _overlaps(held[i], held[k]):
                found.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                label[label == label[k]] = label[i]
    if found:
        a, b = np.array(found, dtype=np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _bucket_table(places: pa.ChunkedArray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each text and band, and whether there is one."""
    lists = places.combine_chunks()
    text, at = lists.value_parent_indices().to_numpy(), lists.flatten()
    band = at.field("band").to_numpy()
    bucket, has = np.zeros((len(lists), bands.bands), np.int64), np.zeros((len(lists), bands.bands), bool)
    bucket[text, band] = at.field("bucket").to_numpy()
    has[text, band] = True
    return bucket, has


def _overlaps(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two bags of at least one shingle have the similarity."""
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= (SIMILARITY - 1e-12) * (len(a) + len(b) - both)


def _comparable(a: str, b: str) -> Column:
    """Totals that allow the similarity: the smaller is at least that share of the larger."""
    return F.least(F.col(a), F.col(b)) >= (SIMILARITY - 1e-9) * F.greatest(F.col(a), F.col(b))


def classes(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``(digest, class, n_links)`` per distinct text (by MD5): the smallest digest of its class.

    Equal texts are one text; null counts as empty, and texts without words but white space
    are near-duplicates of each other. No rows give no rows.
    """
    arrow_batches(docs.sparkSession)
    signed = _signed(docs, bands).groupBy("digest").agg(
        *(F.first(c).alias(c) for c in ("weight", "bands", "marks"))
    )
    # The ids are numbers of stored rows, so they are the same whenever they are read.
    texts = stored(signed.withColumn("id", F.monotonically_increasing_id()), "texts")
    bucketed = texts.select("id", "weight", F.posexplode("bands").alias("band", "bucket"))
    several = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(bucketed.join(several, "bucket"), "members")
    wanted = texts.select("id", "digest").join(members.select("id").distinct(), "id", "left_semi")
    whole = docs.select(_digest().alias("digest"), text_of().alias("text")).join(small_side(wanted, 500_000), "digest")
    whole = stored(whole.dropDuplicates(["id"]).select("id", "text"), "whole")
    marks = texts.select("id", "marks")
    links = stored(links_of(members, whole, marks, bands), "links")
    named = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    blank = F.col("weight") == 0
    rows = texts.select("id", "digest", "weight").join(named, "id", "left").join(degree, "id", "left").withColumn(
        "label", F.when(blank, F.lit(-1)).otherwise(F.coalesce("label", "id"))
    )
    low = rows.groupBy("label").agg(F.min("digest").alias("class"))
    return rows.join(low, "label").select("digest", "class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``(doc_id, class_id, n_docs)`` of every row; ``class_id`` is the smallest doc_id of its class.

    A class holds the texts that links of a similarity of at least 0.8 connect. Null ids come last.
    """
    found = classes(docs, bands).select("digest", "class")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest")).join(found, "digest")
    of = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_docs"))
    return rows.join(of, "class").select("doc_id", "class_id", "n_docs")


def near_dedup(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row of each class of near-duplicates, that with the smallest doc_id (nulls last), with all columns."""
    digest, rank = free_name(docs, "dedup_digest"), free_name(docs, "dedup_rank")
    found = stored(classes(docs, bands).select("digest", "class"), "classes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest")).join(found, "digest")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest"))
    first = rows.groupBy("class").agg(F.min(order).alias("first")).select(
        F.col("first.digest").alias(digest), F.col("first.doc_id").alias(rank)
    )
    kept = docs.withColumn(digest, _digest()).join(first, digest).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(rank)))
    return kept.dropDuplicates([digest]).select(*docs.columns)
