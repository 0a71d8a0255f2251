"""Markdown documents to headings, catalogues, chunks and subtrees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from clausemill.functions import markdown as M
from clausemill.functions.ordered import ordered_join
from clausemill.functions.text import lines, strip


def headers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, idx, line_idx, level, title)``; narrow, no shuffle."""
    return docs.select(key, F.posexplode(M.headers(F.col(text))).alias("idx", "h")).select(key, "idx", "h.*")


def overlap_batches(found: DataFrame, key: str, size: int = 200, overlap: int = 20) -> DataFrame:
    """Batches each heading appears in, and whether that batch may update it.

    Batch ``k`` starts at ``k * (size - overlap)``. The first updates all it holds,
    later ones leave their first ``overlap`` headings alone.
    """
    step = size - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / step).cast("int"))
    last = F.floor(F.col("idx") / step).cast("int")
    return found.withColumn("batch", F.explode(F.sequence(first, last))).withColumn(
        "updates", (F.col("batch") == 0) | (F.col("idx") >= F.col("batch") * step + overlap)
    )


def apply_header_fixes(
    found: DataFrame, replies: DataFrame, key: str, size: int = 200, overlap: int = 20
) -> DataFrame:
    """Replace levels and titles by reply lines ``## text [n]`` of ``(key, batch, reply)``.

    Only lines in the batch's own update range count; the first one per heading wins.
    """
    step = size - overlap
    pattern = r"^(#+)\s+(.+?)\s*\[(\d+)\]$"
    said = (
        replies.select(key, "batch", F.posexplode(lines(strip(F.col("reply")))).alias("pos", "line"))
        .withColumn("line", strip(F.col("line")))
        .filter(F.col("line").rlike(pattern))
        .select(
            key,
            "batch",
            "pos",
            F.regexp_extract("line", pattern, 3).try_cast("int").alias("idx"),
            F.length(F.regexp_extract("line", pattern, 1)).alias("new_level"),
            strip(F.regexp_extract("line", pattern, 2)).alias("new_title"),
        )
        .filter(
            (F.col("idx") >= F.when(F.col("batch") == 0, 0).otherwise(F.col("batch") * step + overlap))
            & (F.col("idx") < F.col("batch") * step + size)
        )
        .groupBy(key, "idx")
        .agg(F.min_by(F.struct("new_level", "new_title"), F.struct("batch", "pos")).alias("fix"))
    )
    return found.join(said, [key, "idx"], "left").select(
        key,
        "idx",
        "line_idx",
        F.coalesce("fix.new_level", "level").alias("level"),
        F.coalesce("fix.new_title", "title").alias("title"),
        F.col("fix").isNotNull().alias("fixed"),
    )


def chunks(docs: DataFrame, key: str, text: str, compat_files: bool = False) -> DataFrame:
    """Header-scoped chunks with path, headers and file of origin; narrow, no shuffle.

    ``compat_files=True`` looks a chunk's file up by the first occurrence of its
    first line instead of by its true line number.
    """
    # Sections stand in a projection of their own: beside the generator they would be found again for every chunk.
    sections = M.file_sections(F.col(text))
    if compat_files:
        sections = M.with_first_chars(sections, F.col(text))
    cut = docs.select(key, F.col(text).alias("_text"), sections.alias("_sections")).select(
        key, "_text", "_sections", F.posexplode(M.chunk_by_header(F.col("_text"))).alias("original_index", "c")
    )
    if compat_files:
        file = M.section_of_first_line(F.col("_sections"), F.col("_text"), F.col("c.page_content"))
    else:
        file = M.section_at(F.col("_sections"), F.col("c.line_idx"))
    return cut.select(
        key,
        "original_index",
        F.lit(0).alias("split_part"),
        "c.page_content",
        F.map_from_arrays(
            F.transform(F.col("c.path"), lambda p: F.repeat(F.lit("#"), p["level"])),
            F.transform(F.col("c.path"), lambda p: p["title"]),
        ).alias("headers"),
        M.structure_path(F.col("c.path")).alias("structure_path"),
        F.size("c.path").alias("structure_level"),
        file.alias("_file"),
    ).select("*", "_file.file_name", "_file.file_class").drop("_file")


def split_oversize(chunk_rows: DataFrame, size: int = 6000, overlap: int = 200) -> DataFrame:
    """Cut chunks over ``size`` into fixed windows; parts count from 1, whole chunks are part 0."""
    parts = chunk_rows.select("*", M.windows(F.col("page_content"), size, overlap).alias("_parts"))
    return (
        parts.select(
            "*", F.size("_parts").alias("split_total"), F.posexplode("_parts").alias("_pos", "_part")
        )
        .withColumn("split_part", F.when(F.col("split_total") > 1, F.col("_pos") + 1).otherwise(0))
        .withColumn("page_content", F.col("_part"))
        .drop("_parts", "_pos", "_part")
    )


SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ", "")


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy packing of pieces into texts of at most ``size`` with a tail of ``overlap`` repeated."""
    out: list[str] = []
    window: list[str] = []
    length = 0
    for piece in pieces:
        if window and length + len(piece) > size:
            out.append("".join(window))
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.pop(0))
        window.append(piece)
        length += len(piece)
    if window:
        out.append("".join(window))
    return [text for text in (t.strip() for t in out) if text]


def cut_at_separators(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut one text at the strongest separator it has, going to weaker ones for pieces still too long."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, weaker = separators[at], separators[at + 1 :]
    if mark:
        head, *tail = text.split(mark)
        pieces = [p for p in [head, *(mark + t for t in tail)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    fitting: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            fitting.append(piece)
            continue
        out += _pack(fitting, size, overlap)
        fitting = []
        out += cut_at_separators(piece, size, overlap, weaker) if weaker else [piece]
    return out + _pack(fitting, size, overlap)


def split_at_separators(chunk_rows: DataFrame, size: int = 6000, overlap: int = 200) -> DataFrame:
    """Separator-aware form of :func:`split_oversize`.

    Chunks within ``size`` stay in the JVM; only the oversize ones pass through
    Arrow batches, each one a row of its own, so nothing is shuffled or grouped.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: cut_at_separators(t, size, overlap))

    long = chunk_rows.filter(F.length("page_content") > size).withColumn("_parts", cut("page_content"))
    long = (
        long.select("*", F.size("_parts").alias("split_total"), F.posexplode("_parts").alias("_pos", "_part"))
        .withColumn("split_part", F.col("_pos") + 1)
        .withColumn("page_content", F.col("_part"))
        .drop("_parts", "_pos", "_part")
    )
    short = chunk_rows.filter(F.length("page_content") <= size).withColumn("split_total", F.lit(1))
    return short.unionByName(long)


def rebuild_text(chunk_rows: DataFrame, key: str) -> DataFrame:
    """The parsed text of each document: its chunks in order, joined by blank lines."""
    return chunk_rows.groupBy(key).agg(
        ordered_join([F.col("original_index"), F.col("split_part")], F.col("page_content"), "\n\n").alias("parsed")
    )


def descendants(chunk_rows: DataFrame, key: str, asked: DataFrame | None = None) -> DataFrame:
    """``(key, ancestor_index, descendant_index)`` below the asked ``(key, original_index)``, or below every chunk.

    In the order of the paths, what lies below a path follows it without a gap: from the path and a
    slash up to the path and the character after the slash. One ordered pass over a document's paths
    and the asked bounds numbers both, so a subtree is an interval of numbers, and only the numbers
    in asked intervals are joined with chunks.
    """
    nodes = chunk_rows.select(key, "original_index", F.col("structure_path").alias("_at")).distinct()
    above = nodes.filter(F.col("_at") != "")
    if asked is not None:
        above = above.join(asked.select(key, "original_index").distinct(), [key, "original_index"], "left_semi")
    bounds = above.select(key, "original_index", F.explode(F.array(*[F.concat("_at", F.lit(c)) for c in ("/", "0")])).alias("_at"))
    places = nodes.select(key, "original_index", "_at", F.lit(1).alias("_node")).unionByName(bounds.withColumn("_node", F.lit(0)))
    # A path that equals a bound comes after it: it is below the lower one and beyond the upper one.
    in_order = Window.partitionBy(key).orderBy("_at", "_node").rowsBetween(Window.unboundedPreceding, 0)
    numbered = places.withColumn("_n", F.sum("_node").over(in_order))
    below = (
        numbered.filter("_node = 0").groupBy(key, F.col("original_index").alias("ancestor_index"))
        .agg(F.min("_n").alias("_first"), F.max("_n").alias("_last")).filter("_last > _first")
        .select(key, "ancestor_index", F.explode(F.sequence(F.col("_first") + 1, "_last")).alias("_n"))
    )
    named = numbered.filter("_node = 1").select(key, "_n", F.col("original_index").alias("descendant_index"))
    return below.join(named, [key, "_n"]).select(key, "ancestor_index", "descendant_index")


def fetch_by_index(chunk_rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Content of each wanted ``(key, original_index, pos)`` with its split parts and descendants.

    A descendant that is wanted itself stays on its own; any other belongs to the
    wanted ancestor with the lowest ``pos``.
    """
    asked = wanted.select(key, F.col("original_index").alias("parent_index"), "pos")
    owned = (
        descendants(chunk_rows, key, wanted)
        .withColumnRenamed("ancestor_index", "parent_index")
        .join(asked, [key, "parent_index"])
        .join(
            asked.select(key, F.col("parent_index").alias("descendant_index")), [key, "descendant_index"], "left_anti"
        )
        .groupBy(key, F.col("descendant_index").alias("original_index"))
        .agg(F.min_by("parent_index", "pos").alias("parent_index"))
    )
    members = owned.select(key, "parent_index", "original_index", F.lit(1).alias("below")).unionByName(
        asked.select(key, "parent_index", F.col("parent_index").alias("original_index"), F.lit(0).alias("below"))
    )
    return (
        members.join(chunk_rows.select(key, "original_index", "split_part", "page_content", "structure_path"), [key, "original_index"])
        .groupBy(key, "parent_index")
        .agg(
            ordered_join(
                [F.col("below"), F.col("original_index"), F.col("split_part")], F.col("page_content"), "\n"
            ).alias("content"),
            F.max(F.when(F.col("below") == 0, F.col("structure_path"))).alias("structure_path"),
            F.sum(F.when(F.col("split_part") <= 1, F.col("below")).otherwise(0)).alias("n_below"),
        )
    )
