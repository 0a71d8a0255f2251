"""Markdown structure inside one row: headings, sections, chunks and paths.

A document is one row, so its lines, headings and chunks are arrays of that row.
None of this shuffles; explode the result where rows are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clausemill.functions.binding import let
from clausemill.functions.text import SPACE, lines, strip

HEADING = rf"^(#+){SPACE}+(.+)$"
FILE_MARK = r"^FILE:\s*([^|]+?)(?:\s*\|\s*(.+))?$"
_GAP = ""  # stands for a blank line outside code while paragraphs are joined

_PART = "struct<level:int,title:string>"
_CHUNK = f"struct<line_idx:int,level:int,path:array<{_PART}>,page_content:string>"


def headers(text: Column) -> Column:
    """Array of ``(line_idx, level, title)`` for every line that looks like a heading."""
    found = F.transform(
        lines(text),
        lambda line, i: F.when(
            line.rlike(HEADING),
            F.struct(
                i.alias("line_idx"),
                F.length(F.regexp_extract(line, HEADING, 1)).alias("level"),
                strip(F.regexp_extract(line, HEADING, 2)).alias("title"),
            ),
        ),
    )
    return F.filter(found, lambda h: h.isNotNull())


def catalog(found: Column) -> Column:
    """Text form of a heading list: ``## title [n]`` lines, n from 0."""
    return F.array_join(
        F.transform(
            found,
            lambda h, n: F.concat(
                F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["title"], F.lit(" ["), n.cast("string"), F.lit("]")
            ),
        ),
        "\n",
    )


def strip_index_mark(title: Column) -> Column:
    """Drop a trailing ``[12]`` or ``[12-15]``."""
    return strip(F.regexp_replace(title, r"\s*\[\d+(?:-\d+)?\]$", ""))


def parse_file_marker(title: Column) -> Column:
    """``(file_name, file_class)`` of a file mark; null for other titles."""
    bare = strip(title)
    return F.when(
        bare.rlike(FILE_MARK),
        F.struct(
            strip(F.regexp_extract(bare, FILE_MARK, 1)).alias("file_name"),
            F.nullif(strip(F.regexp_extract(bare, FILE_MARK, 2)), F.lit("")).alias("file_class"),
        ),
    )


def file_sections(text: Column) -> Column:
    """Array of ``(start_line, end_line, file_name, file_class)``: a level-1 file mark opens a section."""

    def build(found: Column) -> Column:
        marks = F.filter(
            F.transform(
                found,
                lambda line, i: let(
                    parse_file_marker(F.nullif(F.regexp_extract(line, r"^#\s+(.+)$", 1), F.lit(""))),
                    lambda m: F.when(m.isNotNull(), F.struct(i.alias("start_line"), m.alias("mark"))),
                ),
            ),
            lambda m: m.isNotNull(),
        )
        return let(
            marks,
            lambda ms: F.transform(
                ms,
                lambda m, k: F.struct(
                    m["start_line"].alias("start_line"),
                    (
                        F.coalesce(F.try_element_at(ms, k + 2)["start_line"], F.size(found)) - 1
                    ).alias("end_line"),
                    m["mark"]["file_name"].alias("file_name"),
                    m["mark"]["file_class"].alias("file_class"),
                ),
            ),
        )

    return let(lines(text), build)


def section_at(sections: Column, line_idx: Column) -> Column:
    """The section that holds a line; the first one for lines before any mark."""
    before = F.filter(sections, lambda s: s["start_line"] <= line_idx)
    return F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(sections, F.lit(1)))


def with_first_chars(sections: Column, text: Column) -> Column:
    """Sections with ``first_char``, the place in the text, from 1, where the line numbered ``start_line`` begins."""

    def first_char(n: Column) -> Column:
        return F.when(n == 0, 1).otherwise(F.length(F.call_function("substring_index", text, F.lit("\n"), n)) + 2)

    return F.transform(sections, lambda s: s.withField("first_char", first_char(s["start_line"])))


def section_of_first_line(sections: Column, text: Column, content: Column) -> Column:
    """Compatibility form: locate the content's first line by its first occurrence in the text.

    Repeated first lines are attributed to the earliest place; a line that is not
    found belongs to the last section. ``sections`` come from :func:`with_first_chars`,
    so a place is compared with theirs and no line is counted; without sections nothing is looked for.
    """
    first = strip(F.element_at(F.split(strip(content), "\n", 2), 1))

    def locate(pos: Column) -> Column:
        before = F.filter(sections, lambda s: s["first_char"] <= pos)
        near = F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(sections, F.lit(1)))
        return F.when(pos == 0, F.try_element_at(sections, F.lit(-1))).otherwise(near)

    return F.when((F.size(sections) > 0) & (first != ""), let(F.instr(text, first), locate))


def _code_flags(found: Column) -> Column:
    """Lines with a flag for those inside or on a code fence."""

    def is_fence(s: Column) -> Column:
        return s.rlike("^(```|~~~)") & ~s.rlike("^```.*```")

    fences = F.filter(
        F.transform(found, lambda s, i: F.when(is_fence(s), i)), lambda i: i.isNotNull()
    )
    return let(
        fences,
        lambda fs: F.transform(
            found,
            lambda s, i: F.struct(
                s.alias("s"),
                (is_fence(s) | (F.size(F.filter(fs, lambda p: p < i)) % 2 == 1)).alias("code"),
            ),
        ),
    )


def _paragraphs(flagged: Column) -> Column:
    """Lines of a paragraph join by a newline, paragraphs by a hard line break."""
    joined = F.array_join(
        F.transform(flagged, lambda m: F.when((m["s"] == "") & ~m["code"], _GAP).otherwise(m["s"])), "\n"
    )
    trimmed = F.regexp_replace(joined, f"^({_GAP}\n?)+|(\n?{_GAP})+$", "")
    return F.regexp_replace(trimmed, f"\n({_GAP}\n)+", "  \n")


def _with_paths(found: Column) -> Column:
    """Headings with their stack of open headings; a heading closes all of its level or deeper."""
    start = F.expr(
        f"named_struct('stack', cast(array() as array<{_PART}>), "
        f"'out', cast(array() as array<struct<line_idx:int,level:int,path:array<{_PART}>>>))"
    )

    def step(acc: Column, h: Column) -> Column:
        part = F.struct(h["level"].alias("level"), h["title"].alias("title"))
        opened = F.when(
            h["level"] == 0, F.expr(f"cast(array() as array<{_PART}>)")
        ).otherwise(F.concat(F.filter(acc["stack"], lambda x: x["level"] < h["level"]), F.array(part)))
        return let(
            opened,
            lambda stack: F.struct(
                stack.alias("stack"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            h["line_idx"].alias("line_idx"), h["level"].alias("level"), stack.alias("path")
                        )
                    ),
                ).alias("out"),
            ),
        )

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def chunk_by_header(text: Column) -> Column:
    """Array of ``(line_idx, level, path, page_content)``, one per heading section, heading kept.

    A heading inside a code fence is text. A section joins the previous chunk when
    both have the same path, or when the previous one ends in a heading line and
    this one is deeper (a heading without a body).
    """
    pattern = "^#+( |$)"

    def sections(flagged: Column) -> Column:
        marks = F.filter(
            F.transform(
                flagged,
                lambda m, i: F.when(
                    ~m["code"] & m["s"].rlike(pattern),
                    let(
                        F.length(F.regexp_extract(m["s"], "^(#+)", 1)),
                        lambda level: F.struct(
                            i.alias("line_idx"),
                            level.alias("level"),
                            strip(F.substr(m["s"], level + 1)).alias("title"),
                        ),
                    ),
                ),
            ),
            lambda h: h.isNotNull(),
        )
        lead = F.array(F.struct(F.lit(0).alias("line_idx"), F.lit(0).alias("level"), F.lit("").alias("title")))
        stacked = let(
            marks,
            lambda hs: _with_paths(
                F.when(F.try_element_at(hs, F.lit(1))["line_idx"] == 0, hs).otherwise(F.concat(lead, hs))
            ),
        )
        cut = let(
            stacked,
            lambda hs: F.transform(
                hs,
                lambda h, k: F.struct(
                    h["line_idx"].alias("line_idx"),
                    h["level"].alias("level"),
                    h["path"].alias("path"),
                    _paragraphs(
                        F.slice(
                            flagged,
                            h["line_idx"] + 1,
                            F.coalesce(F.try_element_at(hs, k + 2)["line_idx"], F.size(flagged)) - h["line_idx"],
                        )
                    ).alias("page_content"),
                ),
            ),
        )
        return F.filter(cut, lambda c: c["page_content"] != "")

    def merge(acc: Column, c: Column) -> Column:
        def with_last(last: Column) -> Column:
            joins = (last["path"] == c["path"]) | (
                (F.size(last["path"]) < F.size(c["path"])) & last["page_content"].rlike(r"(^|\n)#[^\n]*$")
            )
            both = F.struct(
                last["line_idx"].alias("line_idx"),
                c["level"].alias("level"),
                c["path"].alias("path"),
                F.concat(last["page_content"], F.lit("  \n"), c["page_content"]).alias("page_content"),
            )
            return F.when(
                joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))
            ).otherwise(F.concat(acc, F.array(c)))

        return let(F.try_element_at(acc, F.lit(-1)), lambda last: F.when(last.isNull(), F.array(c)).otherwise(with_last(last)))

    flagged = let(F.transform(F.split(text, "\n", -1), strip), _code_flags)
    return F.aggregate(let(flagged, sections), F.expr(f"cast(array() as array<{_CHUNK}>)"), merge)


def structure_path(path: Column) -> Column:
    """Open headings joined by ``/``, index marks removed."""
    return F.array_join(F.transform(path, lambda p: strip_index_mark(p["title"])), "/")


def windows(text: Column, size: int = 6000, overlap: int = 200) -> Column:
    """Fixed windows of an oversize text; a text within ``size`` is one window."""
    step = size - overlap
    n = F.when(F.length(text) <= size, F.lit(1)).otherwise(
        F.ceil((F.length(text) - size) / step).cast("int") + 1
    )
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda k: F.substr(text, k * step + 1, F.lit(size))
    )
