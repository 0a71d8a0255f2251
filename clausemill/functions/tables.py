"""HTML and token tables inside one row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clausemill.functions.binding import let
from clausemill.functions.text import strip

_CELL = r"(?is)<t[dh]\b([^>]*)>(.*?)</t[dh]>"
_LETTERS = {"fcel": "F", "ecel": "E", "lcel": "L", "ucel": "U", "xcel": "X"}


def table_rows(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))


def _span(attrs: Column, name: str) -> Column:
    digits = F.regexp_extract(attrs, rf"""(?i)\b{name}\s*=\s*["']?(\d+)""", 1)
    # An empty text is never cast: each failing cast raises an error inside, which costs more than all the rest of a cell.
    number = let(digits, lambda d: F.when(d != "", d.try_cast("int")))
    return F.when(attrs == "", 1).otherwise(F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)))


def row_cells(row: Column) -> Column:
    """Array of ``(row_span, col_span, text)`` of one table row."""
    return F.zip_with(
        F.regexp_extract_all(row, F.lit(_CELL), F.lit(1)),
        F.regexp_extract_all(row, F.lit(_CELL), F.lit(2)),
        lambda attrs, body: F.struct(
            _span(attrs, "rowspan").alias("row_span"),
            _span(attrs, "colspan").alias("col_span"),
            strip(F.regexp_replace(body, "<[^>]*>", "")).alias("text"),
        ),
    )


def placed_cells(cells: Column) -> Column:
    """Cells of a row with their first column ``c``, for tables without row spans."""
    before = lambda i: F.aggregate(F.slice(cells, 1, i), F.lit(0), lambda acc, x: acc + x["col_span"])
    return F.transform(cells, lambda x, i: x.withField("c", before(i)))


def row_width(row: Column) -> Column:
    attrs = F.regexp_extract_all(row, F.lit(_CELL), F.lit(1))
    return F.aggregate(attrs, F.lit(0), lambda acc, a: acc + _span(a, "colspan"))


def total_columns(html: Column) -> Column:
    """Widest row, for tables without row spans."""
    return F.coalesce(F.array_max(F.transform(table_rows(html), row_width)), F.lit(0))


def edge_rows_match(above: Column, below: Column) -> Column:
    """Last row of the table above as wide as the first row of the one below."""
    last, first = F.try_element_at(table_rows(above), F.lit(-1)), F.try_element_at(table_rows(below), F.lit(1))
    return F.coalesce(row_width(last) == row_width(first), F.lit(False))


def can_merge(above: Column, below: Column, width_above: Column, width_below: Column, note_above: Column, caption_below: Column) -> Column:
    """No footnote between them, no caption below, nearly the same width, and matching columns or edge rows."""
    near = F.abs(width_above - width_below) / F.least(width_above, width_below) < 0.1
    return (
        above.isNotNull() & ~note_above & ~caption_below & near
        & ((total_columns(above) == total_columns(below)) | edge_rows_match(above, below))
    )


def shared_header_rows(above: Column, below: Column) -> Column:
    """Number of leading rows equal in text and spans, however many."""
    pairs = F.zip_with(
        table_rows(above),
        table_rows(below),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )

    def step(n: Column, p: Column) -> Column:
        # Open counts are 0 or more; a count closed by a mismatch is held as -(n + 1), and nothing more is parsed.
        closed = -(n + 1)
        return (
            F.when(n < 0, n)
            .when(p["a"] == p["b"], n + 1)
            .when(p["a"].isNull() | p["b"].isNull(), closed)
            .when(F.to_json(row_cells(p["a"])) == F.to_json(row_cells(p["b"])), n + 1)
            .otherwise(closed)
        )

    return F.aggregate(pairs, F.lit(0), step, lambda n: F.when(n < 0, -n - 1).otherwise(n))


def concat_tables(above: Column, below: Column) -> Column:
    """The table above with the rows of the one below that follow their shared header."""
    rest = let(table_rows(below), lambda r: F.slice(r, shared_header_rows(above, below) + 1, F.greatest(F.size(r), F.lit(1))))
    rows = F.concat(table_rows(above), rest)
    lines = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), r, F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(lines, ""), F.lit("</table>"))


def otsl_cells(text: Column) -> Column:
    """Cells ``(r, c, row_span, col_span, text)`` of the six-token table language, short rows padded.

    A cell spans the run of left-merge marks on its right and of up-merge marks below.
    """
    token = "<(fcel|ecel|lcel|ucel|xcel)>([^<]*)"
    rows = F.filter(F.split(text, "<nl>", -1), lambda r: r != "")
    names = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(token), F.lit(1)))
    bodies = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(token), F.lit(2)))
    coded = F.transform(
        names,
        lambda r: F.array_join(
            F.transform(r, lambda n: F.translate(F.substr(n, F.lit(1), F.lit(1)), "feluxs", "FELUXS")), ""
        ),
    )

    def cells(grid: Column) -> Column:
        def run(rest: Column, mark: str) -> Column:
            return F.length(F.regexp_extract(rest, f"^([{mark}X]*)", 1)) + 1

        def cell(r: Column, c: Column) -> Column:
            row = F.element_at(grid, r + 1)
            column = F.array_join(F.transform(F.slice(grid, r + 2, F.size(grid)), lambda x: F.substr(x, c + 1, F.lit(1))), "")
            return F.struct(
                r.alias("r"),
                c.alias("c"),
                run(column, "U").alias("row_span"),
                run(F.substr(row, c + 2), "L").alias("col_span"),
                strip(F.coalesce(F.try_element_at(F.element_at(bodies, r + 1), c + 1), F.lit(""))).alias("text"),
                F.substr(row, c + 1, F.lit(1)).alias("mark"),
            )

        every = F.flatten(
            F.transform(
                grid, lambda row, r: F.transform(F.sequence(F.lit(0), F.length(row) - 1), lambda c: cell(r, c))
            )
        )
        return F.filter(every, lambda x: x["mark"].isin("F", "E"))

    width = F.array_max(F.transform(coded, F.length))
    return let(F.transform(coded, lambda r: F.rpad(r, width, "E")), cells)
