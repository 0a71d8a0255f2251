"""Text-cleaning column builders. Everything stays in the JVM; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clausemill.functions.binding import let

# They must equal what callers already store.
UNTITLED_SECTION = "Untitled section"
UNNAMED_SECTION = "未命名章节"
EMPTY_SECTION_BODY = "本节无正文内容"
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
SPECIAL_AGREEMENT = "特别约定"
CLAUSE_HEADING = "^第[一二三四五六七八九十百零0-9]+条"

SPACE = r"[\s\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]"
TABLE_BLOCK = r"(?is)<table\b[^>]*>.*?</table>"

# Full-width forms FF01..FF5E sit at a fixed distance from ASCII 21..7E.
_WIDE = {chr(code + 0xFEE0): chr(code) for code in range(0x21, 0x7F)}
_MARK, _MARK2 = "", ""  # private-use separators


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(^{SPACE}+)|({SPACE}+$)", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+$", "")


def lines(text: Column) -> Column:
    """Lines of a text; one final line break opens no further line."""
    return let(
        F.split(text, LINE_BREAK, -1),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
    )


def repair_markdown(text: Column) -> Column:
    """Right-trim every line, name bare headings of level 1-6, trim the text, end with one newline."""
    fixed = F.transform(
        lines(text),
        lambda line: F.regexp_replace(rstrip(line), r"^(#{1,6})$", f"$1 {UNTITLED_SECTION}"),
    )
    return F.when((text == "") | text.isNull(), text).otherwise(
        F.concat(strip(F.array_join(fixed, "\n")), F.lit("\n"))
    )


def fix_empty_headers(text: Column, placeholder: str = UNNAMED_SECTION) -> Column:
    """Give a title to heading lines that consist of marks only, whatever their level."""
    return F.array_join(
        F.transform(lines(text), lambda line: F.regexp_replace(line, rf"^(#+){SPACE}*$", f"$1 {placeholder}")), "\n"
    )


def placeholder_empty_sections(text: Column, placeholder: str = EMPTY_SECTION_BODY) -> Column:
    """Put a placeholder body under each heading that has none before the next heading."""
    return F.regexp_replace(
        text, rf"(?md)^(#+ .*)$(?>{SPACE}*)(?=^#+ |\z)", f"$1\n\n{placeholder}\n\n"
    )


def full_to_half(text: Column, letters_and_digits_only: bool = False) -> Column:
    wide = {w: a for w, a in _WIDE.items() if a.isalnum() or not letters_and_digits_only}
    return F.translate(text, "".join(wide), "".join(wide.values()))


def half_to_full(text: Column) -> Column:
    """The inverse of :func:`full_to_half` over all of 21..7E."""
    return F.translate(text, "".join(_WIDE.values()), "".join(_WIDE))


def fix_ligatures(text: Column) -> Column:
    for ligature, letters in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return text


def fix_control(text: Column) -> Column:
    """Drop CR LF pairs and read U+0002 as a hyphen."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("")), F.lit("\u0002"), F.lit("-"))


def strip_invalid(text: Column) -> Column:
    """Remove line feeds and every character of the control categories, lone surrogates among them."""
    return F.regexp_replace(text, r"\p{C}", "")


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([*`~$])", r"\\$1")


def clean_display_formula(text: Column) -> Column:
    """Take one pair of display-formula marks off the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"^\\\[", ""), r"\\\]$", ""))


def _balanced(text: Column, opening: str, closing: str) -> Column:
    n_open = F.regexp_count(text, F.lit(opening))
    return (n_open > 0) & (n_open == F.regexp_count(text, F.lit(closing)))


def unwrap_bracket_formula(text: Column) -> Column:
    r"""``\[x\]`` becomes ``[x]`` where such marks are balanced over the text."""
    return F.when(
        _balanced(text, r"\\\[", r"\\\]"), F.regexp_replace(text, r"\\\[(.*?)\\\]", r"[$1]")
    ).otherwise(text)


def strip_code_fence(text: Column) -> Column:
    """Drop an opening fence line and a closing fence line, then trim."""

    def drop_first(found: Column) -> Column:
        return F.when(F.try_element_at(found, F.lit(1)).startswith("```"), F.slice(found, 2, F.size(found))).otherwise(found)

    def drop_last(found: Column) -> Column:
        fence = strip(F.try_element_at(found, F.lit(-1))) == "```"
        return F.when(fence, F.slice(found, 1, F.size(found) - 1)).otherwise(found)

    body = let(let(lines(text), drop_first), drop_last)
    return F.when(text == "", "").otherwise(strip(F.array_join(body, "\n")))


def split_inline_formula(text: Column) -> Column:
    r"""Array of ``(type, content)`` pieces cut at ``\(..\)``; one text piece if marks are unbalanced."""
    marked = F.regexp_replace(text, r"\\\((.+?)\\\)", f"{_MARK}{_MARK2}$1{_MARK}")
    pieces = F.transform(
        F.split(marked, _MARK, -1),
        lambda p: F.when(
            p.startswith(_MARK2),
            F.struct(F.lit("inline_equation").alias("type"), strip(F.substr(p, F.lit(2))).alias("content")),
        ).otherwise(F.struct(F.lit("text").alias("type"), p.alias("content"))),
    )
    kept = F.filter(pieces, lambda p: (p["type"] == "inline_equation") | (strip(p["content"]) != ""))
    whole = F.array(F.struct(F.lit("text").alias("type"), text.alias("content")))
    return F.when(_balanced(text, r"\\\(", r"\\\)"), kept).otherwise(whole)


def script_lang(text: Column) -> Column:
    """``ja`` / ``ko`` / ``zh`` by the share of their scripts among the letters, else ``other``."""

    def count(cls: str) -> Column:
        # What is left when runs of other characters go; an array of all matches would be the text over again.
        return F.length(F.regexp_replace(text, rf"[^{cls}]+", ""))

    kinds = F.struct(
        F.greatest(count(r"\p{L}"), F.lit(1)).alias("letters"), count(r"\p{IsHiragana}\p{IsKatakana}").alias("kana"),
        count(r"\p{IsHangul}").alias("hangul"), count(r"\p{IsHan}").alias("han"),
    )
    return let(
        kinds,
        lambda k: F.when(k["kana"] * 20 >= k["letters"], "ja")
        .when(k["hangul"] * 10 >= k["letters"] * 3, "ko")
        .when((k["han"] + k["kana"]) * 10 >= k["letters"] * 3, "zh")
        .otherwise("other"),
    )


def join_lines(found: Column, lang: Column) -> Column:
    """Lines to running text: CJK lines touch, others get a space, a word hyphen at a line end goes."""
    trimmed = F.filter(F.transform(found, strip), lambda s: s != "")
    spaced = F.transform(
        trimmed,
        lambda s: F.when(s.rlike(r"[A-Za-z]+-$"), F.regexp_replace(s, "-$", "")).otherwise(
            F.concat(s, F.lit(" "))
        ),
    )
    return F.when(let(lang, lambda x: x.isin("zh", "ja", "ko")), F.array_join(trimmed, "")).otherwise(F.array_join(spaced, ""))


def promote_headings(text: Column) -> Column:
    """First line becomes ``#``, clause titles become ``##``, the lines between form one paragraph."""
    kept = F.filter(F.transform(lines(strip(text)), strip), lambda s: s != "")
    marked = F.transform(
        kept,
        lambda s, i: F.when(i == 0, F.concat(F.lit("# "), s, F.lit(_MARK)))
        .when(s.rlike(CLAUSE_HEADING) | (s == SPECIAL_AGREEMENT), F.concat(F.lit(f"{_MARK}## "), s, F.lit(_MARK)))
        .otherwise(s),
    )
    joined = F.regexp_replace(F.array_join(marked, ""), f"{_MARK}+$", "")
    return F.concat(F.regexp_replace(joined, f"{_MARK}+", "\n\n"), F.lit("\n"))


def find_tables(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TABLE_BLOCK), F.lit(0))


def replace_tables(text: Column, replacements: Column) -> Column:
    """Put ``replacements[k]`` where the k-th table block stands; a null keeps the block."""
    filled = F.zip_with(find_tables(text), replacements, lambda block, new: F.coalesce(new, block))
    pairs = F.zip_with(
        F.split(text, TABLE_BLOCK, -1), filled, lambda outside, table: F.concat(outside, F.coalesce(table, F.lit("")))
    )
    return F.array_join(pairs, "")


def storage_path(path: Column) -> Column:
    """``(bucket, key, range_start, range_end)`` of an object path with an optional byte range."""
    pure = strip(F.regexp_extract(path, r"^([^?]*)", 1))
    span = F.regexp_extract(path, r"\?bytes=([^?]*)", 1)
    return F.struct(
        F.nullif(F.regexp_extract(pure, r"^s3a?://([^/]*)/", 1), F.lit("")).alias("bucket"),
        F.when(pure.rlike(r"^s3a?://[^/]*/"), F.regexp_extract(pure, r"(?s)^s3a?://[^/]*/(.*)$", 1)).alias("key"),
        F.regexp_extract(span, r"^(\d+),", 1).try_cast("bigint").alias("range_start"),
        F.regexp_extract(span, r",(\d+)", 1).try_cast("bigint").alias("range_end"),
    )


def text_md5(text: Column) -> Column:
    return F.md5(text)


def bytes_md5(content: Column) -> Column:
    return F.upper(F.md5(content))


def text_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def sorted_json(entries: Column) -> Column:
    """JSON text of a string map with its keys in order, so equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def map_md5(entries: Column) -> Column:
    return F.md5(sorted_json(entries))
