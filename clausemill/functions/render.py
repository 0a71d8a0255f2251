"""Blocks to Markdown and content records; discard rules and title levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clausemill.functions.text import escape_markdown, full_to_half

# Fixed values.
DISCARD_KEYWORDS = (
    "ICF结构代码", "人身保险伤残评定标准及代码", "伤残评定标准及代码", "伤残代码", "伤残条目", "职业代码", "森林木材业", "地质矿产",
    "运输业", "工程施工", "建筑材料", "电子业", "机电产品制造与装配", "化学工业", "纺织", "文化体育用品制作", "卫生专业技术",
    "服务业", "商业", "体育",
)
DISCARD_NUMBERS = (2201001, 4101032)
_ID_CARD = r"(?<![\dXx])([1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx])(?![\dXx])"


def discard_reason(text: Column) -> Column:
    """The keyword, id number or occupation code a text is discarded for; null if it stays. Cheap tests run first."""
    keyword = F.try_element_at(
        F.filter(F.array(*[F.lit(k) for k in DISCARD_KEYWORDS]), lambda k: F.contains(text, k)), F.lit(1)
    )
    person = F.nullif(F.regexp_extract(text, _ID_CARD, 1), F.lit(""))
    codes = F.filter(
        F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{7})(?!\d)"), F.lit(1)),
        lambda n: n.cast("int").between(*DISCARD_NUMBERS),
    )
    return F.coalesce(keyword, person, F.try_element_at(codes, F.lit(1)))


def title_level(level: Column) -> Column:
    """Level of a title, 1 if it has none, 4 at most; anything under 1 is no heading."""
    return F.when(level.isNull(), 1).when(level > 4, 4).when(level < 1, 0).otherwise(level)


def block_markdown(kind: Column, text: Column, level: Column, caption: Column, image: Column, footnote: Column, text_only: bool = False) -> Column:
    """Markdown of one block; null where the mode leaves it out."""
    plain = escape_markdown(full_to_half(text))
    figure = F.concat(F.lit("![]("), image, F.lit(")"))
    pictured = F.concat_ws("  \n", caption, F.coalesce(figure, F.lit("")), footnote)
    return (
        F.when(kind == "title", F.concat(F.repeat(F.lit("#"), title_level(level)), F.lit(" "), plain))
        .when(kind == "equation", F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == "image", None if text_only else pictured)
        .when(kind == "table", None if text_only else F.concat_ws("\n", caption, text, footnote))
        .when(kind.isin("text", "list", "index"), plain)
    )


def content_record(kind: Column, text: Column, level: Column, image: Column, page_idx: Column) -> Column:
    """One entry of a content list as a struct; fields a type does not have are null."""
    return F.struct(
        F.when(kind.isin("title", "text", "list", "index"), "text").otherwise(kind).alias("type"),
        F.when(kind != "image", text).alias("text"),
        F.when((kind == "title") & (title_level(level) > 0), title_level(level)).alias("text_level"),
        F.when(kind == "image", image).alias("img_path"),
        page_idx.alias("page_idx"),
    )
