"""Markdown structure: a small policy, splitter properties, table placement."""

import random

from pyspark.sql import functions as F

from clausemill.functions import coding as C, markdown as M, tables as T
from clausemill.operators import hierarchy as H, layout_boxes as L, structure as S, tables as O
from clausemill.streaming import streams as K

POLICY = """# FILE: policy.md | 条款文档

本节无正文内容

# Sample policy
General words.

## Article 1
Benefit text.
second line

```
# not a heading
```

## Article 2
### Details
Deep text."""


def test_small_policy(spark):
    docs = spark.createDataFrame([(1, POLICY)], "doc_id int, md string")
    rows = S.chunks(docs, "doc_id", "md").orderBy("original_index").collect()
    assert [r.structure_path for r in rows] == [
        "FILE: policy.md | 条款文档", "Sample policy", "Sample policy/Article 1", "Sample policy/Article 2/Details",
    ]
    assert [r.structure_level for r in rows] == [1, 1, 2, 3]
    assert rows[0].page_content == "# FILE: policy.md | 条款文档  \n本节无正文内容"
    assert rows[2].page_content == "## Article 1\nBenefit text.\nsecond line  \n```\n# not a heading\n```"
    # A heading without a body goes into the chunk below it.
    assert rows[3].page_content == "## Article 2  \n### Details\nDeep text."
    assert {(r.file_name, r.file_class) for r in rows} == {("policy.md", "条款文档")}
    assert rows[2].headers == {"#": "Sample policy", "##": "Article 1"}


def test_no_shuffle_for_chunks(spark):
    docs = spark.createDataFrame([(1, POLICY)], "doc_id int, md string")
    plan = S.chunks(docs, "doc_id", "md")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_windows_cover(spark):
    text = "".join(chr(97 + i % 26) for i in range(17_003))
    parts = spark.createDataFrame([(text,)], "t string").select(M.windows(F.col("t"))).first()[0]
    assert parts[0] + "".join(p[200:] for p in parts[1:]) == text
    assert all(len(p) <= 6000 for p in parts)


def test_separator_cutting():
    rng = random.Random(7)
    for _ in range(40):
        text = "".join(rng.choice(["word", " ", "。", "；", "\n", "\n\n", "x" * 30]) for _ in range(400))
        parts = S.cut_at_separators(text, 120, 20)
        assert all(len(p) <= 120 for p in parts)
        at = 0
        for part in parts:  # every part is a piece of the text, in order
            found = text.find(part, max(0, at - 200))
            assert found >= 0
            at = found + len(part)
        assert set("".join(parts)) == set("".join(text.split())) | set("".join(parts))


def _brute_cells(rows):
    grid, out = {}, []
    for r, row in enumerate(rows):
        c = 0
        for rs, cs, text in row:
            while (r, c) in grid:
                c += 1
            for i in range(rs):
                for j in range(cs):
                    grid[r + i, c + j] = text
            out.append((r, c, rs, cs, text))
            c += cs
    return sorted(out)


def test_row_spans(spark):
    rows = [[(2, 1, "a"), (1, 2, "b")], [(1, 1, "c"), (3, 1, "d")], [(1, 2, "e")], [(1, 1, "f"), (1, 1, "g")]]
    html = "<table>" + "".join(
        "<tr>" + "".join(f'<td rowspan="{rs}" colspan={cs}>{t}</td>' for rs, cs, t in row) + "</tr>" for row in rows
    ) + "</table>"
    found = O.table_cells(spark.createDataFrame([(1, html)], "k int, html string"), ["k"], "html").collect()
    assert sorted((x.r, x.c, x.row_span, x.col_span, x.text) for x in found) == _brute_cells(rows)


def test_otsl(spark):
    text = "<fcel>a<lcel><nl><fcel>b<ecel><nl><ucel><fcel>c<nl>"
    cells = spark.createDataFrame([(text,)], "t string").select(F.inline(T.otsl_cells(F.col("t")))).collect()
    assert [(x.r, x.c, x.row_span, x.col_span, x.text) for x in cells] == [
        (0, 0, 1, 2, "a"), (1, 0, 2, 1, "b"), (1, 1, 1, 1, ""), (2, 1, 1, 1, "c"),
    ]


def test_any_number_of_marks(spark):
    docs = spark.createDataFrame([(1, "# A\nx\n" + "#" * 13 + " B\ny")], "doc_id int, md string")
    rows = S.chunks(docs, "doc_id", "md").orderBy("original_index").collect()
    assert [(r.structure_path, r.structure_level) for r in rows][1][0] == "A/B" and len(rows) == 2


def test_stream_dedup_across_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([(1, "a"), (2, "b"), (3, "a"), (4, None)], [(9_000_000, "a"), (9_000_001, "c"), (9_000_002, None)]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        K.dedup_into(stream, "text", ["doc_id"], out, str(tmp_path / "state"))
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2, 4, 9_000_001]


def test_all_plan_rows(spark):
    plan = "struct<plan_name:string, clause_name:string, liabilities:array<struct<liab_name:string>>>"
    rows = [(f"p{i}", "c", [("x",), ("",), ("y",)]) for i in range(25)]
    one = spark.createDataFrame([(rows,), ([],)], f"plans array<{plan}>").select(H.structure_table(F.col("plans")).alias("t"))
    full, empty = [r.t for r in one.collect()]
    assert full.split("\n")[2:] == [f"| p{i} | c | x<br>y |" for i in range(25)] and empty == "无计划数据"


def test_word_after_non_is_not_counted(spark):
    texts = spark.createDataFrame([("非住院",), ("住非住院院",), ("非住院，住院",)], "t string")
    fired = lambda strict: [
        len(r[0]) for r in texts.select(C.scene_rules(F.col("t"), strict=strict)).collect()
    ]
    loose, strict = fired(False), fired(True)
    assert strict[0] == strict[1] <= loose[0] and strict[2] == loose[2]


def test_text_that_touches_a_cell_has_none(spark):
    box = "page long, box_id long, x0 double, y0 double, x1 double, y1 double, score double"
    texts = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 1.0), (1, 2, 20.0, 0.0, 30.0, 10.0, 1.0)], box)
    cells = spark.createDataFrame([(1, 7, 10.0, 0.0, 20.0, 10.0, 1.0), (1, 8, 22.0, 0.0, 40.0, 10.0, 1.0)], box)
    assert [tuple(r) for r in L.match_text_to_cells(texts, cells, "page").collect()] == [(1, 2, 8)]


def test_subtrees_of_odd_paths(spark):
    """Equal paths, missing ancestors, and titles with slashes, digits and nothing in them."""
    rng = random.Random(7)
    paths = ["", "a", "a", "a/", "a/b", "a0", "a/0", "a/b/c/d", "ab", "a//x", "b/c/d", "b", "/", "/a", "等待/期", "等待", "等", "a/b0", "a/b/0"]
    paths += ["/".join(rng.choice(["a", "b", "0", "", "a0", "-", "é"]) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    rows = [(d, i, 0, p) for d in (1, 2) for i, p in enumerate(paths) if (i + d) % 5] + [(1, 1, 1, "a")]
    chunks = spark.createDataFrame(rows, "doc long, original_index int, split_part int, structure_path string")
    want = {(d, i, j) for d, i, _, p in rows for e, j, _, c in rows if d == e and p != "" and c.startswith(p + "/")}
    got = [tuple(r) for r in S.descendants(chunks, "doc").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    asked = spark.createDataFrame([(1, 4), (1, 4), (2, 1), (2, 999)], "doc long, original_index int")
    assert {tuple(r) for r in S.descendants(chunks, "doc", asked).collect()} == {w for w in want if w[:2] in {(1, 4), (2, 1)}}
    assert S.descendants(chunks, "doc", asked.limit(0)).count() == 0
