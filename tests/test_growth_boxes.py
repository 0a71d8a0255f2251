"""Box rules, reading order and file sections on larger tables: what a step reads, shuffles and stores."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
SMALL = "/root/testdata/sf0.001"
SCHEMA = "page int, box_id int, x0 int, y0 int, x1 int, y1 int, score double"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _watch(monkeypatch, module, seen):
    """Note every frame that the module stores."""
    plain = module.cut_lineage

    def cut(df):
        stored = plain(df)
        seen.append((df, stored))
        return stored

    monkeypatch.setattr(module, "cut_lineage", cut)


def _places(rows):
    """Reading order of one page's ``(box_id, x0, y0, x1, y1)`` by plain recursion."""
    def parts(group, lo, hi):
        out, reach = [], None
        for r in sorted(group, key=lambda r: (r[lo], r[hi], r[0])):
            if reach is None or r[lo] >= reach:
                out.append([])
            out[-1].append(r)
            reach = r[hi] if reach is None else max(reach, r[hi])
        return out

    def order(group):
        cut = [column for band in parts(group, 2, 4) for column in parts(band, 1, 3)]
        if len(cut) == 1:
            return [r[0] for r in sorted(group, key=lambda r: (r[2], r[1], r[0]))]
        return [i for c in cut for i in order(c)]

    return order(rows)


def test_reading_order_goes_on_with_open_groups(spark, monkeypatch):
    from clausemill.operators import layout_lines as N

    gen, rows = random.Random(7), []
    for page in [None, *range(12)]:
        for i in range(30):
            x, y = gen.randint(0, 400), gen.randint(0, 500)
            rows.append((page, i, x, y, x + gen.randint(-5, 130), y + gen.randint(-2, 30), 1.0))
    seen = []
    _watch(monkeypatch, N, seen)
    found = N.xy_cut(spark.createDataFrame(rows, SCHEMA), "page").collect()
    for page in [None, *range(12)]:
        got = [r.box_id for r in sorted((r for r in found if r.page == page), key=lambda r: r.position)]
        assert got == _places([r[1:6] for r in rows if r[0] == page])
    sizes = [stored.count() for _, stored in seen]
    assert sizes[0] == len(rows) == len(found) and all(b < a for a, b in zip(sizes, sizes[1:])) and sizes[-1] < 0.3 * len(rows)
    for df, _ in seen:
        assert df._jdf.queryExecution().sparkPlan().toString().count("Window") >= 5
        assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1


def test_sections_are_found_once_per_document(spark):
    from clausemill.operators import structure as S

    text = "# head\nbody\n# FILE: a.md\n# one\nsame\n# FILE: b.md | kind\n# one\nmore é\n# FILE: c.md\n# body\n# é\nlast"
    rows = [(1, text), (2, "# x\ny"), (3, None), (4, ""), (5, "x\r# FILE: d.md\n# FILE: e.md\n# x\n# e.md\n\n"), (6, text.replace("\n", "\r\n"))]
    docs = spark.createDataFrame(rows, "doc_id int, md string")
    for compat in (False, True):
        plan = _plan(S.chunks(docs, "doc_id", "md", compat_files=compat))
        assert "FILE:" not in plan.split("Generate")[0]  # above the generator it would be looked for in every chunk
    got = {(r.doc_id, r.original_index): (r.page_content.split("\n")[0].strip(), r.file_name) for r in S.chunks(docs, "doc_id", "md", compat_files=True).collect()}
    lines = text.split("\n")
    starts = [(i, s[8:].split(" |")[0]) for i, s in enumerate(lines) if s.startswith("# FILE: ")]
    for (doc, _), (first, file) in got.items():
        if doc == 1:
            at = text[: text.index(first)].count("\n")
            assert file == next((f for i, f in reversed(starts) if i <= at), "a.md"), first
    assert [f for (d, _), (_, f) in sorted(got.items()) if d == 2] == [None]
    assert {d for d, _ in got} == {1, 2, 5, 6}


def test_boxes_travel_once_and_bare(spark):
    from clausemill.plans.fixtures import boxes

    shape, below = _plan(boxes(spark, SMALL)).split("Window [", 1)
    below = "\n".join(line for line in below.split("\n")[1:] if "Relation [" not in line)
    assert " AS " not in below and "l_shipdate" not in below and "AS x0" in shape
    plan = _plan(QUERIES["l41_restore_continued"](spark, SMALL))
    assert plan.count("Join ") == 2  # each kind of block with the originals; the kinds are put together


def test_restored_blocks_with_odd_keys(spark, tmp_path):
    load = "/root/testdata/sf0.001/lineitem.parquet"
    rows = spark.read.parquet(load).limit(300)
    odd = rows.withColumn("l_partkey", F.when(F.col("l_orderkey") % 7 > 0, F.col("l_partkey") % 9)).withColumn("l_linenumber", F.when(F.col("l_suppkey") % 5 > 0, F.col("l_linenumber")))
    odd.unionByName(odd.limit(40)).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["l41_restore_continued"](spark, str(tmp_path)).collect()
    assert len(found) == 340 and {r.shown for r in found if r.page is None} == {0} and {r.restored for r in found} == {0, 1}
    assert all(r.shown == 0 for r in found if r.restored == 1)


def test_owners_read_stored_boxes(spark, monkeypatch):
    from clausemill.operators import layout_boxes as L
    from clausemill.plans import q_layout_boxes as Q

    plain, calls, cells = Q.boxes, [], []
    monkeypatch.setattr(Q, "boxes", lambda *a: calls.append(a) or plain(*a))
    pairs = L.touching_pairs

    def watched(left, right, page, columns, cell=L.CELL):
        cells.append((cell, left.selectExpr("max(x1 - x0 - 2 * 99)").first()[0], left.count(), L._cells(left, "", cell).count()))
        return pairs(left, right, page, columns, cell)

    monkeypatch.setattr(L, "touching_pairs", watched)
    for name in ("l29_nearest_owner", "l30_relabel_footnotes"):
        calls.clear()
        assert QUERIES[name](spark, SMALL).count() > 0
        assert len(calls) == 1  # every round and kind reads the boxes that were stored once
    assert cells and all(spread <= 6 * n for _, _, n, spread in cells)


def test_subtrees_store_paths_only(spark, monkeypatch):
    from clausemill.plans import q_structure as Q

    seen = []
    _watch(monkeypatch, Q, seen)
    assert QUERIES["d14_subtree"](spark, SMALL).count() > 0
    assert [df.columns for df, _ in seen] == [["doc_id", "original_index", "structure_path"]]


def test_hulls_look_up_linked_boxes_only(spark):
    from clausemill.operators import layout_boxes as L

    gen, rows = random.Random(3), []
    for page in (1, 2):
        for i in range(40):
            x, y = gen.randint(0, 60) * 3, gen.randint(0, 5) * 20
            rows.append((page, i, x, y, x + 50, y + 14, 0.5))
    rows += [(None, 1, 0, 0, 50, 14, 0.5), (None, 2, 0, 0, 50, 14, 0.5), (3, 1, 0, 0, 50, 14, 0.5), (3, 1, 0, 0, 50, 14, 0.5)]
    found = L.union_tables(spark.createDataFrame(rows, SCHEMA), "page")
    assert _plan(found).count("Join ") == 1
    want = {}
    for page in (1, 2):
        own = [r for r in rows if r[0] == page]
        label = {r[1]: r[1] for r in own}
        for _ in own:
            for a in own:
                for b in own:
                    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
                    if w > 0 and h > 0 and w * h / (2 * 50 * 14 - w * h) > 0.7:
                        label[a[1]] = min(label[a[1]], label[b[1]])
        for r in own:
            want.setdefault((page, label[r[1]]), []).append(r)
    hulls = {(*k, min(r[2] for r in v), min(r[3] for r in v), max(r[4] for r in v), max(r[5] for r in v), len(v)) for k, v in want.items()}
    # Rows without a page have no key; a box that is given twice counts with each of its rows.
    assert set(map(tuple, found.select("page", "box_id", "x0", "y0", "x1", "y1", "n_boxes").collect())) == hulls | {(3, 1, 0, 0, 50, 14, 4)}
    assert len(hulls) < 80
