"""Layout rules against brute force and their invariants."""

import random

import pytest
from pyspark.sql import functions as F

from clausemill.functions import render as D
from clausemill.operators import layout_boxes as L, layout_lines as N


def _boxes(seed, n=60, pages=2):
    gen = random.Random(seed)
    out = []
    for p in range(pages):
        for i in range(n):
            x, y = gen.randint(0, 900), gen.randint(0, 900)
            out.append((p, i, x, y, x + gen.randint(5, 150), y + gen.randint(5, 60), round(gen.random(), 3)))
    return out


SCHEMA = "page int, box_id int, x0 int, y0 int, x1 int, y1 int, score double"


@pytest.mark.parametrize("cell", [13, 200, 5000])
def test_touching_pairs(spark, cell):
    rows = _boxes(1)
    found = L.self_pairs(spark.createDataFrame(rows, SCHEMA), "page", cell).collect()
    want = {
        (a[0], a[1], b[1]) for a in rows for b in rows
        if a[0] == b[0] and a[1] != b[1] and max(a[2], b[2]) <= min(a[4], b[4]) and max(a[3], b[3]) <= min(a[5], b[5])
    }
    got = [(r.page, r.a_box_id, r.b_box_id) for r in found]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_owner(spark):
    rows = _boxes(2)
    gap = lambda a, b: ((max(a[2] - b[4], b[2] - a[4], 0)) ** 2 + (max(a[3] - b[5], b[3] - a[5], 0)) ** 2) ** 0.5
    caps, bodies = [r for r in rows if r[1] % 4 == 0], [r for r in rows if r[1] % 9 == 1]
    found = L.nearest_owner(spark.createDataFrame(caps, SCHEMA), spark.createDataFrame(bodies, SCHEMA), "page", 10).collect()
    got = {(r.page, r.box_id): r.owner for r in found}
    want = {(c[0], c[1]): min((round(gap(c, b), 6), b[1]) for b in bodies if b[0] == c[0])[1] for c in caps}
    assert got == want


def test_connected_chain(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(200)], "page int, node int")
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(199) if i != 99], "page int, a int, b int")
    labels = {r.node: r.label for r in L.connected(edges, nodes, "page").collect()}
    assert labels == {i: 0 if i < 100 else 100 for i in range(200)}


def test_intervals(spark):
    gen = random.Random(4)
    rows = [(p, a, a + gen.randint(0, 9)) for p in range(3) for a in [gen.randint(0, 120) for _ in range(15)]]
    df = spark.createDataFrame(rows, "page int, x0 int, x1 int")
    merged = [tuple(r) for r in N.merge_intervals(df, ["page"], "x0", "x1").collect()]
    whole = spark.createDataFrame([(p, 0, 100) for p in range(3)], "page int, x0 int, x1 int")
    left = [tuple(r) for r in N.subtract_intervals(whole, df, ["page"], "x0", "x1").collect()]
    for p in range(3):
        points = {x for q, a, b in rows if q == p for x in range(a, b + 1)}
        assert {x for q, a, b in merged if q == p for x in range(a, b + 1)} == points
        assert sum(b - a + 1 for q, a, b in merged if q == p) == len(points)
        assert {x for q, a, b in left if q == p for x in range(a, b + 1)} == set(range(101)) - points


def test_xy_cut(spark):
    # Two columns under a headline; the left one has two blocks.
    rows = [(0, 0, 0, 0, 300, 20, 1.0), (0, 1, 0, 30, 140, 80, 1.0), (0, 2, 0, 90, 140, 200, 1.0), (0, 3, 160, 30, 300, 85, 1.0), (0, 4, 160, 95, 300, 200, 1.0), (0, 5, 0, 210, 300, 230, 1.0)]
    shuffled = random.Random(1).sample(rows, len(rows))
    found = N.xy_cut(spark.createDataFrame(shuffled, SCHEMA), "page").orderBy("position").collect()
    # The row gap at 85..90 crosses both columns, so bands come before columns.
    assert [r.box_id for r in found] == [0, 1, 3, 2, 4, 5]
    many = _boxes(5)
    places = N.xy_cut(spark.createDataFrame(many, SCHEMA), "page").collect()
    for p in (0, 1):
        assert sorted(r.position for r in places if r.page == p) == list(range(60))


def test_discard_reason(spark):
    texts = ["x 职业代码", "id 11010519900307123X.", "no 2201005x", "22010050", "plain 1234567", "a12201005"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.reason for r in df.select("i", D.discard_reason(F.col("t")).alias("reason")).orderBy("i").collect()]
    assert got == ["职业代码", "11010519900307123X", "2201005", None, None, None]
