"""Candidate regions, coverage and refine groups on small fixtures."""

from pyspark.sql import functions as F

from tessella.operators import overlaps as ov
from tessella.operators.textclusters import refine_groups
from tessella.operators import textblocks as tb


def test_keep_candidates(spark):
    c = spark.createDataFrame(
        [(0, 1, "fine", 0.0, 0.0, 10.0, 10.0), (0, 2, "fine", 50.0, 0.0, 60.0, 10.0), (0, 3, "complex", 50.0, 0.0, 60.0, 10.0), (0, 4, "fine", 100.0, 0.0, 110.0, 10.0), (0, 5, "fine", 200.0, 0.0, 210.0, 10.0)],
        "g long, id long, channel string, x1 double, y1 double, x2 double, y2 double",
    )
    box = "g long, x1 double, y1 double, x2 double, y2 double"
    existing = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 9.0)], box)
    cover = spark.createDataFrame([(0, 50.0, 0.0, 58.0, 10.0)], box)
    content = spark.createDataFrame([(0, 0.0, 0.0, 150.0, 10.0)], box)
    # 1 repeats an element, 2 is covered, 5 misses nothing; the complex one only faces the IoU rule.
    assert sorted(r.id for r in ov.keep_candidates(c, existing, cover, content, ["g"], "id").collect()) == [3, 4]


def test_content_coverage(spark):
    box = "g long, x1 double, y1 double, x2 double, y2 double"
    content = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 10.0), (0, 5.0, 0.0, 20.0, 10.0), (1, 0.0, 0.0, 1.0, 1.0)], box)
    elements = spark.createDataFrame([(0, 0.0, 0.0, 5.0, 10.0), (0, 30.0, 0.0, 40.0, 10.0)], box)
    got = {r.g: (r.content_area, r.covered_area, r.missing_rate) for r in ov.content_coverage(content, elements, ["g"], 4.0).collect()}
    assert got == {0: (200.0, 50.0, 75.0), 1: (1.0, 0.0, 100.0)}


def test_refine_groups(spark):
    rows = [(0, 0, "X1", 0.0, 0.0, 20.0, 10.0), (0, 1, "+ Y2", 22.0, 0.0, 50.0, 10.0), (0, 2, "far", 500.0, 300.0, 520.0, 310.0), (0, 3, "stop", 522.0, 300.0, 540.0, 310.0),
            (0, 4, "Full Key SK1", 0.0, 50.0, 60.0, 60.0), (0, 5, "Other Key SK2", 62.0, 50.0, 130.0, 60.0), (0, 6, "Z", 132.0, 50.0, 140.0, 60.0)]
    b = spark.createDataFrame(rows, "doc long, ord long, text string, x1 double, y1 double, x2 double, y2 double")
    got = {r.ord: r.grp for r in refine_groups(b, "doc", "ord", F.col("text") != "stop").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 4: 4, 5: 5, 6: 5}


def test_similar_text_bound(spark):
    a = spark.createDataFrame([(0, "alpha beta gamma"), (0, "something else"), (1, "alpha beta gamma")], "k long, text string")
    b = spark.createDataFrame([(0, "alpha beta gamna"), (1, "unrelated words")], "k long, text string")
    assert [(r.k, r.text) for r in tb.similar_texts(a, b, "k", 0.8).collect()] == [(0, "alpha beta gamma")]


def test_interval_join_blocks(spark):
    left = spark.range(200).selectExpr("0L AS doc_id", "id AS ord", "id * 7 AS l_start", "id * 7 + id % 40 AS l_stop")
    right = spark.range(150).selectExpr("0L AS doc_id", "id AS style_ord", "id * 9 AS r_start", "id * 9 + 300 AS r_stop")
    got = sorted((r.ord, r.style_ord) for r in tb.interval_join(left, right, "doc_id", width=16).collect())
    want = sorted((i, j) for i in range(200) for j in range(150) if max(i * 7, j * 9) < min(i * 7 + i % 40, j * 9 + 300))
    assert got == want
