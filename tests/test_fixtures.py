"""Hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import boxes as bx, masks, styles, texts
from tessella.functions.boxes import Box, box
from tessella.operators import datasets as ds, evalmetrics as ev, greedy, logs, overlaps as ov
from tessella.operators.cluster import components
from tessella.sources import annotations as an, diagrams as dg, payloads as pl


def lits(*v):
    return Box(*(F.lit(float(c)) for c in v))


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def boxes(spark, rows):
    return spark.createDataFrame(rows, "image_id long, det_id long, score double, x1 double, y1 double, x2 double, y2 double")


NMS = [(0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 2, 0.8, 1.0, 0.0, 11.0, 10.0), (0, 3, 0.7, 30.0, 0.0, 40.0, 10.0)]


def test_box_algebra(spark):
    a = lits(0, 0, 10, 10)
    r = one(
        spark, bx.iou(a, lits(5, 0, 15, 10)).alias("half"), bx.iou(a, lits(10, 0, 20, 10)).alias("touch"), bx.containment(a, lits(8, 0, 12, 10)).alias("in"),
        bx.relationship(a, lits(4, 4, 20, 20)).alias("rel"), bx.gap(a, lits(13, 14, 20, 20)).alias("gap"), bx.generalized_iou(a, a).alias("giou"),
    )
    assert r["half"] == pytest.approx(1 / 3) and r["touch"] == 0 and r["in"] == 0.5 and r["rel"] == "stacked" and r["gap"] == 4 and r["giou"] == 1


def test_score_first_nms(spark):
    kept = greedy.greedy_keep(boxes(spark, NMS), ["image_id"], "det_id", [-F.col("score")], greedy.iou_above(0.5))
    assert {r.det_id for r in kept.collect()} == {1, 3}


def test_smallest_first_nms(spark):
    rows = [*NMS, (0, 4, 0.1, 0.0, 0.0, 10.0, 9.0)]
    kept = greedy.greedy_keep(boxes(spark, rows), ["image_id"], "det_id", [box().area], greedy.iou_above(0.3))
    assert {r.det_id for r in kept.collect()} == {3, 4}


def test_components(spark):
    nodes = spark.createDataFrame([(0, i) for i in (1, 2, 3, 4)], "g long, id long")
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "g long, a long, b long")
    got = {r.id: r.component for r in components(nodes, edges, ["g"], "id").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_request_metrics(spark):
    lines = spark.createDataFrame(
        [('{"module":"a","duration_ms":10,"status":"success"}',), ('{"module":"a","duration_ms":"30","status":"error","host":"h"}',), ('{"module":"b","duration_ms":5}',), ("{oops",), ("",)],
        "value string",
    )
    got = {r.module: r for r in logs.metrics_by_module(an.log_entries(lines)).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].n == 2 and got["a"].avg_ms == 20 and got["a"].success_rate == 0.5 and got["b"].success_rate == 1.0


def test_precision_epsilon(spark):
    rows = spark.createDataFrame([(0, 50, 1, 2, 1, 1, 0)], "image_id long, threshold int, n_gt long, n_dt long, tp long, fp long, fn long")
    r = ev.dataset_scores(ev.with_outcome(rows)).first()
    assert r.precision == pytest.approx(1 / (2 + 1e-4)) and r.recall == pytest.approx(1 / (1 + 1e-4))


def test_union_area(spark):
    rows = [(0, 1, 0.0, 0.0, 0.0, 5.0, 10.0), (0, 2, 0.0, 3.0, 0.0, 8.0, 10.0)]
    for cell in (None, 4.0, 100.0):
        assert ov.union_area(boxes(spark, rows), ["image_id"], cell).first().covered == 80.0


def test_shard_merge(spark):
    rows = spark.createDataFrame([(0, 1, 1, 0.5, 1), (1, 1, 1, 0.9, 2), (1, 1, 2, 0.4, 3)], "shard int, image_id int, category_id int, score double, id int")
    got = ds.merge_shards(rows, "image_id", "category_id", "shard", "score", "id", 10)
    assert {r.score for r in got.collect()} == {0.5, 0.4}


def test_colors(spark):
    r = one(
        spark, styles.rgb(F.lit("light-dark(rgb(1, 2,3), #fff)")).alias("ld"), styles.rgb(F.lit("#abc")).alias("short"), styles.rgb(F.lit("none")).alias("none"),
        styles.distance(F.lit("#000000"), F.lit("#ff0000")).alias("d"), styles.distance(F.lit("zz"), F.lit("#ff0000")).alias("bad"), styles.dark_to_black(F.lit("#2a2a30")).alias("dark"),
    )
    assert tuple(r["ld"]) == (1, 2, 3) and tuple(r["short"]) == (170, 187, 204) and r["none"] is None
    assert r["d"] == 255 and r["bad"] == 0 and r["dark"] == "#000000"


def test_style_lookup(spark):
    s = F.lit("rounded=1; strokeWidth = x;rounded=0;fontStyle=5")
    r = one(spark, styles.value(s, "rounded").alias("r"), styles.number(s, "strokeWidth", 2.0).alias("w"), styles.font_flags(styles.value(s, "fontStyle")).alias("f"), styles.is_text(F.lit("text;a=1")).alias("t"))
    assert r["r"] == "1" and r["w"] == 2.0 and tuple(r["f"]) == (True, False, True) and r["t"]


@pytest.mark.parametrize(
    "text,expected",
    [("\\frac{a}{b}", True), ("ab", False), ("a=\\b=\\b=\\b=\\b=", False), ("\\mathbf{x}", False), ("\\mathbf{x}_{0}", True), ("x_{1", False), ("\\dagger=1", False),
     ("\\begin{array}{c} - \\end{array}", False), ("\\begin{array}{c} x_{1} \\end{array}", True)],
)
def test_formula_validity(spark, text, expected):
    assert one(spark, texts.is_valid_formula(F.lit(text)).alias("v"))["v"] is expected


@pytest.mark.parametrize(
    "text,expected",
    [("SELECT a WHERE x AND y", False), ("user_id", False), ("plain words here", False), ("X0", True), ("a = b + c", True), ("t=0", False), ("ResNet", False), ("224×224", False),
     ("Rbatch", False), ("α", True), ("what is 3?", True), ("f(x)", True), ("", False), ("数学公式的文字", False)],
)
def test_refine_gate(spark, text, expected):
    assert one(spark, texts.should_refine(F.lit(text), F.lit(False), F.lit(False)).alias("v"))["v"] is expected


@pytest.mark.parametrize(
    "original,latex,expected",
    [("中文文字", "\\frac{1}{2}", False), ("a=b", "a=b", False), ("Xi=3", "X_{i}=3", True), ("softmax score", "e x p", False), ("Transform", "\\mathsf{T r a n s f o r m}", False), ("loss total", "\\frac{q}{z_1}", False)],
)
def test_refinement_acceptance(spark, original, latex, expected):
    assert one(spark, texts.refinement_ok(F.lit(original), F.lit(latex)).alias("v"))["v"] is expected


def test_fonts(spark):
    name = lambda n: one(spark, texts.standard_font(F.lit(n)).alias("f"))["f"]
    assert [name(n) for n in ("ArialMT", "Yu Mincho", "DejaVu Mono", "Odd, serif", "")] == ["Arial Narrow", "SimSun", "Courier New", "Odd", "Arial Narrow"]


def test_escape_and_split(spark):
    r = one(
        spark, texts.escape_text(F.lit("a $x<1$ b"), F.lit(False)).alias("m"), texts.escape_text(F.lit("$x$"), F.lit(True)).alias("w"),
        texts.split_formula(F.lit("Full Private Key SK1 = (W, S)")).alias("s"), texts.subscript_fallback(F.lit("(Xi)")).alias("x"),
    )
    assert r["m"] == "a \\(x&lt;1\\) b" and r["w"] == "\\(x\\)" and r["x"] == "(X_{i})"
    assert r["s"]["has_both"] and r["s"]["text"] == "Full Private Key" and r["s"]["formula"] == "SK1 = (W, S)"


def test_mask_boxes(spark):
    """Filled rectangles on a 6 x 5 grid, column-major."""
    for x1, y1, x2, y2 in ((0, 0, 0, 0), (1, 2, 3, 4), (0, 0, 4, 5)):
        bits = [1 if x1 <= c <= x2 and y1 <= r <= y2 else 0 for c in range(5) for r in range(6)]
        rle = masks.encode(F.array(*[F.lit(b) for b in bits]))
        r = one(spark, masks.bounds(rle, 6, 5).alias("b"), masks.area(rle).alias("a"), masks.decode(rle).alias("d"))
        assert tuple(r["b"]) == (x1, y1, x2, y2) and r["a"] == sum(bits) and r["d"] == bits


def test_reindex_sample(spark):
    images = spark.createDataFrame([(0,), (1,)], "id long")
    cats = spark.createDataFrame([(0,), (1,)], "id long")
    anns = spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "id long, image_id long, category_id long")
    i, c, a = ds.one_based(images, cats, anns)
    assert sorted(map(tuple, a.collect())) == [(1, 1, 1), (2, 2, 2)] and sorted(r.id for r in i.collect()) == [1, 2] == sorted(r.id for r in c.collect())


def test_paths(spark):
    from tessella.functions import paths as pa

    p = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0))])
    r = one(spark, pa.trim_ends(p, 4.0, 12.0).alias("t"), pa.point_at(p, F.lit(0.75)).alias("m"), pa.length(p).alias("n"), pa.label_position(p, F.lit(0.25), F.lit(2.0), F.lit(True)).alias("l"))
    assert [tuple(q) for q in r["t"]] == [(4.0, 0.0), (8.0, 0.0)]
    assert (r["m"]["x"], r["m"]["y"]) == (10.0, 5.0) and r["n"] == 20 and tuple(r["l"]) == (5.0, -2.0)


def test_payload_lists(spark):
    got = spark.createDataFrame([(None,), ('["a","b"]',), ("[x",), ("z",)], "p string").select(pl.as_list(F.col("p")).alias("l")).collect()
    assert [r.l for r in got] == [[], ["a", "b"], ["[x"], ["z"]]


def test_diagram_files(spark, tmp_path):
    (tmp_path / "a.drawio").write_text(
        '<mxfile><mxGraphModel pageWidth="900"><root><mxCell id="0"/><mxCell id="1" parent="0"/>'
        '<mxCell id="2" parent="1" vertex="1" style="rounded=1" value="A &lt; B"><mxGeometry x="5" y="6" width="7" height="8" as="geometry"/></mxCell>'
        '<mxCell id="3" parent="1" edge="1" source="2" target="2"/></root></mxGraphModel></mxfile>'
    )
    rows = {r.id: r for r in dg.read_cells(spark, str(tmp_path)).collect()}
    assert set(rows) == {"2", "3"} and rows["2"].vertex and rows["2"].value == "A < B" and (rows["2"].x, rows["2"].height) == (5.0, 8.0) and rows["3"].source == "2"
    assert tuple(dg.read_page_sizes(spark, str(tmp_path)).first())[1:] == (900.0, 600.0)


def test_annotation_files(spark, tmp_path):
    (tmp_path / "gold.json").write_text('{"images":[{"id":1},{"id":2}],"annotations":[{"id":7,"image_id":1,"bbox":[0,0,2,3]}],"categories":[]}')
    (tmp_path / "res.json").write_text('[{"image_id":1,"category_id":3,"bbox":[1,2,3,4],"score":0.5},{"image_id":9,"category_id":3,"bbox":[1,2,3,4],"score":0.5}]')
    t = an.annotation_tables(an.read_documents(spark, str(tmp_path / "gold.json")), "json", ["source"])
    assert {(r.id, len(r.ann_ids)) for r in an.group_by_image(t["images"], t["annotations"], ["source"]).collect()} == {(1, 1), (2, 0)}
    d = an.number_detections(an.detections_from(an.read_documents(spark, str(tmp_path / "res.json")), "json", ["source"]), "source")
    assert {(r.id, r.area, r.iscrowd) for r in d.collect()} == {(1, 12.0, 0), (2, 12.0, 0)}
    assert [r.image_id for r in an.unknown_images(d, t["images"]).collect()] == [9]


def test_list_and_pair_images(spark, tmp_path):
    for n in ("b.png", "a.png", "c.txt"):
        (tmp_path / n).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in an.list_images(spark, str(tmp_path), [".png"]).collect()] == ["a.png", "b.png"]


def test_layer_of_container_type(spark):
    from tessella.functions import rules

    r = one(spark, rules.layer_level(rules.prompt_to_type(F.lit("Container box"))).alias("c"), rules.layer_level(F.lit("Text")).alias("t"))
    assert r["c"] == 5 and r["t"] == 4


def test_edges_from_markup(spark, tmp_path):
    from tessella.operators import cells
    from tessella.sources.diagrams import read_cells

    body = (
        '<mxCell id="0"/><mxCell id="1" parent="0"/>'
        '<mxCell id="a" parent="1" vertex="1"><mxGeometry x="10" y="20" width="30" height="40" as="geometry"/></mxCell>'
        '<mxCell id="b" parent="1" vertex="1"><mxGeometry x="100" y="20" width="30" height="40" as="geometry"/></mxCell>'
        '<mxCell id="tied" parent="1" edge="1" source="a" target="b"><mxGeometry as="geometry"><Array as="points"><mxPoint x="5" y="6"/><mxPoint x="7"/></Array></mxGeometry></mxCell>'
        '<mxCell id="free" parent="1" edge="1"><mxGeometry as="geometry"><mxPoint x="1" y="2" as="sourcePoint"/><mxPoint x="3" y="4" as="targetPoint"/></mxGeometry></mxCell>'
        '<mxCell id="dangling" parent="1" edge="1" source="a" target="gone"><mxGeometry as="geometry"/></mxCell>'
        '<mxCell id="l" parent="tied" vertex="1" connectable="0"><mxGeometry as="geometry"/></mxCell>'
    )
    (tmp_path / "d.xml").write_text(f"<mxGraphModel><root>{body}</root></mxGraphModel>")
    table = read_cells(spark, f"file://{tmp_path}/d.xml")
    edges = {r.id: r for r in cells.resolve_edges(table).collect()}
    assert set(edges) == {"tied", "free"}
    assert (edges["tied"].s_x, edges["tied"].t_x) == (10.0, 100.0) and [tuple(p) for p in edges["tied"].points] == [(5.0, 6.0), (7.0, 0.0)]
    assert (edges["free"].s_x, edges["free"].s_y, edges["free"].t_x, edges["free"].t_width) == (1.0, 2.0, 3.0, 0.0)
    assert [r.id for r in cells.edge_labels(table).collect()] == ["l"]


def test_mask_operations_on_runs(spark):
    import random

    rng = random.Random(6)
    rows = [[[int(rng.random() < 0.4) for _ in range(24)] for _ in range(2)] for _ in range(60)] + [[[0] * 24, [1] * 24], [[1] * 24, [1] * 24], [[0] * 24, [0] * 24]]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<int>, b array<int>").select("i", masks.encode(F.col("a")).alias("a"), masks.encode(F.col("b")).alias("b"))
    both = df.select("i", masks.combine(F.col("a"), F.col("b"), "intersection").alias("n"), masks.combine(F.col("a"), F.col("b"), "union").alias("u"), masks.bounds(F.col("a"), 4, 6).alias("r"))
    for r in both.select("i", masks.decode(F.col("n")).alias("n"), masks.decode(F.col("u")).alias("u"), "r").collect():
        a, b = rows[r.i]
        assert r.n == [x & y for x, y in zip(a, b)] and r.u == [x | y for x, y in zip(a, b)]
        on = [i for i, v in enumerate(a) if v]
        assert tuple(r.r) == ((min(i // 4 for i in on), min(i % 4 for i in on), max(i // 4 for i in on), max(i % 4 for i in on)) if on else (6, 4, 0, 0))
