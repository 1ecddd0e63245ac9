"""Sources and sinks: text is derived from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import rules
from tessella.functions.boxes import box
from tessella.functions.rules import half_up
from tessella.operators import cells as ce, evalmetrics as ev
from tessella.plans import q_eval  # noqa: F401  (brings the video_frames relation)
from tessella.plans.registry import query
from tessella.plans.relations import SQL, det, rel, with_views
from tessella.sources import annotations as an, diagrams as dg, payloads as pl, sinks
from tessella.session import cut, scratch


def _orders_json(spark, sf, body):
    """One JSON array of detection objects per order."""
    return det(spark, sf).withColumn("order_id", F.expr("det_id div 1000")).groupBy("order_id").agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("det_id", body.alias("b")))), lambda r: r["b"])).alias("json")
    )


def _xywh():
    return F.array(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


@query(
    "S01_detection_results",
    with_views("det")
    + "SELECT row_number() OVER (ORDER BY det_id) AS id, image_id, category_id, (x2 - x1) * (y2 - y1) AS area, y2 AS poly_y2 FROM det",
)
def s01(spark, sf):
    body = F.struct("image_id", "category_id", _xywh().alias("bbox"), "score")
    rows = an.detections_from(_orders_json(spark, sf, body), "json", ["order_id"])
    from tessella.operators.numbering import ordinal

    n = ordinal(rows, [], [F.floor(F.col("order_id") / 64)], [F.col("order_id"), F.col("ord")], "id")
    return n.select("id", "image_id", F.col("category_id").cast("int"), "area", F.get(F.get("segmentation", F.lit(0)), F.lit(3)).alias("poly_y2"))


def _sets(spark, sf):
    """One annotation set per image, as JSON text."""
    ann = F.struct(F.col("det_id").alias("id"), "image_id", "category_id", _xywh().alias("bbox"))
    return det(spark, sf).groupBy("image_id").agg(F.sort_array(F.collect_list(ann)).alias("a")).select(
        F.concat(F.lit("set"), F.col("image_id").cast("string")).alias("source"),
        F.to_json(F.struct(
            F.array(F.struct(F.col("image_id").alias("id"), F.lit(100).alias("width"), F.concat(F.lit("thing "), (F.col("image_id") % 9).cast("string")).alias("text_input")),
                    F.struct((-F.col("image_id") - 1).alias("id"), F.lit(100).alias("width"), F.lit("none").alias("text_input"))).alias("images"),
            F.col("a").alias("annotations"),
            F.array(F.struct(F.lit(1).alias("id"), F.lit("one").alias("name"))).alias("categories"),
        )).alias("json"),
    )


@query(
    "S02_annotation_set",
    with_views("det")
    + "SELECT image_id AS id, count(*) AS n_anns FROM det GROUP BY image_id UNION ALL SELECT DISTINCT -image_id - 1, 0 FROM det",
)
def s02(spark, sf):
    t = an.annotation_tables(_sets(spark, sf), "json", ["source"])
    return an.group_by_image(t["images"], t["annotations"], ["source"]).select("id", F.size("ann_ids").cast("bigint").alias("n_anns"))


@query(
    "S12_annotation_frames",
    with_views("det")
    + "SELECT concat('set', image_id) AS source, det_id AS id, category_id FROM det",
)
def s12(spark, sf):
    t = an.annotation_tables(_sets(spark, sf), "json", ["source"])
    return t["annotations"].select("source", "id", F.col("category_id").cast("int"))


@query(
    "S04_image_phrases",
    with_views("det")
    + "SELECT image_id, concat('thing ', image_id % 9) AS query_text, 0 AS query_processing_order FROM (SELECT DISTINCT image_id FROM det) UNION ALL SELECT DISTINCT -image_id - 1, 'none', 0 FROM det",
)
def s04(spark, sf):
    images = an.annotation_tables(_sets(spark, sf), "json", ["source"])["images"]
    return an.image_phrase_queries(images).select("image_id", "query_text", "query_processing_order")


def _video_json(spark, sf):
    hidden = F.when((F.col("det_id") % 3 == 0), F.lit(None)).otherwise(_xywh())
    area = F.when((F.col("det_id") % 3 == 0), F.lit(None)).otherwise(box().area)
    ann = F.struct(F.col("det_id").alias("id"), F.col("image_id").alias("video_id"), "category_id", F.array(hidden, _xywh()).alias("bboxes"), F.array(area, box().area).alias("areas"))
    d = det(spark, sf).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("det_id", F.to_json(ann).alias("j")))).alias("a"))
    video = F.format_string(
        '"videos":[{"id":%d,"length":3,"file_names":["f0","f1","f2"]}],"categories":[{"id":1,"name":"a"},{"id":2,"name":"b"}],"video_np_pairs":[{"video_id":%d,"category_id":1,"noun_phrase":"a"},{"video_id":%d,"category_id":2,"noun_phrase":"%s"}]',
        "image_id", "image_id", "image_id", F.when(F.col("image_id") % 5 == 0, "x").otherwise("b"),
    )
    return d.select("image_id", F.concat(F.lit("{"), video, F.lit(',"annotations":['), F.array_join(F.transform("a", lambda r: r["j"]), ","), F.lit("]}")).alias("json"))


@query(
    "S03_video_annotations",
    with_views("det")
    + "SELECT det_id AS id, CASE WHEN det_id % 3 = 0 THEN 0e0 ELSE x2 - x1 END AS w0, CASE WHEN det_id % 3 = 0 THEN (x2 - x1) * (y2 - y1) / 2 ELSE (x2 - x1) * (y2 - y1) END AS area, -1 AS category_id FROM det",
)
def s03(spark, sf):
    t = an.annotation_tables(_video_json(spark, sf), "json", schema=an.VIDEO_SET)
    v = an.video_tracks(t["annotations"], one_category=True)
    return v.select("id", F.get(F.get("bboxes", F.lit(0)), F.lit(2)).alias("w0"), "area", F.col("category_id").cast("int"))


@query(
    "S05_video_phrases",
    with_views("det")
    + """, v AS (SELECT DISTINCT image_id AS video_id FROM det), p AS (SELECT video_id, 1 AS category_id, 'a' AS noun_phrase FROM v UNION ALL SELECT video_id, 2, CASE WHEN video_id % 5 = 0 THEN 'x' ELSE 'b' END FROM v)
SELECT video_id, category_id, noun_phrase, CAST(frame AS INT) AS frame, concat('f', frame) AS file_name FROM (SELECT *, unnest([0, 1, 2]) AS frame FROM p)""",
)
def s05(spark, sf):
    t = an.annotation_tables(_video_json(spark, sf), "json", schema=an.VIDEO_SET)
    q, _ = an.video_phrase_queries(t["videos"], t["video_np_pairs"], t["categories"].distinct())
    return q.select("video_id", F.col("category_id").cast("int"), "noun_phrase", "frame", "file_name")


@query(
    "S05_phrase_mismatches",
    with_views("det") + "SELECT DISTINCT image_id AS video_id, 'x' AS noun_phrase FROM det WHERE image_id % 5 = 0",
)
def s05_bad(spark, sf):
    t = an.annotation_tables(_video_json(spark, sf), "json", schema=an.VIDEO_SET)
    return an.video_phrase_queries(t["videos"], t["video_np_pairs"], t["categories"].distinct())[1].select("video_id", "noun_phrase")


_LINE = "concat(image_id, ', ', CASE WHEN category_id = 7 THEN -1 ELSE det_id END, ', ', CASE category_id % 3 WHEN 0 THEN 'Car' WHEN 1 THEN 'Person' ELSE 'Crowd' END, ', ', x1)"


@query(
    "S06_tracking_text",
    with_views("det")
    + """SELECT CAST(image_id AS INT) AS t, det_id AS id, category_id % 3 + 1 AS class_id, FALSE AS ignored FROM det WHERE category_id % 3 = 1 AND category_id <> 7
UNION ALL SELECT CAST(image_id AS INT), det_id, 3, TRUE FROM det WHERE category_id % 3 = 2""",
)
def s06(spark, sf):
    lines = det(spark, sf).select(F.expr(_LINE).alias("value"))
    rows, ignored = an.tracking_rows(
        an.tracking_fields(lines, "value"), 0, 1, valid={2: ["person"]}, crowd={2: ["crowd"]}, classes=(2, {"car": 1, "person": 2, "crowd": 3})
    )
    part = lambda d, f: d.select("t", F.get("cells", F.lit(1)).cast("bigint").alias("id"), "class_id", F.lit(f).alias("ignored"))
    return part(rows, False).unionByName(part(ignored, True))


@query(
    "S07_request_log",
    "SELECT event_type AS module, count(*) AS n, round(sum(value), 4) AS total_ms FROM events WHERE event_id % 10 <> 3 AND event_id % 17 <> 5 GROUP BY event_type",
)
def s07(spark, sf):
    line = (
        F.when(F.col("event_id") % 10 == 3, "{broken").when(F.col("event_id") % 17 == 5, "")
        .otherwise(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("event_type").alias("module"), F.col("value").alias("duration_ms"), F.lit("success").alias("status"), F.lit("x").alias("host"))))
    )
    entries = an.log_entries(rel(spark, sf, "events").select(line.alias("value")))
    return entries.groupBy("module").agg(F.count(F.lit(1)).alias("n"), half_up(F.sum("duration_ms"), 4).alias("total_ms"))


def _diagrams(spark, sf):
    """A diagram text per image."""
    cell = F.format_string(
        '<mxCell id="%d" parent="1" style="rounded=%d;" value="v%d" vertex="1"><mxGeometry x="%d" y="%d" width="%d" height="10" as="geometry"/></mxCell>',
        "det_id", "category_id", "category_id", F.col("x1").cast("int"), F.col("y1").cast("int"), (F.col("x2") - F.col("x1")).cast("int"),
    )
    head = '<mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>'
    return det(spark, sf).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("det_id", cell.alias("c")))).alias("a")).select(
        "image_id", F.concat(F.lit(head), F.array_join(F.transform("a", lambda r: r["c"]), ""), F.lit("</root></mxGraphModel>")).alias("xml")
    )


@query(
    "S08_diagram_cells",
    with_views("det")
    + "SELECT image_id, CAST(det_id AS VARCHAR) AS id, concat('v', category_id) AS value, x1 AS x, y1 AS y, x2 - x1 AS width FROM det",
)
def s08(spark, sf):
    return dg.cells_from_column(_diagrams(spark, sf), "xml").select("image_id", "id", "value", "x", "y", "width")


@query(
    "S09_ocr_response",
    with_views("det")
    + "SELECT image_id, det_id, concat('t', category_id) AS text, x1 AS px0, CASE WHEN category_id = 1 THEN 0 ELSE y2 END AS py3, det_id AS span_at FROM det",
)
def s09(spark, sf):
    b = box()
    full = F.array(b.x1, b.y1, b.x2, b.y1, b.x2, b.y2, b.x1, b.y2)
    poly = F.when(F.col("category_id") == 1, F.array(b.x1, b.y1)).otherwise(full)
    line = F.struct(F.concat(F.lit("t"), F.col("category_id").cast("string")).alias("content"), poly.alias("polygon"), F.array(F.struct(F.col("det_id").alias("offset"), F.lit(3).alias("length"))).alias("spans"))
    d = det(spark, sf).select("image_id", "det_id", F.to_json(F.struct(F.array(F.struct(F.array(line).alias("lines"))).alias("pages"))).alias("json"))
    t = pl.ocr_lines(d, "json")
    return t.select("image_id", "det_id", "text", F.get("polygon", F.lit(0))["x"].alias("px0"), F.get("polygon", F.lit(3))["y"].alias("py3"), F.get("spans", F.lit(0))["offset"].alias("span_at"))


@query("S10_list_files")
def s10(spark, sf):
    """Files of the data folder by suffix (the image lister, on what is there)."""
    return an.list_images(spark, sf, [".parquet"], recursive=True).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query(
    "S11_payload_lists",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 2 ELSE 1 END AS n, CASE WHEN doc_id % 4 = 1 THEN lang WHEN doc_id % 4 = 2 THEN source WHEN doc_id % 4 = 3 THEN '[broken' END AS first_item FROM documents",
)
def s11(spark, sf):
    k = F.col("doc_id") % 4
    p = F.when(k == 1, F.to_json(F.array("lang", "source"))).when(k == 2, F.col("source")).when(k == 3, "[broken")
    items = pl.as_list(p)
    return rel(spark, sf, "documents").select("doc_id", F.size(items).alias("n"), F.get(items, F.lit(0)).alias("first_item"))


@query(
    "J06_image_masks",
    with_views("det")
    + "SELECT DISTINCT image_id, CASE image_id % 3 WHEN 0 THEN concat('/m/img', image_id, '_mask.png') WHEN 1 THEN concat('/m/7_img', image_id, '/mask.png') END AS mask FROM det",
)
def j06(spark, sf):
    images = det(spark, sf).select("image_id").distinct().withColumn("stem", F.concat(F.lit("img"), F.col("image_id").cast("string")))
    masks = images.where("image_id % 3 < 2").select(
        F.when(F.col("image_id") % 3 == 0, F.concat(F.lit("/m/"), F.col("stem"), F.lit("_mask.png"))).otherwise(F.concat(F.lit("/m/7_"), F.col("stem"), F.lit("/mask.png"))).alias("path")
    )
    return an.pair_masks(images, masks).select("image_id", "mask")


# --- sinks -------------------------------------------------------------------------------
@query("K01_write_predictions")
def k01(spark, sf):
    """Predictions written as JSON lines and read back."""
    path = scratch(spark)
    sinks.write_predictions(det(spark, sf).select("image_id", "category_id", F.transform(_xywh(), lambda v: v / 7).alias("bbox"), (F.col("score") / 7).alias("score")), path)
    return spark.read.schema("image_id bigint, category_id int, bbox array<double>, score double").json(path)


@query(
    "K02_image_metadata",
    with_views("det")
    + "SELECT image_id, count(*) AS total_elements, CAST(count(DISTINCT grp) AS INT) AS n_groups, CAST(count(DISTINCT element_type) AS INT) AS n_types FROM det GROUP BY image_id",
)
def k02(spark, sf):
    return sinks.image_metadata(det(spark, sf), "image_id", "det_id").select("image_id", "total_elements", "n_groups", "n_types")


@query("K03_quality_report")
def k03(spark, sf):
    from tessella.operators.overlaps import union_area

    d = det(spark, sf)
    score = union_area(d, ["image_id"], cell=16.0).withColumn("overall_score", F.greatest(F.lit(0.0), F.lit(100.0) - F.col("covered") / 2000 * 100))
    return sinks.quality_report(score, d.withColumn("area", box().area), "image_id")


@query("K04_metric_document")
def k04(spark, sf):
    from tessella.plans.q_eval import _rows

    rows = _rows(spark, sf).withColumn("video_id", F.expr("image_id div 20"))
    return sinks.metric_document(ev.dataset_scores(rows), ev.per_pair_scores(rows, ["video_id"]), ["video_id"])


@query("K04_metric_document_crowded")
def k04_crowded(spark, sf):
    from tessella.plans.q_eval import _rows

    rows = _rows(spark, sf, "gt", "det").withColumn("video_id", F.expr("image_id div 20"))
    return sinks.metric_document(ev.dataset_scores(rows), ev.per_pair_scores(rows, ["video_id"]), ["video_id"])


_Z = "CASE WHEN element_type = 'section_panel' THEN 0 WHEN element_type = 'rectangle' THEN 1 WHEN element_type IN ('icon', 'picture') THEN 2 WHEN element_type = 'arrow' THEN 3 WHEN element_type = 'text' THEN 4 ELSE 5 END"
_MERGED = f"""SELECT image_id, concat('<mxfile><diagram><mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>', string_agg(concat('<mxCell id="', rn + 1, '" value="', det_id, '"/>'), '' ORDER BY rn), '</root></mxGraphModel></diagram></mxfile>') AS xml
FROM (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY {{layer}}, (x2 - x1) * (y2 - y1) DESC, det_id) AS rn FROM det) GROUP BY image_id"""


@query("K05_merged_document", with_views("det") + _MERGED.format(layer=_Z))
def k05(spark, sf):
    d = det(spark, sf).withColumn("layer_level", rules.layer_level(F.col("element_type"))).withColumn(
        "markup", F.concat(F.lit('<mxCell id="'), F.col("det_id").cast("string"), F.lit('" value="'), F.col("det_id").cast("string"), F.lit('"/>'))
    )
    return sinks.document_markup(ce.z_order(d, "image_id", "det_id"), "image_id")


@query(
    "U02_merge_diagrams",
    with_views("det")
    + "SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY layer, area DESC, id) + 1 AS cell_id FROM (SELECT image_id, CAST(det_id AS VARCHAR) AS id, 1 AS layer, (x2 - x1) * 10 AS area FROM det UNION ALL SELECT image_id, concat('text_', det_id), 4, (x2 - x1) * 10 FROM det)",
)
def u02(spark, sf):
    # Read as shapes and as text, to count and to number: the markup is only parsed once.
    shapes = cut(dg.cells_from_column(_diagrams(spark, sf), "xml").select("image_id", "id", "x", "y", "width", "height")).withColumn("layer_level", F.lit(1))
    text = shapes.withColumn("id", F.concat(F.lit("text_"), F.col("id"))).withColumn("layer_level", F.lit(4))
    both = shapes.unionByName(text).select("image_id", "id", "layer_level", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"))
    return ce.z_order(both, "image_id", "id").select("image_id", "id", "cell_id")


@query(
    "K06_metric_table",
    with_views("det")
    + "SELECT CAST(image_id AS VARCHAR) AS seq, CAST(count(*) AS VARCHAR) AS dets FROM det GROUP BY image_id UNION ALL SELECT 'COMBINED', CAST(count(*) AS VARCHAR) FROM det",
)
def k06(spark, sf):
    """Metric rows with their COMBINED row, written as CSV and read back."""
    path = scratch(spark)
    d = det(spark, sf).withColumnRenamed("image_id", "seq")
    n = d.groupBy("seq").agg(F.count(F.lit(1)).alias("dets"))
    sinks.write_metric_table(sinks.metric_table(n, d.agg(F.count(F.lit(1)).alias("dets")), ["dets"]), path)
    return spark.read.option("header", True).schema("seq string, dets string").csv(path)


# --- cells --------------------------------------------------------------------------------
def _cells_views(recursive=False):
    return ("WITH RECURSIVE " if recursive else "WITH ") + f"cells AS ({SQL['cells']})"


@query(
    "J13_absolute_positions",
    _cells_views(True)
    + """, up AS (SELECT doc, id, parent AS ptr, 0e0 AS ox, 0e0 AS oy FROM cells
  UNION ALL SELECT u.doc, u.id, c.parent, u.ox + c.x, u.oy + c.y FROM up u JOIN cells c ON c.doc = u.doc AND c.id = u.ptr AND u.ptr NOT IN ('0', '1'))
SELECT doc, id, max(ox) AS off_x, max(oy) AS off_y FROM up GROUP BY doc, id""",
)
def j13(spark, sf):
    return ce.parent_offsets(rel(spark, sf, "cells"))


@query(
    "J12_resolved_edges",
    _cells_views()
    + """SELECT e.doc, e.id, s.x AS s_x, t.width AS t_width, CASE WHEN e.style LIKE '%orthogonalEdgeStyle%' THEN 'orthogonal' WHEN e.style LIKE '%curvedEdge%' THEN 'curved' ELSE 'straight' END AS edge_style,
  CASE WHEN e.style LIKE '%dashed=1' THEN 'dashed' WHEN e.style LIKE '%dashed=dotted' THEN 'dotted' END AS dash, CASE WHEN e.style LIKE '%endArrow=open' THEN 'open' ELSE 'classic' END AS end_arrow
FROM cells e JOIN cells s ON s.doc = e.doc AND s.id = e.source AND s.vertex JOIN cells t ON t.doc = e.doc AND t.id = e.target AND t.vertex WHERE NOT e.vertex""",
)
def j12(spark, sf):
    point = "struct<x: double, y: double>"
    c = rel(spark, sf, "cells").withColumn("source_point", F.lit(None).cast(point)).withColumn("target_point", F.lit(None).cast(point))
    return ce.resolve_edges(c).select("doc", "id", "s_x", "t_width", "edge_style", "dash", "end_arrow")


# --- extension surface ----------------------------------------------------------------------
@query(
    "E03_parameter_sweep",
    with_views("det")
    + "SELECT i.image_id, d.d AS dilate, e.e AS expand FROM (SELECT DISTINCT image_id FROM det) i, (SELECT unnest([0, 3]) AS d) d, (SELECT unnest([1, 2]) AS e) e WHERE NOT (i.image_id % 4 = 0 AND d.d = 3 AND e.e = 1)",
)
def e03(spark, sf):
    from tessella.operators.sweeps import sweep

    images = det(spark, sf).select("image_id").distinct()
    done = images.where("image_id % 4 = 0").select("image_id", F.lit(3).alias("dilate"), F.lit(1).alias("expand"))
    return sweep(images, [0, 3], [1, 2], done, "image_id")


@query("E01_score_rows", with_views("det") + "SELECT det_id, x1, x2, x1 * 0.5e0 + x2 AS model_score FROM det")
def e01(spark, sf):
    """A user model (here a linear score) applied batch by batch."""
    from tessella.operators.extension import linear_model, score_rows

    return score_rows(det(spark, sf).select("det_id", "x1", "x2"), linear_model, "det_id bigint, x1 double, x2 double, model_score double")


@query(
    "E02_metric_registry",
    with_views("det", "video_frames")
    + """, p AS (SELECT video_id, count(*) AS dets, count(DISTINCT track_id) AS ids, count(DISTINCT frame) AS frames FROM video_frames GROUP BY video_id)
SELECT * FROM p UNION ALL SELECT NULL, CAST(sum(dets) AS BIGINT), CAST(sum(ids) AS BIGINT), CAST(sum(frames) AS BIGINT) FROM p""",
)
def e02(spark, sf):
    from tessella.operators.extension import METRICS, evaluate

    return evaluate(METRICS["counts"], rel(spark, sf, "video_frames"), "video_id")
