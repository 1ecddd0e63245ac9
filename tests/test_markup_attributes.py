"""Cells out of a markup column: missing, empty and repeated attributes, and each tag searched for once."""

from pyspark.sql import functions as F

from tessella.sources import diagrams as dg


def test_attributes(spark):
    xml = (
        '<root><mxCell id="0"/><mxCell id="a" value="" style="x=1;" vertex="1"><mxGeometry x="3" width="bad" as="geometry"/></mxCell>'
        '<mxCell parent="1" edge="1" id="b" id="c"/></root>'
    )
    rows = dg.cells_from_column(spark.createDataFrame([(1, xml)], "k int, xml string"), "xml")
    got = [(r.id, r.parent, r.style, r.value, r.vertex, r.edge, r.x, r.y, r.width) for r in rows.collect()]
    assert got == [("a", None, "x=1;", "", True, False, 3.0, 0.0, 0.0), ("b", "1", None, None, False, True, 0.0, 0.0, 0.0)]
    plan = rows.groupBy("id").agg(F.sum("x"), F.sum("y"), F.sum("width"), F.sum("height"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mxGeometry") == 1
