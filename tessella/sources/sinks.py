"""Writers: predictions, metadata, reports, diagrams, metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def rounded_predictions(df: DataFrame, digits: int = 5) -> DataFrame:
    """Box coordinates and score rounded for the prediction files."""
    return df.withColumn("bbox", F.transform("bbox", lambda c: F.bround(c, digits))).withColumn("score", F.bround("score", digits))


def write_predictions(df: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON lines, one file per partition; one file only on request (a small merged result)."""
    out = rounded_predictions(df)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").json(path)


def image_metadata(elements: DataFrame, key: str, id_col: str) -> DataFrame:
    """One JSON document per image with elements by group and by type.

    The lists of a document are its content, so a document is as large as its image's element list.
    """
    e = F.struct(F.col(id_col).alias("id"), "element_type", F.col("grp").alias("source_group"), "score")

    def nested(col):
        lists = elements.groupBy(key, col).agg(F.sort_array(F.collect_list(e)).alias("l"))
        return lists.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(col, "l")))).alias(f"by_{col}"))

    whole = elements.groupBy(key).agg(F.count(F.lit(1)).alias("total_elements"))
    doc = whole.join(nested("grp"), key).join(nested("element_type"), key)
    body = F.struct("total_elements", F.col("by_grp").alias("by_group"), F.col("by_element_type").alias("by_type"))
    return doc.select(key, "total_elements", F.size("by_grp").alias("n_groups"), F.size("by_element_type").alias("n_types"), F.to_json(body).alias("json"))


def write_text_documents(docs: DataFrame, col: str, path: str, key: str) -> None:
    """One folder per document key holding its text."""
    docs.select(key, col).write.mode("overwrite").partitionBy(key).text(path)


def quality_report(scores: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Quality document per image: score, regions by falling area, and whether it needs another pass."""
    r = regions.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("area")).alias("o"), F.array("x1", "y1", "x2", "y2").alias("bbox"), "area"))).alias("_r")
    )
    out = scores.join(r, key, "left").withColumn("needs_refinement", F.coalesce(F.size("_r") > 0, F.lit(False)))
    body = F.struct("overall_score", F.transform("_r", lambda x: F.struct(x["bbox"].alias("bbox"), x["area"].alias("area"))).alias("bad_regions"), "needs_refinement")
    return out.select(key, "needs_refinement", F.to_json(body).alias("json"))


def metric_document(dataset: DataFrame, per_pair: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dataset metrics and per-pair rows as JSON lines of one file set, tagged by level."""
    a = dataset.select(F.lit("dataset").alias("level"), F.to_json(F.struct(*dataset.columns)).alias("json"))
    b = per_pair.select(F.lit("pair").alias("level"), F.to_json(F.struct(*keys, *[c for c in per_pair.columns if c not in keys])).alias("json"))
    return a.unionByName(b)


# --- K05 / U02 --------------------------------------------------------------------------
def document_markup(fragments: DataFrame, doc: str) -> DataFrame:
    """Ordered fragments of each document, renumbered from 2 under one root.

    ``fragments`` needs ``cell_id`` (see ``z_order``) and ``markup``; a document is one text value.
    """
    renamed = F.regexp_replace("markup", r'^(<mxCell\b[^>]*?\s)id="[^"]*"', F.concat(F.lit('$1id="'), F.col("cell_id").cast("string"), F.lit('"')))
    body = fragments.withColumn("_m", renamed).groupBy(doc).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_id", "_m"))), lambda r: r["_m"]), "").alias("_body")
    )
    head = '<mxfile><diagram><mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>'
    return body.select(doc, F.concat(F.lit(head), F.col("_body"), F.lit("</root></mxGraphModel></diagram></mxfile>")).alias("xml"))


# --- K06 ------------------------------------------------------------------------------------
def metric_table(per_sequence: DataFrame, combined: DataFrame, columns: Sequence[str], name: str = "seq") -> DataFrame:
    """Per-sequence rows in fixed column order with the COMBINED row last."""
    rows = per_sequence.select(F.col(name).cast("string").alias(name), *columns).withColumn("_last", F.lit(0))
    total = combined.select(F.lit("COMBINED").alias(name), *columns).withColumn("_last", F.lit(1))
    return rows.unionByName(total).orderBy("_last", name).drop("_last")


def write_metric_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)
