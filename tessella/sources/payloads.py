"""Service payloads: polymorphic result lists, base64 images, OCR responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.polygons import quad_from_flat


def encode_image(data: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(data), r"\r\n", "")


def decode_image(text: Column) -> Column:
    """Bytes of a base64 text, with or without a data-URL head."""
    return F.unbase64(F.regexp_replace(text, r"^data:[^,]*,", ""))


def as_list(payload: Column) -> Column:
    """NULL -> empty, JSON array text -> its strings, any other text -> one item."""
    t = F.trim(payload)
    parsed = F.from_json(t, "array<string>")
    return (
        F.when(payload.isNull(), F.array().cast("array<string>"))
        .when(t.startswith("[") & parsed.isNotNull(), parsed)
        .otherwise(F.array(payload))
    )


OCR = (
    "pages array<struct<lines: array<struct<content: string, polygon: array<double>, spans: array<struct<offset: bigint, length: bigint>>>>, "
    "words: array<struct<content: string, polygon: array<double>>>>>"
)


def ocr_lines(df: DataFrame, json: str) -> DataFrame:
    """Lines of OCR responses as text blocks with four-point polygons."""
    r = df.withColumn("_r", F.from_json(json, OCR)).withColumn("_p", F.explode_outer("_r.pages"))
    lines = r.select(*[c for c in df.columns if c != json], F.posexplode("_p.lines").alias("ord", "_l"))
    return lines.select(*[c for c in lines.columns if c != "_l"], F.col("_l.content").alias("text"), quad_from_flat(F.col("_l.polygon")).alias("polygon"), F.col("_l.spans").alias("spans"))


def ocr_words(df: DataFrame, json: str) -> DataFrame:
    """Word polygons of OCR responses."""
    r = df.withColumn("_r", F.from_json(json, OCR)).withColumn("_p", F.explode_outer("_r.pages"))
    words = r.select(*[c for c in df.columns if c != json], F.posexplode("_p.words").alias("ord", "_w"))
    return words.select(*[c for c in words.columns if c != "_w"], quad_from_flat(F.col("_w.polygon")).alias("polygon"))
