"""Annotation sets, detection results, video annotations, phrase lists, tracking text, image lists.

Every reader has two halves: ``read_*`` brings whole files into a text column, ``*_from`` parses
such a column with a declared schema. One file is one row, so many files are many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DETECTION = "image_id bigint, category_id bigint, bbox array<double>, score double, segmentation array<array<double>>"
ANNOTATION = "id bigint, image_id bigint, category_id bigint, bbox array<double>, area double, iscrowd int"
ANNOTATION_SET = (
    "images array<struct<id: bigint, width: int, height: int, file_name: string, text_input: string, queried_category: string, is_instance_exhaustive: boolean>>, "
    f"annotations array<struct<{', '.join(c.replace(' ', ': ', 1) for c in ANNOTATION.split(', '))}>>, categories array<struct<id: bigint, name: string, supercategory: string>>"
)
VIDEO_SET = (
    "videos array<struct<id: bigint, width: int, height: int, length: int, file_names: array<string>>>, "
    "annotations array<struct<id: bigint, video_id: bigint, category_id: bigint, bboxes: array<array<double>>, areas: array<double>, iscrowd: int>>, "
    "categories array<struct<id: bigint, name: string>>, video_np_pairs array<struct<video_id: bigint, category_id: bigint, noun_phrase: string>>"
)


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: stem and json text."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("source"), F.col("value").alias("json"))


# --- S01 ----------------------------------------------------------------------
def detections_from(df: DataFrame, json: str, keys: Sequence[str] = ()) -> DataFrame:
    """Detection arrays as rows with ``ord``, area, iscrowd and a corner polygon where none is given."""
    fields = ", ".join(c.replace(" ", ": ", 1) for c in DETECTION.split(", "))
    rows = df.select(*keys, F.posexplode(F.from_json(json, f"array<struct<{fields}>>")).alias("ord", "d")).select(*keys, "ord", "d.*")
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    corners = F.array(F.array(x, y, x, y + h, x + w, y + h, x + w, y))
    return rows.withColumn("area", w * h).withColumn("iscrowd", F.lit(0)).withColumn("segmentation", F.coalesce("segmentation", corners))


def number_detections(rows: DataFrame, source: str) -> DataFrame:
    """Ids from 1 in (source, ord) order."""
    from tessella.operators.numbering import ordinal

    return ordinal(rows, [], [F.col(source), F.floor(F.col("ord") / 4096)], [F.col("ord")], "id")


def unknown_images(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Result image ids the ground truth lacks; a load with any must be refused."""
    return rows.select("image_id").distinct().join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti")


# --- S02 / S12 ------------------------------------------------------------------
def annotation_tables(df: DataFrame, json: str, keys: Sequence[str] = (), schema: str = ANNOTATION_SET) -> dict[str, DataFrame]:
    """One DataFrame per top-level list of the set, each with ``keys`` carried."""
    parsed = df.select(*keys, F.from_json(json, schema).alias("s"))
    names = [f.name for f in parsed.schema["s"].dataType.fields]
    return {n: parsed.select(*keys, F.explode(f"s.{n}").alias("r")).select(*keys, "r.*") for n in names}


def group_by_image(images: DataFrame, annotations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Images with their annotation ids, images without any included."""
    n = annotations.groupBy(*keys, "image_id").agg(F.sort_array(F.collect_list("id")).alias("ann_ids"))
    return images.join(n.withColumnRenamed("image_id", "id"), [*keys, "id"], "left").withColumn("ann_ids", F.coalesce("ann_ids", F.array().cast("array<bigint>")))


# --- S03 / S05 -------------------------------------------------------------------
def video_tracks(annotations: DataFrame, one_category: bool = False) -> DataFrame:
    """Track arrays without NULLs: hidden boxes become zeros, hidden areas 0 in the mean."""
    zero = F.array(*[F.lit(0.0)] * 4)
    areas = F.transform("areas", lambda a: F.coalesce(a, F.lit(0.0)))
    out = annotations.withColumn("bboxes", F.transform("bboxes", lambda b: F.coalesce(b, zero)))
    out = out.withColumn("area", F.try_divide(F.aggregate(areas, F.lit(0.0), lambda s, a: s + a), F.size("areas")))
    return out.withColumn("category_id", F.lit(-1).cast("bigint")) if one_category else out


def video_phrase_queries(videos: DataFrame, pairs: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One query per (video, phrase, frame), and the pairs whose phrase is not their category's name."""
    named = pairs.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    bad = named.where(~F.col("noun_phrase").eqNullSafe(F.col("name")))
    frames = videos.select(F.col("id").alias("video_id"), F.posexplode("file_names").alias("frame", "file_name"))
    return named.drop("name").join(frames, "video_id"), bad


# --- S04 ------------------------------------------------------------------------------
def image_phrase_queries(images: DataFrame) -> DataFrame:
    """Each image row is one phrase query."""
    return images.select(
        F.col("id").alias("image_id"), F.col("text_input").alias("query_text"), F.lit(0).alias("query_processing_order"), F.lit(True).alias("is_exhaustive"),
        F.lit(None).cast("array<double>").alias("input_box"),
    )


# --- S06 -------------------------------------------------------------------------------
def read_tracking_text(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited tracking lines as arrays of trimmed text fields."""
    return tracking_fields(spark.read.text(path), "value", sep)


def tracking_fields(lines: DataFrame, col: str, sep: str = ",") -> DataFrame:
    cells = F.transform(F.split(F.regexp_replace(col, f"[{sep}]\\s*$", ""), f"[{sep}]"), lambda c: F.trim(c))
    return lines.where(F.trim(F.col(col)) != "").select(*[c for c in lines.columns if c != col], cells.alias("cells"))


def tracking_rows(
    cells: DataFrame, time_col: int, id_col: int | None = None, valid: dict[int, list[str]] | None = None, crowd: dict[int, list[str]] | None = None,
    classes: tuple[int, dict[str, int]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, ignored): rows of the wanted values without negative ids, and crowd-ignore rows.

    Values are compared in lower case; class names are replaced by ids in both outputs.
    """
    field = lambda i: F.get("cells", F.lit(i))

    def among(rule: dict[int, list[str]] | None) -> list[Column]:
        return [F.lower(field(k)).isin(v) for k, v in (rule or {}).items()]

    t = cells.withColumn("t", field(time_col).cast("double").cast("int"))
    if classes:
        from tessella.functions.rules import lookup

        t = t.withColumn("class_id", lookup(F.lower(field(classes[0])), classes[1]))
    ignored = F.lit(False)
    for c in among(crowd):
        ignored = ignored | c
    keep = ~ignored
    for c in among(valid):
        keep = keep & c
    if id_col is not None:
        # A fraction is cut off, so anything above -1 counts; ids may pass 32 bits.
        keep = keep & (field(id_col).cast("double") > -1)
    return t.where(keep), t.where(ignored)


# --- S07 --------------------------------------------------------------------------------
LOG = "timestamp timestamp, module string, duration_ms double, status string"


def log_entries(lines: DataFrame, col: str = "value") -> DataFrame:
    """Request log lines; blank and malformed ones are skipped, further keys kept in ``extra``.

    The text is parsed as a map first: a line counts when it is a JSON object at all, and a field
    of the wrong kind only loses that field.
    """
    fields = F.from_json(F.col(col), "map<string,string>")
    named = lambda k: F.try_element_at("m", F.lit(k))
    good = lines.select(*[c for c in lines.columns if c != col], fields.alias("m")).where(F.col("m").isNotNull())
    return good.select(
        *[c for c in lines.columns if c != col], named("timestamp").try_cast("timestamp").alias("timestamp"), named("module").alias("module"),
        named("duration_ms").try_cast("double").alias("duration_ms"), named("status").alias("status"),
        F.map_filter("m", lambda k, _: ~k.isin("timestamp", "module", "duration_ms", "status")).alias("extra"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return log_entries(spark.read.text(path))


# --- S10 / J06 ----------------------------------------------------------------------------
def list_images(spark: SparkSession, path: str, suffixes: Sequence[str], recursive: bool = False, limit: int | None = None) -> DataFrame:
    """Paths and sizes of the images below ``path``, in path order; contents are not read."""
    pattern = "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    out = files.select("path", "length").orderBy("path")
    return out if limit is None else out.limit(limit)


def pair_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Mask path per image, from ``<stem>_mask.png`` or else ``<n>_<stem>/mask.png``; NULL when absent."""
    flat = masks.select(F.regexp_extract("path", r"([^/]+)_mask\.png$", 1).alias("stem"), F.col("path").alias("_flat")).where("stem <> ''")
    nested = masks.select(F.regexp_extract("path", r"[^/]*?_([^/]+)/mask\.png$", 1).alias("stem"), F.col("path").alias("_nested")).where("stem <> ''")
    nested = nested.groupBy("stem").agg(F.min("_nested").alias("_nested"))
    return images.join(flat, "stem", "left").join(nested, "stem", "left").withColumn("mask", F.coalesce("_flat", "_nested")).drop("_flat", "_nested")
