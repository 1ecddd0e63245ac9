"""Annotation-set operators: category handling, query filters, splits, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.operators.numbering import ordinal, top_k


def merge_categories(rows: DataFrame, categories: DataFrame, col: str) -> DataFrame:
    """Replace merged category ids by the id that absorbed them (``categories``: id, merged array)."""
    lookup = categories.select(F.explode("merged").alias(col), F.col("id").alias("_kept"))
    return rows.join(lookup, col, "left").withColumn(col, F.coalesce("_kept", col)).drop("_kept")


# --- F09 query filters ------------------------------------------------------
def without_text(queries: DataFrame, text: str) -> DataFrame:
    return queries.where(~F.col("query_text").eqNullSafe(text))


def without_zero_area_hits(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """Drop a query when any of its objects has no width or no height."""
    flat = objects.where("x2 = x1 OR y2 = y1").select("query_id").distinct()
    return queries.join(flat, "query_id", "left_anti")


def without_many_objects(queries: DataFrame, limit: int) -> DataFrame:
    return queries.where(F.size("object_ids") <= limit)


def exhaustive_only(queries: DataFrame, kind: str) -> DataFrame:
    """``instance`` wants a true flag; ``pixel`` lets a missing flag pass."""
    if kind == "instance":
        return queries.where(F.coalesce("is_exhaustive", F.lit(False)))
    if kind == "pixel":
        return queries.where(F.coalesce("is_pixel_exhaustive", F.lit(True)))
    raise ValueError(f"unknown exhaustivity kind {kind}")


def without_empty_geometric(queries: DataFrame) -> DataFrame:
    return queries.where(~(F.col("has_box") & (F.col("query_text") == "geometric") & (F.size("object_ids") == 0)))


def semantic_only(queries: DataFrame) -> DataFrame:
    return queries.where(~F.col("has_box"))


def attach_objects(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """Add ``object_ids``, the sorted ids of a query's objects (empty when none)."""
    lists = objects.groupBy("query_id").agg(F.sort_array(F.collect_list("object_id")).alias("object_ids"))
    return queries.join(lists, "query_id", "left").withColumn("object_ids", F.coalesce("object_ids", F.array().cast("array<bigint>")))


# --- F10 object filters with the cascade ------------------------------------
def cascade(queries: DataFrame, links: DataFrame, drop_objects: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean a data point after its queries were filtered.

    ``queries`` (datapoint_id, query_id, image_no, stage, ...) are the survivors; ``links`` are
    (datapoint_id, query_id, object_id, ...) rows. Stages become dense from 0, objects that no
    query names (or that ``drop_objects`` marks) go, objects are numbered per image and images
    per data point without holes. Returns (queries, links with ``new_object_id``, failures).
    """
    point = ["datapoint_id"]
    stages = queries.select(*point, "stage").distinct()
    stages = stages.withColumn("new_stage", F.dense_rank().over(W.partitionBy(*point).orderBy("stage")) - 1)
    images = queries.select(*point, "image_no").distinct()
    images = images.withColumn("new_image_no", F.row_number().over(W.partitionBy(*point).orderBy("image_no")) - 1)
    mapped = queries.join(stages, [*point, "stage"]).join(images, [*point, "image_no"])
    live = links.where(~drop_objects).join(mapped.select(*point, "query_id", "image_no"), [*point, "query_id"])
    used = live.select(*point, "image_no", "object_id").distinct()
    numbered = ordinal(used, [*point, "image_no"], [F.floor(F.col("object_id") / 4096)], [F.col("object_id")], "new_object_id", start=0)
    final_links = live.join(numbered, [*point, "image_no", "object_id"])
    failures = (
        mapped.groupBy(*point).agg(F.min("stage").alias("first_stage")).where("first_stage > 0").select(*point)
    )
    return mapped, final_links, failures


# --- F12 / F08 / J08 / U03 --------------------------------------------------
def category_split(categories: DataFrame, known: Sequence[int], distractor: Sequence[int]) -> DataFrame:
    """Label category ids known / distractor / unknown (the rest)."""
    return categories.withColumn(
        "split",
        F.when(F.col("category_id").isin(list(known)), "known").when(F.col("category_id").isin(list(distractor)), "distractor").otherwise("unknown"),
    )


def keep_split(rows: DataFrame, split: DataFrame, name: str) -> DataFrame:
    return rows.join(split.where(F.col("split") == name).select("category_id"), "category_id", "left_semi")


# --- J14 --------------------------------------------------------------------
def image_category_queries(images: DataFrame, categories: DataFrame, annotations: DataFrame, negatives: bool, chunk: int = 1024) -> DataFrame:
    """One query per image and category with its annotation ids; empty ones only with ``negatives``.

    Without negatives no image x category grid is built. With them the categories travel in
    chunks: each image names every chunk number and meets the chunk's array by an equi-join,
    so the grid is never produced by pairing whole tables.
    """
    hits = annotations.groupBy("image_id", "category_id").agg(F.sort_array(F.collect_list("ann_id")).alias("ann_ids"))
    if not negatives:
        return hits
    chunks = (
        categories.select("category_id").distinct().withColumn("_chunk", F.floor(F.col("category_id") / chunk))
        .groupBy("_chunk").agg(F.collect_list("category_id").alias("_cats"))
    )
    top, low = chunks.agg(F.max("_chunk"), F.min("_chunk")).first()
    wide = (
        images.select("image_id").distinct().withColumn("_chunk", F.explode(F.sequence(F.lit(low), F.lit(top))))
        .join(chunks, "_chunk").select("image_id", F.explode("_cats").alias("category_id"))
    )
    return wide.join(hits, ["image_id", "category_id"], "left").withColumn(
        "ann_ids", F.coalesce("ann_ids", F.array().cast("array<bigint>"))
    )


# --- draws ------------------------------------------------------------------
def draw(seed: str, *cols: str) -> Column:
    """A repeatable random order for rows: hash of a seed and the row's key."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def uniform(seed: str, *cols: str) -> Column:
    return F.conv(F.substring(draw(seed, *cols), 1, 8), 16, 10).cast("double") / float(1 << 32)


# --- W11 / W12 --------------------------------------------------------------
def sample_stages(queries: DataFrame, key: str, stage: str, n: int, stride: int, start: Column, reverse: bool = False) -> DataFrame:
    """Keep ``n`` stages per item, ``stride`` apart (less when they do not fit), renumbered from 0.

    ``start`` gives a non-negative number whose remainder picks the first stage. Items with
    fewer than ``n`` stages give no rows.
    """
    stages = queries.select(key, stage).distinct()
    stages = stages.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(stage)) - 1)
    totals = stages.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    fits = (n - 1) * stride <= F.col("_n") - 1
    step = F.when(fits, F.lit(stride)).otherwise(F.floor((F.col("_n") - 1) / (n - 1)) if n > 1 else F.lit(1)).cast("int")
    picked = (
        stages.join(totals, key)
        .withColumn("_step", step)
        .withColumn("_first", F.pmod(start, F.col("_n") - (n - 1) * F.col("_step")))
        .where((F.col("_i") >= F.col("_first")) & (F.col("_i") <= F.col("_first") + (n - 1) * F.col("_step")))
        .where((F.col("_i") - F.col("_first")) % F.col("_step") == 0)
    )
    pos = ((F.col("_i") - F.col("_first")) / F.col("_step")).cast("int")
    picked = picked.select(key, stage, (F.lit(n - 1) - pos if reverse else pos).alias("new_stage"))
    return queries.join(picked, [key, stage])


def cap_queries(queries: DataFrame, key: str, limit: int, order: Column, positives_first: bool = True) -> DataFrame:
    """At most ``limit`` queries per item, those with objects first, the rest in random order."""
    first = [(F.size("object_ids") == 0).cast("int")] if positives_first else []
    return top_k(queries, [key], [*first, order, F.col("query_id")], limit)


def cap_queries_per_frame(queries: DataFrame, key: str, frame: str, position: str, limit: int, order: Column) -> DataFrame:
    """Choose positions on frame 0 and keep the same positions on every frame.

    Items whose frames all hold at most ``limit`` queries stay whole.
    """
    full = (
        queries.groupBy(key, frame).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(key).distinct()
    )
    first = queries.where(F.col(frame) == 0).join(full, key, "left_semi")
    kept = top_k(first, [key], [(F.size("object_ids") == 0).cast("int"), order, F.col(position)], limit).select(key, position)
    return queries.join(kept, [key, position], "left_semi").unionByName(queries.join(full, key, "left_anti"))


# --- W02 / W03 / W04 --------------------------------------------------------
def first_shard_rows(rows: DataFrame, keys: Sequence[str], shard: str) -> DataFrame:
    """All rows of the first shard in which a key appears.

    The winning shard per key is a partial aggregate joined back, so no window sorts the
    rows of a hot key in one task.
    """
    first = rows.groupBy(*keys).agg(F.min(shard).alias("_first"))
    return rows.join(first, list(keys)).where(F.col(shard) == F.col("_first")).drop("_first")


def merge_shards(rows: DataFrame, image: str, category: str, shard: str, score: str, id_col: str, k: int) -> DataFrame:
    return top_k(first_shard_rows(rows, [image, category], shard), [image], [F.col(score).desc(), F.col(id_col)], k)


def first_occurrence(rows: DataFrame, key: str, arrival: str) -> DataFrame:
    """One row per key: the earliest by ``arrival``."""
    rest = [c for c in rows.columns if c not in (key, arrival)]
    first = rows.groupBy(key).agg(F.min(F.struct(arrival, *rest)).alias("_m"))
    return first.select(key, "_m.*")


# --- W05 .. W10 ids ----------------------------------------------------------
def unique_track_ids(rows: DataFrame, video: str, track: str) -> DataFrame:
    """Give every (track, video) of a track seen in several videos its own id after the largest id."""
    pairs = rows.groupBy(track, video).agg(F.count(F.lit(1)).alias("_n"))
    spread = pairs.groupBy(track).agg(F.count(F.lit(1)).alias("_v"), F.min(video).alias("_first")).where("_v > 1").select(track)
    top = rows.agg(F.max(track).alias("_top"))
    fresh = ordinal(
        pairs.join(spread, track, "left_semi").select(track, video), [], [F.floor(F.col(track) / 256)], [F.col(track), F.col(video)], "_new"
    )
    fresh = fresh.withColumn("_top", F.lit(top.first()[0]))
    return (
        rows.join(fresh, [track, video], "left")
        .withColumn(track, F.coalesce(F.col("_new") + F.col("_top"), F.col(track)))
        .drop("_new", "_top")
    )


def pair_ids(positive: DataFrame, negative: DataFrame | None, video: str, category: str) -> DataFrame:
    """New contiguous id per (video, category): known pairs in order, then unseen negative pairs."""
    pos = positive.select(video, category).distinct().withColumn("_neg", F.lit(0))
    pairs = pos
    if negative is not None:
        neg = negative.select(video, category).distinct().join(pos, [video, category], "left_anti").withColumn("_neg", F.lit(1))
        pairs = pos.unionByName(neg)
    out = ordinal(pairs, [], [F.col("_neg"), F.floor(F.col(video) / 1024)], [F.col(video), F.col(category)], "new_id")
    return out.drop("_neg")


def class_agnostic_ids(rows: DataFrame, video: str, track: str) -> DataFrame:
    """Track ids that are unique over all videos (1, 2, ...) and category 1 everywhere."""
    pairs = rows.select(video, track).distinct()
    ids = ordinal(pairs, [], [F.floor(F.col(video) / 1024)], [F.col(video), F.col(track)], "new_track")
    return rows.join(ids, [video, track]).withColumn("category_id", F.lit(1))


def one_based(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shift the ids of every table that contains id 0 by one, and all references with them.

    The three flags are one aggregated row each; a reference is shifted with its table.
    """
    shift = {n: (1 if d.where("id = 0").limit(1).count() else 0) for n, d in (("i", images), ("c", categories), ("a", annotations))}
    return (
        images.withColumn("id", F.col("id") + shift["i"]),
        categories.withColumn("id", F.col("id") + shift["c"]),
        annotations.withColumn("id", F.col("id") + shift["a"])
        .withColumn("image_id", F.col("image_id") + shift["i"])
        .withColumn("category_id", F.col("category_id") + shift["c"]),
    )


def timesteps(images: DataFrame, video: str, frame: str) -> DataFrame:
    """Ordinal of each frame in its video, from 0; long videos are numbered in blocks of frames."""
    return ordinal(images, [video], [F.floor(F.col(frame) / 4096)], [F.col(frame)], "timestep", start=0)


def tracks_to_frames(tracks: DataFrame) -> DataFrame:
    """Per-track box arrays to one row per visible frame (NULL boxes are skipped)."""
    zipped = F.arrays_zip(F.col("bboxes").alias("bbox"), F.col("areas").alias("area"))
    return (
        tracks.select("video_id", F.col("id").alias("track_id"), "category_id", F.posexplode(zipped).alias("frame", "z"))
        .select("video_id", "track_id", "category_id", "frame", "z.bbox", "z.area")
        .where("bbox IS NOT NULL")
    )


# --- J09 / J16 ----------------------------------------------------------------
def fill_video_ids(annotations: DataFrame, images: DataFrame) -> DataFrame:
    lookup = images.select(F.col("id").alias("image_id"), F.col("video_id").alias("_v"))
    return annotations.join(lookup, "image_id", "left").withColumn("video_id", F.coalesce("video_id", "_v")).drop("_v")


def unresolved(rows: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is absent from ``lookup``; callers fail when it is not empty."""
    return rows.join(lookup, list(on), "left_anti")


# --- W15 --------------------------------------------------------------------
def assemble_tracks(frames: DataFrame, keys: Sequence[str], frame: str, n_frames: DataFrame, join_on: Sequence[str]) -> DataFrame:
    """Per-object dense frame arrays from sparse rows: gaps get score -1e8 and a NULL box.

    Track score is the mean of the seen scores; the label is the most frequent, smallest on ties.
    """
    keys = list(keys)
    votes = frames.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"))
    label = votes.groupBy(*keys).agg(F.max_by("label", F.struct("_n", (-F.col("label")).alias("_l"))).alias("label"))
    seen = frames.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(frame), F.struct("bbox", "score")))).alias("_by_frame"), F.avg("score").alias("score")
    )
    at = F.sequence(F.lit(0), F.col("n_frames") - 1)
    dense = F.transform(at, lambda t: F.try_element_at("_by_frame", t.cast("int")))
    return (
        seen.join(label, keys)
        .join(n_frames, list(join_on))
        .withColumn("_dense", dense)
        .withColumn("bboxes", F.transform("_dense", lambda d: d["bbox"]))
        .withColumn("scores", F.transform("_dense", lambda d: F.coalesce(d["score"], F.lit(-1e8))))
        .drop("_dense", "_by_frame")
    )
