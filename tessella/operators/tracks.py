"""Track tables: per-class extraction, tracklet overlap, track suppression, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def class_sequences(rows: DataFrame, keys: Sequence[str], track: str, score: str) -> DataFrame:
    """Contiguous ids, score rank and totals of the tracks of each (sequence, class).

    Rows are reduced to one per track first; the windows only see that table.
    """
    keys = list(keys)
    per_track = rows.groupBy(*keys, track).agg(F.count(F.lit(1)).alias("dets"), F.max(score).alias(score))
    totals = per_track.groupBy(*keys).agg(F.sum("dets").alias("num_dets"), F.count(F.lit(1)).alias("num_ids"))
    w = W.partitionBy(*keys)
    return (
        per_track.withColumn("new_id", (F.row_number().over(w.orderBy(track)) - 1).cast("bigint"))
        .withColumn("score_rank", F.row_number().over(w.orderBy(F.col(score).desc(), F.col(track))).cast("bigint"))
        .join(totals, keys)
        .select(*keys, track, "new_id", "score_rank", "num_dets", "num_ids")
    )


def frame_objects(tracks: DataFrame, phrases: DataFrame, video: int, frame: int) -> DataFrame:
    """Objects visible in one frame of one video with their phrase, ordered by phrase."""
    seen = tracks.where(F.col("video_id") == video).withColumn("bbox", F.get("bboxes", F.lit(frame))).where("bbox IS NOT NULL")
    return seen.join(phrases, "category_id").orderBy("phrase", "id")


def track_nms(frames: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Tracks kept when those whose shared-frame IoU with a better kept one reaches ``threshold`` go.

    Inter and union are summed over the frames both tracks are visible in; pairs come from the
    per-frame spatial join, so tracks that never meet are never paired.
    """
    from tessella.functions import boxes as bx
    from tessella.functions.boxes import box
    from tessella.operators.spatial import self_pairs

    keys = list(keys)
    meet = self_pairs(frames, [*keys, "frame"], "track_id", lambda a, b: bx.intersection(box(a), box(b)) > 0)
    inter = meet.groupBy(*keys, "a_track_id", "b_track_id").agg(F.sum(bx.intersection(box("a_"), box("b_"))).alias("inter"))
    area = box().area
    side = lambda p: frames.select(*keys, "frame", F.col("track_id").alias(f"{p}_track_id"), area.alias(f"_{p}area"))
    both = (
        inter.select(*keys, "a_track_id", "b_track_id").join(side("a"), [*keys, "a_track_id"]).join(side("b"), [*keys, "b_track_id", "frame"])
        .groupBy(*keys, "a_track_id", "b_track_id").agg(F.sum(F.col("_aarea") + F.col("_barea")).alias("total"))
    )
    hits = inter.join(both, [*keys, "a_track_id", "b_track_id"]).where(
        F.when(F.col("total") > F.col("inter"), F.col("inter") / (F.col("total") - F.col("inter"))).otherwise(0.0) >= threshold
    )
    scores = frames.groupBy(*keys, "track_id").agg(F.max("score").alias("score"))
    return keep_by_pairs(scores, hits.select(*keys, F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b")), keys, "track_id")


def keep_by_pairs(nodes: DataFrame, pairs: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """First-fit over an explicit conflict table: best score first, ids break ties.

    Rounds settle every node that has no better open neighbour, then drop its neighbours; a
    round is two joins and an aggregate on the conflict table, whatever the group sizes.
    """
    from tessella.session import cut

    keys = list(keys)
    rank = F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("i"))
    ranks = nodes.select(*keys, F.col(id_col).alias("v"), rank.alias("r"))
    end = lambda n: ranks.select(*keys, F.col("v").alias(n), F.col("r").alias(f"r{n}"))
    e = pairs.join(end("a"), [*keys, "a"]).join(end("b"), [*keys, "b"])
    flip = F.col("ra") > F.col("rb")
    # Edges point from the better to the worse node.
    e = cut(e.select(*keys, F.when(flip, F.col("b")).otherwise(F.col("a")).alias("hi"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("lo")))
    dropped = None
    while not e.isEmpty():
        blocked = e.select(*keys, F.col("lo").alias("hi")).distinct()
        winners = e.select(*keys, "hi").distinct().join(blocked, [*keys, "hi"], "left_anti")
        lost = cut(e.join(winners, [*keys, "hi"], "left_semi").select(*keys, "lo").distinct())
        e = cut(
            e.join(lost, [*keys, "lo"], "left_anti").join(lost.withColumnRenamed("lo", "hi"), [*keys, "hi"], "left_anti")
        )
        dropped = lost if dropped is None else dropped.unionByName(lost)
    if dropped is None:
        return nodes.select(*keys, id_col)
    return nodes.select(*keys, id_col).join(dropped.withColumnRenamed("lo", id_col), [*keys, id_col], "left_anti")
