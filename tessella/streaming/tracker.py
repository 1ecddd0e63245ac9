"""Track state per video: association, life-cycle, delayed emission; the stream in ``videos`` shares the step."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessella.operators.assign import best_columns
from tessella.operators.numbering import running_max
from tessella.operators.spatial import self_pairs, span_for_ratio

OUTPUT = (
    "video_id bigint, frame bigint, obj_id bigint, det_id bigint, event string, keep_alive int, suppressed boolean, removed boolean, "
    "x1 double, y1 double, x2 double, y2 double"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


@dataclass(frozen=True)
class Settings:
    """Association thresholds and life-cycle limits."""

    iou: float = 0.5
    iou_track: float = 0.5
    new_score: float = 0.0
    start_delay: int = 6
    unmatched_limit: int = 3
    duplicate_limit: int = 3
    keep_start: int = 0
    keep_min: int = -1
    keep_max: int = 8
    emit_delay: int = 0
    reorder: int = 0  # frames that a stream waits for late ones


def fresh() -> dict:
    return {"tracks": {}, "pairs": {}, "next": 0, "buffer": [], "gone": []}


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def step(state: dict, video: int, frame: int, dets: list[tuple], cfg: Settings) -> list[tuple]:
    """Advance one frame. ``dets``: (det_id, score, x1, y1, x2, y2). Returns output rows.

    A track keeps the box of its last matched detection.
    """
    tracks = state["tracks"]
    ids = list(tracks)
    db = np.array([d[2:] for d in dets], float).reshape(-1, 4)
    tb = np.array([tracks[i]["box"] for i in ids], float).reshape(-1, 4)
    over = _iou(db, tb)
    held: dict[str, int] = {}
    if len(dets) and ids:
        for d, t in enumerate(best_columns(over)):
            if t >= 0 and over[d, t] >= cfg.iou_track:
                held[ids[t]] = d
    touching = [[ids[t] for t in np.flatnonzero(over[d] >= cfg.iou)] for d in range(len(dets))] if ids else [[] for _ in dets]
    born = []
    for d, hits in enumerate(touching):
        if not hits and dets[d][1] >= cfg.new_score:
            name = str(state["next"])
            state["next"] += 1
            tracks[name] = {"box": list(dets[d][2:]), "first": frame, "keep": cfg.keep_start, "missed": 0}
            born.append((name, d))
    for name in {n for hits in touching for n in hits}:
        tracks[name]["keep"] = min(cfg.keep_max, tracks[name]["keep"] + 1)
    missed = [i for i in ids if i not in held]
    for name in missed:
        tracks[name]["missed"] += 1
        tracks[name]["keep"] = max(cfg.keep_min, tracks[name]["keep"] - 1)
    for hits in touching:
        if len(hits) > 1:
            oldest = min(hits, key=lambda n: (tracks[n]["first"], int(n)))
            for name in hits:
                if name != oldest:
                    key = f"{oldest},{name}"
                    state["pairs"][key] = state["pairs"].get(key, 0) + 1
    young = {n for n, t in tracks.items() if t["first"] > frame - cfg.start_delay}
    dead = {n for n, t in tracks.items() if t["missed"] >= cfg.unmatched_limit and n in young}
    dead |= {k.split(",")[1] for k, n in state["pairs"].items() if n >= cfg.duplicate_limit and k.split(",")[1] in young}
    rows = []
    seen = {**held, **dict(born)}
    for name, t in tracks.items():
        d = seen.get(name)
        if d is not None:
            t["box"] = list(dets[d][2:])
        event = "new" if name in dict(born) else "matched" if d is not None else "unmatched"
        quiet = t["missed"] > 0 and t["keep"] <= 0 and name not in dead
        rows.append((video, frame, int(name), None if d is None else dets[d][0], event, t["keep"], quiet, name in dead, *t["box"]))
    for name in dead:
        del tracks[name]
        state["pairs"] = {k: n for k, n in state["pairs"].items() if name not in k.split(",")}
    return _emit(state, rows, [int(n) for n in dead], cfg)


def _emit(state: dict, rows: list[tuple], dead: list[int], cfg: Settings) -> list[tuple]:
    """Hold ``emit_delay`` frames back and drop rows of objects removed in the meantime."""
    if cfg.emit_delay == 0:
        return rows
    state["gone"] = sorted({*state["gone"], *dead})
    state["buffer"].append([list(r) for r in rows])
    if len(state["buffer"]) < cfg.emit_delay:
        return []
    out = _alive(state, [state["buffer"].pop(0)])
    held = {r[2] for frame in state["buffer"] for r in frame}
    state["gone"] = [n for n in state["gone"] if n in held]
    return out


def skip(state: dict, video: int, last: int, frame: int, cfg: Settings) -> list[tuple]:
    """Advance over the frames between two that have detections; without tracks or rows held back there is nothing to do."""
    out: list[tuple] = []
    for f in range(last + 1, frame):
        if not state["tracks"] and not any(state["buffer"]):
            break
        out.extend(step(state, video, f, [], cfg))
    return out


def _alive(state: dict, frames: list) -> list[tuple]:
    gone = set(state["gone"])
    return [tuple(r) for rows in frames for r in rows if r[2] not in gone]


def flush(state: dict) -> list[tuple]:
    """Rows still held back at the end of a video."""
    out = _alive(state, state["buffer"])
    state["buffer"] = []
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    for c in ("obj_id", "det_id"):
        out[c] = out[c].astype("Int64")
    return out


def track(dets: DataFrame, cfg: Settings = Settings(), frames: DataFrame | None = None) -> DataFrame:
    """Batch twin: videos spread over tasks, each video read in frame order with only its state held.

    Every frame is stepped, with or without detections. ``frames`` (video_id, frame) lists those of each video, so that
    those before the first and after the last detection are stepped too.
    """
    cols = ["video_id", "frame", "det_id", "score", "x1", "y1", "x2", "y2"]
    rows = dets.select(*cols)
    if frames is not None:
        rows = frames.select("video_id", "frame").distinct().join(rows, ["video_id", "frame"], "left").select(*cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at, pending = None, None, []
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf[cols].itertuples(index=False):
                here = (r.video_id, r.frame)
                if here != at:
                    if at is not None:
                        out.extend(step(state, at[0], at[1], pending, cfg))
                        out.extend(flush(state) if at[0] != r.video_id else skip(state, at[0], at[1], r.frame, cfg))
                    if at is None or at[0] != r.video_id:
                        state = fresh()
                    at, pending = here, []
                if not pd.isna(r.det_id):
                    pending.append((int(r.det_id), *r[3:]))
            if out:
                yield _frame(out)
        if at is not None:
            yield _frame(step(state, at[0], at[1], pending, cfg) + flush(state))

    return rows.repartition("video_id").sortWithinPartitions("video_id", "frame", "det_id").mapInPandas(run, OUTPUT)


# --- T04 / T05 ------------------------------------------------------------------
def confirmations(matched: DataFrame, keys: list[str], n: int) -> DataFrame:
    """First frame at which an object was matched on ``n`` frames in a row (it stays confirmed).

    Each matched frame votes for the ``n`` frames whose look-back contains it; a frame with ``n``
    votes closes such a row. One aggregate, no ordering of an object's frames.
    """
    votes = matched.select(*keys, F.explode(F.sequence(F.col("frame"), F.col("frame") + n - 1)).alias("frame"))
    full = votes.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n)
    return full.groupBy(*keys).agg(F.min("frame").alias("confirmed_at"))


def suppress_recently_occluded(frames: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, frame, obj_id) hidden because they overlap an object whose last occlusion is older.

    The other object must have been occluded before. ``frames``: keys, frame, obj_id, occluded, box.
    """
    last = F.when(F.col("occluded"), F.col("frame"))
    seen = running_max(frames, [*keys, "obj_id"], [F.floor(F.col("frame") / 1024)], [F.col("frame")], {"last_occluded": last})
    seen = seen.withColumn("last_occluded", F.coalesce("last_occluded", F.lit(-1)))
    from tessella.functions import boxes as bx
    from tessella.functions.boxes import box

    pairs = self_pairs(
        seen, [*keys, "frame"], "obj_id", lambda a, b: bx.iou(box(a), box(b)) >= threshold, carry=["last_occluded"], span=span_for_ratio(threshold)
    )
    la, lb = F.col("a_last_occluded"), F.col("b_last_occluded")
    loser = F.when((la > lb) & (lb > -1), F.col("a_obj_id")).when((lb > la) & (la > -1), F.col("b_obj_id"))
    return pairs.select(*keys, "frame", loser.alias("obj_id")).where("obj_id IS NOT NULL").distinct()
