"""The tracker on streams of detections: typed state for each video, and a timer that ends a silent one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.streaming.tracker import COLUMNS, OUTPUT, Settings, flush, fresh, skip, step

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BOX = "x1 double, y1 double, x2 double, y2 double"


def _typed(columns: str) -> str:
    """The fields of a struct, from a list of columns."""
    return columns.replace(", ", ",").replace(" ", ":")


_WAITING = f"dets array<struct<det_id:bigint,score:double,{_typed(_BOX)}>>"
_STATE = (
    f"next bigint, done bigint, slots int, gone array<bigint>, ends bigint, tracks array<struct<obj_id:bigint,{_typed(_BOX)},first:bigint,keep:int,missed:int>>, "
    f"pairs array<struct<older:bigint,younger:bigint,n:int>>, held array<struct<slot:int,{_typed(OUTPUT)}>>"
)
_ROW = Row(*COLUMNS)


class Videos(StatefulProcessor):
    """State of a video: one value with what a step needs whole anyway (live tracks, pairs of objects that overlapped, rows held
    back, the clock), and by frame the detections that a batch has left ``waiting``.

    Each call of the state is a round trip to the JVM: a value is one, however many tracks and pairs a video has."""

    def __init__(self, cfg: Settings, idle_ms: int | None):
        self.cfg, self.idle_ms = cfg, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.waiting = handle.getMapState("waiting", "frame bigint", _WAITING)

    def _load(self) -> dict:
        s = {**fresh(), "done": None, "ends": None}
        kept = self.state.get()
        if kept is None:
            return s
        next_, done, slots, gone, ends, tracks, pairs, held = kept
        s |= {"next": next_, "done": done, "gone": list(gone), "ends": ends, "buffer": [[] for _ in range(slots)]}
        s["tracks"] = {str(t[0]): {"box": list(t[1:5]), "first": t[5], "keep": t[6], "missed": t[7]} for t in tracks}
        s["pairs"] = {f"{older},{younger}": n for older, younger, n in pairs}
        for row in held:
            s["buffer"][row[0]].append(list(row[1:]))
        return s

    def _store(self, s: dict) -> None:
        tracks = [(int(name), *t["box"], t["first"], t["keep"], t["missed"]) for name, t in sorted(s["tracks"].items(), key=lambda x: int(x[0]))]
        pairs = [(*map(int, k.split(",")), n) for k, n in s["pairs"].items()]
        held = [(i, *r) for i, frame in enumerate(s["buffer"]) for r in frame]
        self.state.update((s["next"], s["done"], len(s["buffer"]), s["gone"], s["ends"], tracks, pairs, held))

    def _clear(self) -> None:
        for state in (self.state, self.waiting):
            state.clear()

    def _work_off(self, s: dict, video: int, frames: list[int], came: dict[int, list[tuple]], old: set[int]) -> list[tuple]:
        """``came``: detections of this batch by frame; ``old``: frames of which earlier batches left some."""
        out: list[tuple] = []
        for f in frames:
            dets = came.get(f, [])
            if f in old:
                dets = self._left(f) + dets
                self.waiting.removeKey((f,))
            if s["done"] is not None:
                out.extend(skip(s, video, s["done"], f, self.cfg))
            out.extend(step(s, video, f, sorted(dets), self.cfg))
            s["done"] = f
        return out

    def _left(self, frame: int) -> list[tuple]:
        (dets,) = self.waiting.getValue((frame,))
        return [tuple(d) for d in dets]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        video, s = key[0], self._load()
        out, came, last, newest = [], {}, False, None
        for r in rows:
            last |= bool(r.is_last)
            newest = r.at_ms if newest is None or (r.at_ms is not None and r.at_ms > newest) else newest
            if r.frame is None or r.det_id is None:  # tells the time only
                continue
            if s["done"] is not None and r.frame <= s["done"]:
                out.append((video, r.frame, None, r.det_id, "late", None, None, None, r.x1, r.y1, r.x2, r.y2))
            else:
                came.setdefault(r.frame, []).append((r.det_id, r.score, r.x1, r.y1, r.x2, r.y2))
        old = {k[0] for k in self.waiting.keys()}
        known = sorted(old | came.keys())
        due = [f for f in known if last or f < known[-1] - self.cfg.reorder]
        out.extend(self._work_off(s, video, due, came, old))
        for f in came.keys() - set(due):
            self.waiting.updateValue((f,), ((self._left(f) if f in old else []) + came[f],))
        if self.idle_ms is not None and newest is not None and (last or s["ends"] is None or newest + self.idle_ms > s["ends"]):
            if s["ends"] is not None:
                self.handle.deleteTimer(s["ends"])
            s["ends"] = newest + self.idle_ms
            if not last:
                self.handle.registerTimer(s["ends"])
        if last:
            out.extend(flush(s))
            self._clear()
        else:
            self._store(s)
        yield from (_ROW(*r) for r in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A video that has been silent for long is over: what waits is worked off, what was held back comes out."""
        s = self._load()
        old = {k[0] for k in self.waiting.keys()}
        out = self._work_off(s, key[0], sorted(old), {}, old) + flush(s)
        self._clear()
        yield from (_ROW(*r) for r in out)


def track_stream(dets: DataFrame, cfg: Settings = Settings(), time_col: str | None = None, delay: str = "0 seconds", idle: int = 60) -> DataFrame:
    """Streaming twin of ``tracker.track``: the rows it gives for the same detections.

    ``dets``: video_id, frame, det_id, score, box, is_last. A frame is worked off once one more than ``reorder`` frames later
    has come, or at a row with ``is_last``. What comes later than that is not stepped: it gives a row of event ``late`` without an
    object. With ``time_col``, a video without rows for ``idle`` seconds of event time (watermark: ``delay``) is ended by a
    timer and its state goes; a row without a frame or detection only tells the time. State is kept in RocksDB.
    """
    spark = dets.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    at = F.lit(None).cast("long") if time_col is None else F.unix_millis(time_col)
    rows = dets if time_col is None else dets.withWatermark(time_col, delay)
    kept = ["video_id", "frame", "det_id", "score", "x1", "y1", "x2", "y2", "is_last", at.alias("at_ms"), *([] if time_col is None else [time_col])]
    processor = Videos(cfg, None if time_col is None else idle * 1000)
    return rows.select(*kept).groupBy("video_id").transformWithState(processor, OUTPUT, "append", "none" if time_col is None else "eventTime").select(*COLUMNS)
