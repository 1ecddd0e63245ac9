"""T02_streamed_tracking: calls of the state, each of which is a round trip to the JVM."""

from __future__ import annotations

from pyspark.sql import Row

from tessella.streaming import tracker, videos


class _State:
    """A value, map or list of a handle that counts what is called."""

    def __init__(self, calls: list[str]):
        self.calls, self.value, self.map, self.list = calls, None, {}, []

    def __getattribute__(self, name):
        found = object.__getattribute__(self, name)
        if callable(found) and not name.startswith("_"):
            self.calls.append(name)
        return found

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def put(self, rows):
        self.list = rows

    def get(self):
        return self.value

    def keys(self):
        return iter(list(self.map))

    def iterator(self):
        return iter(list(self.map.items()))

    def containsKey(self, k):
        return k in self.map

    def getValue(self, k):
        return self.map[k]

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        del self.map[k]

    def clear(self):
        self.value, self.map, self.list = None, {}, []


class _Handle:
    def __init__(self):
        self.calls: list[str] = []

    def getValueState(self, *_):
        return _State(self.calls)

    getMapState = getListState = getValueState


def test_calls_do_not_grow_with_tracks_and_frames():
    cfg = tracker.Settings(iou=0.4, emit_delay=2)
    row = Row("frame", "det_id", "score", "x1", "y1", "x2", "y2", "is_last", "at_ms")
    dets = [(f, 100 * f + d, 0.9, 3.0 * d + f % 2, 0.0, 3.0 * d + 20, 10.0) for f in range(12) for d in range(15)]
    handle, got = _Handle(), []
    video = videos.Videos(cfg, None)
    video.init(handle)
    for part in range(2):
        handle.calls.clear()
        got += video.handleInputRows((7,), iter([row(*d, False, None) for d in dets if d[0] // 6 == part]), None)
        assert len(handle.calls) <= 8, handle.calls
    got += video.handleExpiredTimer((7,), None, None)
    state, want = tracker.fresh(), []
    for f in range(12):
        want += tracker.step(state, 7, f, [d[1:] for d in dets if d[0] == f], cfg)
    want += tracker.flush(state)
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(want) > 12
