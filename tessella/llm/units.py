"""Texts of an Arrow batch as one byte buffer, cut into units that a tokenizer treats separately."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time inside a task; a longer text is handled alone.
CHUNK = 2 << 20


def unused(name: str, columns: list[str]) -> str:
    """``name``, or as many underscores before it as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and their n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(batches, text: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their text buffers, each of about ``limit`` bytes at most."""
    for rb in batches:
        if not rb.num_rows:
            continue
        buf, offs = buffer(rb.column(rb.schema.get_field_index(text)))
        row = 0
        while row < rb.num_rows:
            to = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
            yield rb.slice(row, to - row), buf[offs[row] : offs[to]], offs[row : to + 1] - offs[row]
            row = to


def table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


WHITE = table(b" \t\n\r\x0b\x0c")
SPACE = table(b" ")
#: White space, and first bytes of code points that can be white space.
MAY_BE_WHITE = table(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3")
NONE = table(b"")
_MARK = table(b".,!?;:")
_LETTER = table(bytes([*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]))


def marks(buf: np.ndarray) -> np.ndarray:
    """Where a punctuation mark follows an ASCII letter: word tokenizers that part the two can be cut there."""
    return np.flatnonzero(_MARK[buf[1:]] & _LETTER[buf[:-1]]) + 1


def cut(buf: np.ndarray, offs: np.ndarray, starters: np.ndarray, glue: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit offsets, and the n + 1 unit numbers at which the texts begin and end.

    A unit begins with each text and at each ``starters`` byte, unless the next byte is one of
    ``glue`` or the text ends there, and at the places ``more``.
    """
    n = len(buf)
    mark = np.zeros(n + 1, bool)
    at = np.flatnonzero(starters[buf])
    mark[offs] = True
    at = at[~mark[at + 1]]
    at = at[~glue[buf[at + 1]]]
    mark[at] = True
    if more is not None:
        mark[more] = True
    mark[n] = False
    starts = np.flatnonzero(mark)
    return np.append(starts, n), np.searchsorted(starts, offs)


def distinct(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each unit in the list of distinct units, and that list."""
    if len(bounds) < 2:
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    units = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = units.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def distinct_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """As ``distinct``, for ranges that need not touch."""
    if len(starts) and np.array_equal(starts[1:], ends[:-1]):
        return distinct(buf[starts[0] : ends[-1]], np.append(starts, ends[-1:]) - starts[0])
    lengths = ends - starts
    return distinct(buf[spread(starts, lengths)], np.append(0, np.cumsum(lengths)))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all ranges (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


class Encoded:
    """Ids of units, each encoded once while it is remembered; at most ``limit`` units are."""

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.lengths, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) + len(words) > self.limit:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            lists = self.encode(new)
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(lengths.sum()))
            base = len(self.known)
            self.ids = self._room(self.ids, self.size + len(flat))
            self.starts, self.lengths = self._room(self.starts, base + len(new)), self._room(self.lengths, base + len(new))
            self.ids[self.size : self.size + len(flat)] = flat
            self.starts[base : base + len(new)] = self.size + np.cumsum(lengths) - lengths
            self.lengths[base : base + len(new)] = lengths
            self.size += len(flat)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def texts(self, buf: np.ndarray, offs: np.ndarray, starters: np.ndarray, glue: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and their n + 1 offsets."""
        bounds, firsts = cut(buf, offs, starters, glue, more)
        code, words = distinct(buf, bounds)
        unit = self._numbers(words.to_pylist())[code] if len(code) else np.zeros(0, np.int64)
        lengths = self.lengths[unit]
        return self.ids[spread(self.starts[unit], lengths)], np.append(0, np.cumsum(lengths))[firsts]
