"""Byte-level BPE by prefixes: each byte prefix of a piece keeps the last token of its own encoding.

The encoding of every prefix ends in exactly one token, so a table of last tokens holds the
encodings of all prefixes at once: step back by the token's length and read on. A token t that ends
prefix i is the last one exactly if t and the last token of prefix i - len(t) stay apart in BPE.
Two tokens stay apart if, undoing their merges from the latest to the earliest, no pair that touches
at the border could have merged before the merge that ended that state.

A longer piece only adds prefixes (``PrefixTable.append``), and an edit keeps the prefixes in front of it
and stops where the rest of the table follows from the same state (``PrefixTable.replace``).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm import units
from tessella.llm.tokenizers_io import ranks

#: Pairs of tokens whose verdict a task remembers.
PAIRS = 1_000_000


class ByteBpe:
    """A rank file made ready: halves of each token, and verdicts on neighbouring tokens."""

    def __init__(self, rank_of: dict[bytes, int]):
        self.rank = rank_of
        self.bytes = {i: b for b, i in rank_of.items()}
        self.longest = max(map(len, rank_of), default=1)
        self.halves: dict[int, tuple[int, int] | None] = {}
        for b, i in rank_of.items():
            if len(b) == 1:
                self.halves[i] = None
            else:
                parts = self._merge(b, i)
                if len(parts) == 2:
                    self.halves[i] = (rank_of[parts[0]], rank_of[parts[1]])
        # Tokens that no merges lead to never stand in an encoding.
        self.usable = {self.bytes[i]: i for i in self.halves}
        self.apart: dict[tuple[int, int], bool] = {}

    def _merge(self, b: bytes, below: int) -> list[bytes]:
        parts = [b[i : i + 1] for i in range(len(b))]
        while True:
            best, at = below, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1], below)
                if r < best:
                    best, at = r, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, left: int, right: int) -> bool:
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            known = self.apart[left, right] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        before = None  # merges of a lower rank came first
        while True:
            joint = self.rank.get(self.bytes[left] + self.bytes[right])
            if joint is not None and (before is None or joint < before):
                return False
            # The merge that came last is undone; of two equal ones the left one came first.
            if self.halves[left] is not None and (self.halves[right] is None or left > right):
                before, left = left, self.halves[left][1]
            elif self.halves[right] is not None:
                before, right = right + 1, self.halves[right][0]
            else:
                return True

    def table(self, piece: bytes = b"") -> PrefixTable:
        t = PrefixTable(self)
        t.append(piece)
        return t

    def encode(self, piece: bytes) -> list[int]:
        whole = self.usable.get(piece)
        return [whole] if whole is not None else self.table(piece).ids()

    def decode(self, ids) -> bytes:
        return b"".join(self.bytes[i] for i in ids)


class PrefixTable:
    """Last token of every byte prefix of one piece."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.piece, self.last = bpe, bytearray(), []

    def append(self, more: bytes) -> None:
        """Extend the piece; the prefixes so far stay as they are."""
        self.piece += more
        self._fill(len(self.piece))

    def turn(self, piece: bytes) -> None:
        """Go on to another piece; the prefixes that both share stay as they are."""
        old, n = self.piece, 0
        for n, (a, b) in enumerate(zip(old, piece)):  # noqa: B007
            if a != b:
                break
        else:
            n = min(len(old), len(piece))
        self.piece = bytearray(piece)
        del self.last[n:]
        self._fill(len(piece))

    def _fill(self, upto: int) -> None:
        """Last tokens of the prefixes from the first that has none."""
        last, longest = self.last, self.bpe.longest
        find, known, apart = self.bpe.usable.get, self.bpe.apart.get, self.bpe.stay_apart
        piece = bytes(self.piece[:upto])
        for end in range(len(last) + 1, upto + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = find(piece[start:end])
                if token is not None:
                    if not start:
                        break
                    before = last[start - 1]
                    verdict = known((before, token))
                    if verdict or verdict is None and apart(before, token):
                        break
            else:
                raise ValueError(f"no token ends at byte {end}")
            last.append(token)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in the place of bytes start to stop; gives how many prefixes were computed anew.

        Behind the edit, ``longest`` equal last tokens in a row leave nothing for later prefixes to differ in.
        """
        old, shift = self.last[stop:], len(new) - (stop - start)
        self.piece[start:stop] = new
        self.last, done, same = self.last[:start], 0, 0
        for end in range(start + 1, len(self.piece) + 1):
            self._fill(end)
            token = self.last[-1]
            done += 1
            behind = end - shift - stop - 1
            same = same + 1 if end > start + len(new) and token == old[behind] else 0
            if same >= self.bpe.longest:
                self.last += old[behind + 1 :]
                break
        return done

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix that ends at ``end``."""
        end, out = len(self.piece) if end is None else end, []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.bpe.bytes[out[-1]])
        return out[::-1]


@lru_cache(maxsize=2)
def opened(path: str) -> ByteBpe:
    return ByteBpe(ranks(path))


def encoder(path: str, pattern: str):
    """Encodes units, each match of ``pattern`` separately; equal matches of a call are encoded once.

    The matches are taken in byte order, so that each goes on from the prefixes it shares with the one before.
    """
    import regex

    bpe, match = opened(path), regex.compile(pattern)

    def encode(words: list[bytes]) -> list[list[int]]:
        parts = [match.findall(w.decode("utf-8", "replace")) for w in words]
        known: dict[str, list[int]] = {}
        table = bpe.table()
        for piece in sorted({m for p in parts for m in p}):
            raw = piece.encode()
            whole = bpe.usable.get(raw)
            if whole is None:
                table.turn(raw)
            known[piece] = table.ids() if whole is None else [whole]
        return [known[p[0]] if len(p) == 1 else [i for m in p for i in known[m]] for p in parts]

    return encode


def encode_documents(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each row's text.

    A null or empty text has no ids. Null ids of rows and repeated rows stay as they are, other columns are
    not read, an empty table gives an empty result. A piece of any length takes time in proportion to it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        known = units.Encoded(encoder(tokenizer, pattern), 1_000_000)
        for rb, buf, offs in units.chunks(batches, "text"):
            ids, ends = known.texts(buf, offs, units.SPACE, units.MAY_BE_WHITE)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([rb.column(0), lists], [id_col, "ids"])

    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_documents(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the bytes that each row's ids stand for; null or no ids: none."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        pieces = Pieces(opened(tokenizer).bytes)
        for rb in batches:
            lists = [x or [] for x in rb.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([pieces.join(np.array(x, np.int64)) for x in lists], pa.binary())], [id_col, "bytes"])

    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("bytes", T.BinaryType())]))


class Pieces:
    """Byte strings by id, joined without a loop over ids."""

    def __init__(self, of: dict[int, bytes]):
        top = max(of, default=-1) + 1
        all_ = [of.get(i, b"") for i in range(top)]
        self.lengths = np.fromiter(map(len, all_), np.int64, top)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(all_), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        return self.data[units.spread(self.starts[ids], self.lengths[ids])].tobytes()


def digests(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: encoded, and decoded from the ids again, in one pass.

    The ids are hashed as decimals joined by commas. Nulls, empty texts and so on as in ``encode_documents``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType

    def run(batches):
        known = units.Encoded(encoder(tokenizer, pattern), 1_000_000)
        tokens = opened(tokenizer).bytes
        decoded, decimals = Pieces(tokens), Pieces({i: b"%d," % i for i in tokens})
        for rb, buf, offs in units.chunks(batches, "text", 2 * units.CHUNK):
            ids, ends = known.texts(buf, offs, units.SPACE, units.MAY_BE_WHITE)
            names, texts = [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                own = ids[a:b]
                names.append(hashlib.sha256(decimals.join(own)[:-1]).hexdigest())
                texts.append(hashlib.sha256(decoded.join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(np.diff(ends)), pa.array(names), pa.array(texts)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return rows.mapInArrow(run, T.StructType(fields))
