"""SentencePiece encoding and decoding for vocabularies of merges.

A text is a chain of symbols, at first its characters. An agenda holds the pairs of adjacent symbols whose
union is a piece, best score first and the leftmost of equal ones; the top pair becomes one symbol, and the
pairs that it now forms with its neighbours join the agenda. A pair of which a symbol has changed meanwhile is
passed over. What no piece covers is spelled in byte pieces.

No merge crosses two adjacent bytes that stand so in no piece. Texts are cut there, and equal units are
encoded once while a task remembers them. Every batch of new units is also encoded by the sentencepiece
library; a difference is an error.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm import units
from tessella.llm.byte_bpe import Pieces

SPACE = "▁"  # what pieces have for a space
REMEMBERED = 500_000  # units that a task remembers


class PieceModel:
    """A merge-type model that leaves texts as they are but for the spaces, with byte pieces for the rest."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = {i for i in range(size) if sp.is_unknown(i) or sp.is_control(i)}
        spelled = {i for i in range(size) if sp.is_byte(i)}
        if any(sp.is_unused(i) for i in range(size)) or len(spelled) != 256:
            raise ValueError(f"{path}: only models with all byte pieces and no unused ones are read")
        probe = "a  b\tAéﬁ "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{path}: only models that keep texts as they are and put a space in front are read")
        self.special = special
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in spelled}
        named = {i: sp.id_to_piece(i).replace(SPACE, " ") for i in range(size) if i not in special and i not in spelled}
        self.piece = {p: (-sp.get_score(i), i) for i, p in named.items()}
        self.bytes = {**{i: p.encode() for i, p in named.items()}, **{i: bytes([b]) for b, i in self.byte_id.items()}, **{i: b"" for i in special}}
        self.leading = {i for i, p in named.items() if p.startswith(" ")}
        #: Whether byte a stands before byte b in some piece.
        self.joined = np.zeros((256, 256), bool)
        for p in named.values():
            raw = np.frombuffer(p.encode(), np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.joined[:, 0x80:0xC0] = True  # never inside a character
        if self.joined[:, 10].any() or self.joined[10, :0x80].any():
            raise ValueError(f"{path}: a piece holds a line end")
        self.before = sp.encode("\n")  # what the library puts before a unit that follows a line end

    def cuts(self, buf: np.ndarray) -> np.ndarray:
        """Places that no merge crosses."""
        return np.flatnonzero(~self.joined[buf[:-1], buf[1:]]) + 1

    def encode(self, text: str) -> list[int]:
        """Ids of a text or unit whose spaces stand as such; no space is put in front."""
        whole = self.piece.get(text)
        if whole is not None and len(text) == 1:
            return [whole[1]]
        piece, symbol, n = self.piece, list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1:] = [-1]
        agenda = []
        for i in range(n - 1):
            found = piece.get(symbol[i] + symbol[i + 1])
            if found is not None:
                agenda.append((found[0], i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbol[left] or not symbol[right] or len(symbol[left]) + len(symbol[right]) != size:
                continue
            symbol[left] += symbol[right]
            symbol[right] = ""
            following = after[left] = after[right]
            if following >= 0:
                before[following] = left
                found = piece.get(symbol[left] + symbol[following])
                if found is not None:
                    heapq.heappush(agenda, (found[0], left, following, size + len(symbol[following])))
            previous = before[left]
            if previous >= 0:
                found = piece.get(symbol[previous] + symbol[left])
                if found is not None:
                    heapq.heappush(agenda, (found[0], previous, left, len(symbol[previous]) + size))
        out = []
        for s in symbol:
            if s:
                found = piece.get(s)
                out += [found[1]] if found is not None else [self.byte_id[b] for b in s.encode()]
        return out

    def encode_units(self, words: list[bytes]) -> list[list[int]]:
        """Ids of units, checked against the library as units that follow a line end."""
        texts = [w.decode() for w in words]
        own = [self.encode(x) for x in texts]
        theirs = self.library.encode(["\n" + x for x in texts], num_threads=1)
        for text, a, b in zip(texts, own, theirs, strict=True):
            if self.before + a != b:
                raise ValueError(f"the library encodes {text!r} as {b[len(self.before):]}, the agenda as {a}")
        return own

    def decode(self, ids: np.ndarray, joined: bytes) -> bytes:
        """UTF-8 of what the library's decode gives; ``joined``: the bytes of the ids end to end."""
        return joined[1:] if len(ids) and int(ids[0]) in self.leading else joined


@lru_cache(maxsize=2)
def opened(path: str) -> PieceModel:
    return PieceModel(path)


def spaced(column: pa.Array) -> pa.Array:
    """Texts as the model reads them: a space in front of all but empty ones, which nulls are too."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.replace_substring(column, SPACE, " ")
    front = pc.if_else(pc.equal(pc.binary_length(column), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    return pc.binary_join_element_wise(front, column, pa.scalar("", pa.large_string()))


def _encoded(batches, path: str):
    """(ids of the rows, token ids end to end, their n + 1 offsets) of each chunk."""
    model = opened(path)
    known = units.Encoded(model.encode_units, REMEMBERED)
    ready = (pa.RecordBatch.from_arrays([rb.column(0), spaced(rb.column(1))], ["id", "text"]) for rb in batches)
    for rb, buf, offs in units.chunks(ready, "text"):
        yield rb.column(0), *known.texts(buf, offs, units.NONE, units.NONE, model.cuts(buf))


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the piece ids of each row's text, without begin and end ids.

    A null or empty text has no ids. Null ids of rows and repeated rows stay as they are, other columns are not
    read, an empty table gives an empty result. A text that can be cut nowhere is one unit: its agenda grows
    with its length, its time a little faster.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for names, ids, ends in _encoded(batches, tokenizer):
            yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], [id_col, "ids"])

    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_documents(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the library's text of each row's ids; null or no ids: an empty text.

    Rows with special ids, or with byte pieces that are no UTF-8, are decoded by the library itself, others from the
    pieces' bytes. Null ids of rows and repeated rows stay; an unknown id is an error.
    """
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        model = opened(tokenizer)
        pieces = Pieces(model.bytes)

        def text(ids: list[int]) -> str:
            if not model.special.isdisjoint(ids):
                return model.library.decode(ids)
            own = np.array(ids, np.int64)
            try:
                return model.decode(own, pieces.join(own)).decode()
            except UnicodeDecodeError:
                return model.library.decode(ids)

        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([text(x or []) for x in rb.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("text", T.StringType())]))


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: encoded, and decoded from the ids again, in one pass.

    The ids are hashed as decimals joined by commas. Nulls, empty texts and so on as in ``encode_documents``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        model = opened(tokenizer)
        decoded, decimals = Pieces(model.bytes), Pieces({i: b"%d," % i for i in model.bytes})
        for names, ids, ends in _encoded(batches, tokenizer):
            numbers, texts = [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                own = ids[a:b]
                numbers.append(hashlib.sha256(decimals.join(own)[:-1]).hexdigest())
                texts.append(hashlib.sha256(model.decode(own, decoded.join(own))).hexdigest())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.diff(ends)), pa.array(numbers), pa.array(texts)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return rows.mapInArrow(run, T.StructType(fields))
