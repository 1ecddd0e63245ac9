"""Quality of documents by votes of their nearest labelled neighbours in a latent-semantic space.

Features are hashed words, word shapes (``Tea,!!`` is ``Aa,!``) and, one of two marks where a tenth
or three tenths of the words repeat the one before; weighted by inverse document frequencies that are
counted over all documents. A truncated SVD of a bounded sample of labelled documents gives the
space; the sample's vectors and labels are broadcast, and every document takes its exact cosines to all
of them in blocks. The nearest ones vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm import hashing, units

BITS = 14
SAMPLE = 4096
DIMENSIONS = 48
NEIGHBOURS = 15
ROWS = 512  # documents of a block of products

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


@dataclass(frozen=True)
class Model:
    idf: np.ndarray  # weight of each feature
    space: np.ndarray  # features x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, of length 1
    labels: np.ndarray
    prior: float


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text with their counts, and the n + 1 bounds of the texts."""
    starts, ends = hashing.runs(~units.WHITE[buf], offs)
    n = len(offs) - 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    words = hashing.mix(hashing.ranges(hashing.running(hashing.LOWER[buf]), starts, ends))
    kind = _SHAPE[buf]
    keep = np.append(True, kind[1:] != kind[:-1])
    keep[starts] = True
    place = np.append(0, np.cumsum(keep))
    shapes = hashing.mix(hashing.ranges(hashing.running(kind[keep]), place[starts], place[ends]), 1)
    text = np.searchsorted(offs, starts, "right") - 1
    again = np.append(False, (words[1:] == words[:-1]) & (text[1:] == text[:-1]))
    tenths = 10 * np.bincount(text[again], minlength=n) // np.maximum(np.bincount(text, minlength=n), 1)
    level = (tenths >= 1).astype(np.int64) + (tenths >= 3)
    often = text[again & (level[text] > 0)]
    once = ~again
    every = np.concatenate([(words[once] >> np.uint64(64 - BITS)).astype(np.int64), (shapes[once] >> np.uint64(64 - BITS)).astype(np.int64), level[often]])
    key, count = np.unique((np.concatenate([text[once], text[once], often]) << BITS) | every, return_counts=True)
    return key & ((1 << BITS) - 1), count, np.searchsorted(key, np.arange(n + 1) << BITS)


def _weights(feature, count, bounds, idf):
    w = (1 + np.log(count)) * idf[feature]
    squares = np.append(0.0, np.cumsum(w * w))
    norm = np.sqrt(squares[bounds[1:]] - squares[bounds[:-1]])
    return w / np.repeat(np.maximum(norm, 1e-12), np.diff(bounds))


def _times(feature, weight, bounds, dense: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix, a bounded block of rows at a time."""
    out = np.zeros((len(bounds) - 1, dense.shape[1]), dense.dtype)
    row = 0
    while row < len(out):
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + 100_000, "right")) - 1)
        at = slice(bounds[row], bounds[to])
        full = np.flatnonzero(bounds[row + 1 : to + 1] > bounds[row:to])
        if len(full):
            out[row + full] = np.add.reduceat(dense[feature[at]] * weight[at, None].astype(dense.dtype), bounds[row + full] - bounds[row])
        row = to
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each feature stands, and their number."""

    def run(batches):
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for rb, buf, offs in units.chunks(batches, "text"):
            seen += np.bincount(features(buf, offs)[0], minlength=1 << BITS)
            n += rb.num_rows
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(seen[held], n))], ["feature", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    own = sums[sums.feature >= 0]
    df[own.feature.to_numpy()] = own.n.to_numpy()
    return df, int(sums.n[sums.feature < 0].sum())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """Space and neighbours from at most ``sample`` labelled documents, chosen by a hash of the id.

    A null label or id is not used; of several labels of one id the highest counts. Without labels every document scores 0.5.
    """
    df, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("text", "_y")

    def run(batches):
        for rb, buf, offs in units.chunks(batches, "text"):
            f, c, bounds = features(buf, offs)
            listed = lambda a: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(a, pa.int32()))
            yield pa.RecordBatch.from_arrays([listed(f), listed(c), rb.column(1)], ["f", "c", "y"])

    got = rows.mapInArrow(run, "f array<int>, c array<int>, y int").toArrow().combine_chunks()
    if not got.num_rows:
        return Model(idf, np.zeros((1 << BITS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    lists = got.column("f").combine_chunks()
    feature, count = lists.flatten().to_numpy().astype(np.int64), got.column("c").combine_chunks().flatten().to_numpy()
    bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    weight = _weights(feature, count, bounds, idf)
    y = got.column("y").to_numpy().astype(np.float64)
    space = _svd(feature, weight, bounds, dimensions)
    vectors = _unit(_times(feature, weight, bounds, space))
    return Model(idf, space, vectors, y, float(y.mean()))


def _svd(feature, weight, bounds, dimensions: int) -> np.ndarray:
    """Right singular vectors by subspace iteration."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    width = min(dimensions + 8, len(bounds) - 1)
    q = np.random.default_rng(5).standard_normal((1 << BITS, width))
    for _ in range(4):
        left, _ = np.linalg.qr(_times(feature, weight, bounds, q))
        back = np.stack([np.bincount(feature, weight * left[rows, k], minlength=1 << BITS) for k in range(left.shape[1])], 1)
        q, _ = np.linalg.qr(back)
    # Turn the subspace to its principal directions and keep the strongest.
    _, _, turn = np.linalg.svd(_times(feature, weight, bounds, q), full_matrices=False)
    return (q @ turn.T)[:, :dimensions].astype(np.float32)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """(id, score): the similarity-weighted share of good ones among the nearest labelled documents.

    The share of good ones among all labels votes once too, and alone for a text that is like none (null, empty
    or of unseen features). Null
    ids and repeated rows are scored like any other; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        k = min(neighbours, len(m.labels))
        for rb, buf, offs in units.chunks(batches, "text"):
            f, c, bounds = features(buf, offs)
            v = _unit(_times(f, _weights(f, c, bounds, m.idf), bounds, m.space))
            out = np.full(rb.num_rows, m.prior)
            for a in range(0, rb.num_rows if k else 0, ROWS):
                cosines = v[a : a + ROWS] @ m.vectors.T
                near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
                sim = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64)
                total = sim.sum(1)
                votes = (sim * m.labels[near]).sum(1)
                out[a : a + ROWS] = (votes + m.prior) / (total + 1)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(np.clip(out, 0, 1))], [id_col, "score"])

    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("score", T.DoubleType())]))
