"""Toxicity of documents by multiple-instance learning.

A document is a bag of sentences. A sentence has a probability from its words, p = sigmoid(b + sum w),
and a document is toxic if any sentence is (noisy-or): P = 1 - prod(1 - p). Only documents have labels; the
gradient of their likelihood shares a document's guilt among its sentences, so the words that
mark sentences are learned, and the same model then names the offending sentences.

Training and scoring see the same bag: the features that training knows, each once in a sentence, and each
sentence with other features once; sentences without a known feature are one. A score adds up the sentences of
some probability (``FLOOR``) and takes the mean of the others, so that a long text is not toxic for its length.

Training reads a bounded sample of the labelled rows (``sample`` and ``sample_bytes``, chosen by a hash of the id, so it is the same
at each run); scoring is one pass over all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm import hashing, units

BITS = 18
#: Bytes of the stems; a shorter word is its own stem.
STEMS = (4, 6)
SHRINK = 0.03
#: Documents of the sample that must hold a feature.
COMMON = 6
SAMPLE = 12_000
#: Bytes of the sample's texts; a text of over a hundredth of them is not learned from.
SAMPLE_BYTES = 96 << 20
#: Sentences of a lower probability do not add up: of a text's, the mean counts.
FLOOR = 0.02
STEPS = 600
BATCH = 256

_WORD = units.table(bytes([*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), ord("'"), *range(128, 256)]))
_STOP = units.table(b".!?\n")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    known: np.ndarray | None = None  # whether training knows a feature; needed to make bags


def sentences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, number of features before each sentence, sentences before each text, byte offsets of sentences.

    A sentence ends at a full stop, mark or line end, and with its text; one without words is left out. A word
    gives itself and its first bytes as features, so that endings share what is learned of a stem.
    """
    low = hashing.LOWER[buf]
    starts, ends = hashing.runs(_WORD[low], offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(offs), np.int64), np.zeros((0, 2), np.int64)
    total = hashing.running(low)
    feature = np.empty((len(starts), 1 + len(STEMS)), np.int64)
    for k, stem in enumerate((None, *STEMS)):
        upto = ends if stem is None else np.minimum(starts + stem, ends)
        feature[:, k] = (hashing.mix(hashing.ranges(total, starts, upto), k) >> np.uint64(64 - BITS)).astype(np.int64)
    text = np.searchsorted(offs, starts, "right") - 1
    stops = np.cumsum(_STOP[buf])
    new = np.append(True, (stops[starts[1:]] != stops[starts[:-1]]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    bounds = np.append(first, len(starts))
    return feature.ravel(), bounds * feature.shape[1], np.searchsorted(text[first], np.arange(len(offs))), np.stack([starts[first], ends[bounds[1:] - 1]], 1)


def _noisy_or(scores: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Minus the log of the probability that no sentence is toxic, per text."""
    total = np.append(0.0, np.cumsum(np.logaddexp(0, scores)))
    return total[firsts[1:]] - total[firsts[:-1]]


@dataclass(frozen=True)
class Bags:
    """Features, their n + 1 bounds by sentence, sentences before each text, byte offsets, and the sentences of the bags."""

    feature: np.ndarray
    bounds: np.ndarray
    firsts: np.ndarray
    places: np.ndarray
    kept: np.ndarray

    def kept_firsts(self) -> np.ndarray:
        return np.searchsorted(self.kept, self.firsts)


def bags(buf: np.ndarray, offs: np.ndarray, known: np.ndarray) -> Bags:
    feature, bounds, firsts, places = sentences(buf, offs)
    n = len(bounds) - 1
    at = np.flatnonzero(known[feature])
    key = np.unique(((np.searchsorted(bounds, at, "right") - 1) << BITS) | feature[at])
    feature, bounds = key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(n + 1))
    total = np.append(np.zeros(1, np.uint64), np.cumsum(hashing.mix(feature.astype(np.uint64), 9), dtype=np.uint64))
    name = total[bounds[1:]] - total[bounds[:-1]]
    text = np.repeat(np.arange(len(offs) - 1), np.diff(firsts))
    order = np.lexsort((name, text))
    new = np.append(True, (name[order[1:]] != name[order[:-1]]) | (text[order[1:]] != text[order[:-1]]))[:n]
    return Bags(feature, bounds, firsts, places, np.sort(order[new]))


def _sentence_scores(model: Model, feature: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.append(0.0, np.cumsum(model.weights[feature], dtype=np.float64))
    return sums[bounds[1:]] - sums[bounds[:-1]] + model.bias


def _scores(model: Model, bag: Bags) -> tuple[np.ndarray, np.ndarray]:
    """Of all sentences before the sigmoid, and the probability of each text."""
    z = _sentence_scores(model, bag.feature, bag.bounds)
    own, firsts = z[bag.kept], bag.kept_firsts()
    low = own < np.log(FLOOR / (1 - FLOOR))
    some = np.append(0.0, np.cumsum(np.where(low, np.logaddexp(0, own), 0.0)))
    before = np.append(0, np.cumsum(low))
    mean = (some[firsts[1:]] - some[firsts[:-1]]) / np.maximum(before[firsts[1:]] - before[firsts[:-1]], 1)
    return z, -np.expm1(-_noisy_or(np.where(low, -np.inf, own), firsts) - mean)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, steps: int = STEPS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` labelled documents of ``sample_bytes`` together; without labels the model scores everything near 0.

    A null label or id is not used; of several labels of one id the highest counts.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    size = F.octet_length("text")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").where(size <= sample_bytes // 100)
    lengths = rows.select(F.xxhash64("_id").alias("h"), size.alias("n")).groupBy("h").agg(F.sum("n").alias("n")).toArrow().sort_by("h")
    taken = lengths["h"].to_numpy()[np.cumsum(lengths["n"].to_numpy()) <= sample_bytes]
    rows = rows.where(F.xxhash64("_id") <= int(taken.max()) if len(taken) else F.lit(False)).select("text", "_y")

    def held(batches):
        for _, buf, offs in units.chunks(batches, "text"):
            feature, bounds, firsts, _ = sentences(buf, offs)
            text = np.repeat(np.arange(len(offs) - 1), np.diff(bounds[firsts]))
            pairs = np.unique((text << BITS) | feature)
            yield pa.RecordBatch.from_arrays([pa.array(pairs & ((1 << BITS) - 1))], ["feature"])

    # A feature of very few documents tells little about others, and is not sent to the driver.
    often = rows.mapInArrow(held, "feature long").groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).select("feature").toArrow()
    known = np.zeros(1 << BITS, bool)
    known[often["feature"].to_numpy()] = True

    def bagged(batches):
        for rb, buf, offs in units.chunks(batches, "text"):
            bag = bags(buf, offs, known)
            n = bag.bounds[bag.kept + 1] - bag.bounds[bag.kept]
            flat = pa.array(bag.feature[units.spread(bag.bounds[bag.kept], n)], pa.int32())
            words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bag.kept_firsts(), pa.int32()), words), rb.column(1)], ["bag", "y"])

    model = _fit(rows.mapInArrow(bagged, "bag array<array<int>>, y int").toArrow(), steps, known)
    pa.default_memory_pool().release_unused()  # the sample is done with, and the driver goes on
    return model


def _fit(got: pa.Table, steps: int, known: np.ndarray) -> Model:
    """Adam over mini-batches of documents, with shrinkage, from weights of zero and a rare-sentence bias."""
    w, bias = np.zeros(1 << BITS), -6.0
    if not got.num_rows:
        return Model(w.astype(np.float32), bias, known)
    # Chunk by chunk: the sample is not copied as a whole but for its features.
    bags, y = got.column("bag").chunks, got.column("y").to_numpy()
    firsts = np.append(0, np.cumsum(np.concatenate([b.value_lengths().to_numpy() for b in bags])))
    sent = [b.flatten() for b in bags]
    bounds = np.append(0, np.cumsum(np.concatenate([s.value_lengths().to_numpy() for s in sent])))
    feature = np.concatenate([s.flatten().to_numpy() for s in sent])
    del got, bags, sent
    m, v, step = np.zeros(1 << BITS), np.zeros(1 << BITS), 0
    mb = vb = 0.0
    rng = np.random.default_rng(1)
    while step < steps:
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            rate = 0.2 if step < steps // 2 else 0.05
            docs = order[a : a + BATCH]
            n_s = firsts[docs + 1] - firsts[docs]
            s = units.spread(firsts[docs], n_s)
            n_w = bounds[s + 1] - bounds[s]
            f = feature[units.spread(bounds[s], n_w)]
            sums = np.append(0.0, np.cumsum(w[f]))
            at = np.append(0, np.cumsum(n_w))
            z = sums[at[1:]] - sums[at[:-1]] + bias
            none = _noisy_or(z, np.append(0, np.cumsum(n_s)))
            pull = np.where(y[docs] > 0, -np.exp(-none) / np.maximum(-np.expm1(-none), 1e-9), 1.0)
            g = np.repeat(pull, n_s) / (1 + np.exp(-z)) / len(docs)
            grad = np.bincount(f, np.repeat(g, n_w), minlength=1 << BITS)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
            # What is not pulled up again and again goes back to exactly zero.
            w = np.sign(w) * np.maximum(np.abs(w) - rate * SHRINK, 0)
            gb = g.sum()
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            bias -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-3)
    return Model(w.astype(np.float32), float(bias), known)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.5) -> DataFrame:
    """(id, score, sentences): noisy-or of the sentences, and those of probability ``offending`` or more.

    ``sentences`` are (start, end, score) in code points, end exclusive. A null or empty text, or one without
    words, scores 0. Null ids and repeated rows are scored like any other; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for rb, buf, offs in units.chunks(batches, "text"):
            bag = bags(buf, offs, held.value.known)
            z, p = _scores(held.value, bag)
            ps = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            hit = np.flatnonzero(ps >= offending)
            found: list[list] = [[] for _ in range(rb.num_rows)]
            if len(hit):
                chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
                text = np.searchsorted(bag.firsts, hit, "right") - 1
                for t, (a, b), x in zip(text, chars[bag.places[hit]] - chars[offs[text]][:, None], ps[hit], strict=True):
                    found[t].append({"start": int(a), "end": int(b), "score": float(x)})
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(np.clip(p, 0, 1)), pa.array(found, span)], [id_col, "score", "sentences"])

    kind = rows.schema["id"].dataType
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("score", T.DoubleType()), T.StructField("sentences", spans)]))


def keep_clean(docs: DataFrame, model: Model, reject: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``reject``, with all their columns; a null text is clean."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rb, buf, offs in units.chunks(batches, text_col):
            _, p = _scores(held.value, bags(buf, offs, held.value.known))
            yield rb.filter(pa.array(p < reject))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col, folds: int, fold: int):
    """Rows that no label is learned from; a null id is not held out."""
    return F.coalesce(F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
