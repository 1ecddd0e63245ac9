"""Token counts of documents: each distinct pre-token is counted once, ids are never kept.

1. Every task cuts its texts at white space (which no token crosses), and writes per block of texts
   the distinct pre-tokens, dealt into buckets by hash, and each document's pre-token frequencies. Both are
   packed columns: a row for each pair of document and pre-token would take more disk than the texts.
2. A bucket gathers each pre-token once from every block, counts the pieces of the distinct ones
   with the tokenizer library, and sends the counts back under the blocks' own numbers.
3. A block joins the counts to its frequencies and sums per document.

A common word is one entry of a block's list however often it occurs, so no key is hot. Blocks are
bounded in bytes, the number of buckets follows the session's shuffle partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.taskcontext import TaskContext

from tessella.llm import hashing, units
from tessella.llm.tokenizers_io import encode_words
from tessella.session import scratch

#: Bytes of text in a block.
BLOCK = 24 << 20


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, block: int = BLOCK) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    ``tokenizer`` is a ``tokenizers`` file whose tokens never cross white space, read in each task.
    A null or empty text has 0 bytes and 0 tokens; a null id stays; rows that repeat are counted
    each; other columns are not read; an empty table gives an empty result. A text without white
    space is one pre-token, whatever its length.
    """
    spark = docs.sparkSession
    buckets = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    held = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("n_bytes", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("entries", T.BinaryType())]
    )
    folder = scratch(spark)
    rows.mapInArrow(lambda b: _blocks(b, buckets, block), held).write.parquet(folder)
    stored = spark.read.schema(held).parquet(folder)
    counted = (
        stored.where("bucket >= 0").select("bucket", "block", "words").groupBy("bucket")
        .applyInArrow(lambda t: _count(t, tokenizer), "block long, bucket int, pieces binary")
    )
    freqs = stored.where("bucket < 0").select("block", "ids", "n_bytes", "ends", "entries")
    out = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    summed = freqs.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(lambda a, b: _sum(a, b, id_col), out)
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)


def packed(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _blocks(batches, buckets: int, limit: int):
    """Rows of one block: its word lists per bucket, then its frequencies (bucket -1)."""
    task, made = TaskContext.get().partitionId(), 0
    held, size = [], 0
    for rb, buf, offs in units.chunks(batches, "text"):
        starts, ends = hashing.runs(~units.WHITE[buf], offs)
        code, words = units.distinct_ranges(buf, starts, ends)
        held.append((rb.column(0), offs, code, np.searchsorted(starts, offs), words))
        size += len(buf)
        if size >= limit:
            yield _pack((task << 32) + made, held, buckets)
            held, size, made = [], 0, made + 1
    if held:
        yield _pack((task << 32) + made, held, buckets)


def _pack(block: int, held: list, buckets: int) -> pa.RecordBatch:
    coded = pa.concat_arrays([w for *_, w in held]).dictionary_encode()
    words = coded.dictionary.to_pylist()
    home = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    # Words are numbered as the buckets' lists stand one after the other.
    order = np.argsort(home, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    renamed = number[coded.indices.to_numpy()]
    used, first = np.unique(home[order], return_index=True)
    lists = [b"\n".join([words[i] for i in part]) for part in np.split(order, first[1:])] if len(used) else []
    steps, counts, ends, at, total = [], [], [], 0, 0
    for _, offs, code, firsts, w in held:
        word = renamed[at : at + len(w)][code]
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(firsts))
        key, n = np.unique((doc << 32) | word, return_counts=True)
        # Of a document's sorted words, the first and then the distances.
        step = np.diff(key & 0xFFFFFFFF, prepend=0)
        begin = np.searchsorted(key, np.arange(len(offs), dtype=np.int64) << 32)
        heads = begin[:-1][begin[:-1] < begin[1:]]
        step[heads] = key[heads] & 0xFFFFFFFF
        steps.append(step)
        counts.append(n)
        ends.append(total + begin[1:])
        total += len(key)
        at += len(w)
    entries = packed(np.concatenate([*steps, *counts]))
    ids = pa.concat_arrays([x for x, *_ in held])
    lone = lambda a: pa.ListArray.from_arrays(pa.array([*[None] * len(used), 0, len(a)], pa.int32()), a)
    rows = len(used) + 1
    compress = zstandard.ZstdCompressor(level=3).compress
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * rows), pa.array([*used, -1], pa.int32()), pa.array([*map(compress, lists), None], pa.binary()), lone(ids), lone(pa.array(np.concatenate([np.diff(o) for _, o, *_ in held]))), lone(pa.array(np.concatenate(ends), pa.int32())), pa.array([None] * len(used) + [entries], pa.binary())],
        ["block", "bucket", "words", "ids", "n_bytes", "ends", "entries"],
    )


def _count(t: pa.Table, tokenizer: str) -> pa.Table:
    """Pieces of each distinct word of a bucket, in the order of each block's list."""
    expand = zstandard.ZstdDecompressor().decompress
    lists = [expand(b).split(b"\n") for b in t.column("words").to_pylist()]
    known = list({w for x in lists for w in x})
    pieces = dict(zip(known, map(len, encode_words(tokenizer, known)), strict=True))
    back = [packed(np.fromiter((pieces[w] for w in x), np.int64, len(x))) for x in lists]
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "pieces": pa.array(back, pa.binary())})


def _sum(freq: pa.Table, counted: pa.Table, id_col: str) -> pa.Table:
    parts = sorted(zip(counted.column("bucket").to_pylist(), counted.column("pieces").to_pylist(), strict=True))
    pieces = np.concatenate([np.zeros(0, np.int64), *(unpacked(b) for _, b in parts)])
    flat = lambda c: freq.column(c).combine_chunks().flatten()
    steps, n = np.split(unpacked(freq.column("entries")[0].as_py()), 2)
    ends = np.append(0, flat("ends").to_numpy()).astype(np.int64)
    # Running sums of distances within each document are its words.
    walked = np.append(0, np.cumsum(steps))
    word = walked[1:] - np.repeat(walked[ends[:-1]], np.diff(ends))
    sums = np.append(0, np.cumsum(pieces[word] * n))[ends]
    return pa.table({id_col: flat("ids"), "n_bytes": flat("n_bytes"), "n_tokens": pa.array(np.diff(sums))})
