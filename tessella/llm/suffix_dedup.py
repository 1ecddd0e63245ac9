"""Removal of byte strings that stand more than once in a corpus, by merged shard transforms.

Every string of ``length`` bytes holds a smallest hash among its ``GRAM``-byte pieces, at the same place wherever the string stands.
So strings are sorted by that anchor first: a string under an anchor that stands once is itself single, and
needs no suffix sorting at all. What is left is merged per range of anchors:

* a shard (the contexts one task cut out) lists its suffixes in its own order and, for each, the letters that
  precede it on the way left; a letter is an eighth of ``length``, as bytes would take 200 rounds;
* the interleave of all shards' suffixes starts shard after shard. A round distributes it, in its present order, by the
  preceding letters, as the inverse transform does; that sorts all shards together by one letter more, and no suffix is
  compared or sorted anew. Where the letter or the former interval changes, a new interval begins: its
  common prefix ends there;
* an interval of one suffix can never be repeated and leaves. After eight rounds the intervals left
  are the repeated strings.

Texts are named by their MD5: copies of a text have one context list, one result and one text to cut.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessella.llm import hashing, units
from tessella.session import scratch

GRAM = 24
LETTERS = 8
PIECE = 1 << 20  # bytes of a text that are searched for anchors at a time
MERGE = 2 << 20  # bytes of contexts that are merged at a time, if one anchor does not have more
HOT = 4096  # contexts of an anchor that one task merges


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]) per row of ``docs``.

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else in the texts, its own
    included. ``spans`` are (start, end) in bytes; ``kept`` is the rest as a text, without the pieces of
    characters that were cut. A null text is empty; rows that repeat are each other's repeats; null ids
    stay; other columns are not read; an empty table gives an empty result.
    """
    key = _key(text_col)
    done = _by_text(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("key")), length, with_text)
    out = docs.select(F.col(id_col), key.alias("key")).join(done, "key").drop("key")
    return out if with_text else out.drop("kept")


def without_repeats(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """``docs`` with the rest of each text in its place; columns and rows as before, a null text stays null, and other columns may have any names."""
    key = _key(text_col)
    key_col, kept_col, null_col = (units.unused(c, docs.columns) for c in ("key", "kept", "is_null"))
    done = _by_text(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("key")), length, True).select(F.col("key").alias(key_col), F.col("kept").alias(kept_col))
    rest = docs.withColumn(key_col, key).withColumn(null_col, F.col(text_col).isNull()).drop(text_col).join(done, key_col)
    return rest.withColumn(text_col, F.when(~F.col(null_col), F.col(kept_col))).select(*docs.columns)


def _key(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _by_text(rows: DataFrame, length: int, with_text: bool) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) for each distinct text of (key, text)."""
    spark = rows.sparkSession
    anchors = _written(rows.select("key", "text").mapInArrow(lambda b: _anchors(b, length), "anchor long, ctx long, key binary, lo int, size int"))
    common = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    shared = _written(anchors.join(common, "anchor"))
    release(spark)

    contexts = shared.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "lo", "size")).alias("at"))
    several = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    wanted = contexts.join(several, "anchor").select("at.key", F.struct("anchor", "ctx", "d", "at.lo", "at.size").alias("w")).groupBy("key").agg(F.collect_list("w").alias("w"))
    cut_out = _written(_texts(rows).join(wanted, "key").select("text", "w").mapInArrow(_contexts, "anchor long, ctx long, shard int, many boolean, body binary"))
    release(spark)
    verdicts = _written(_merged(cut_out, length))
    release(spark)

    # A context that stands twice is repeated from end to end.
    whole = contexts.where("n > 1").select("anchor", "ctx", F.array(F.lit(0), F.col("at.size")).alias("ranges"))
    known = whole.unionByName(verdicts.join(whole.select("anchor", "ctx"), ["anchor", "ctx"], "left_anti"))
    places = shared.select("anchor", "ctx", "key", "lo").distinct().join(known, ["anchor", "ctx"])
    per_text = places.groupBy("key").agg(F.collect_list(F.struct("lo", "ranges")).alias("r"))
    fields = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept string"
    return _texts(rows).join(per_text, "key", "left").select("key", "text", "r").mapInArrow(lambda b: _apply(b, with_text), fields)


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("key", "text").groupBy("key").agg(F.first("text").alias("text"))


def _written(df: DataFrame) -> DataFrame:
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark) -> None:
    """Let Spark drop the shuffle files of plans that are over; what later steps read is written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _pieces(batches, length: int):
    """(keys, rows, bytes, offsets, places of the first bytes in their texts): long texts in pieces that share length - 1 bytes."""
    for rb, buf, offs in units.chunks(batches, "text", PIECE):
        if rb.num_rows > 1 or len(buf) <= 2 * units.CHUNK:
            yield rb.column(0), np.arange(rb.num_rows), buf, offs, np.zeros(rb.num_rows, np.int64)
        else:
            for a in range(0, len(buf), PIECE):
                b = min(len(buf), a + PIECE + length - 1)
                yield rb.column(0), np.zeros(1, np.int64), buf[a:b], np.array([0, b - a]), np.array([a])


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts that have one anchor: hash of the anchor, first start, last start, text.

    Of equal smallest hashes the last counts, so the choice depends on the string's bytes alone.
    """
    n = len(buf)
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    gram = hashing.mix(hashing.ranges(hashing.running(buf), np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)), 5)
    place = np.arange(len(gram), dtype=np.uint64)
    low = (gram & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - place)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    start = np.flatnonzero(np.arange(len(low)) + length <= offs[text[: len(low)] + 1])
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    at = (np.uint64(0xFFFFFF) - (low[start] & np.uint64(0xFFFFFF))).astype(np.int64)
    new = np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return gram[at[first]].view(np.int64), start[first], start[last], text[start[first]]


def _anchors(batches, length: int):
    for keys, row, buf, offs, base in _pieces(batches, length):
        if len(buf) >= 1 << 24:
            raise ValueError("a chunk is too long for its places")
        anchor, lo, hi, text = anchors(buf, offs, length)
        total = hashing.running(buf)
        size = hi + length - lo
        body = hashing.mix(hashing.ranges(total, lo, lo + size) ^ hashing.mix(size.astype(np.uint64)), 6).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(body), keys.take(pa.array(row[text])), pa.array(lo - offs[text] + base[text], pa.int32()), pa.array(size, pa.int32())],
            ["anchor", "ctx", "key", "lo", "size"],
        )


def _contexts(batches):
    """Bytes of the wanted contexts; the task is the shard."""
    from pyspark.taskcontext import TaskContext

    shard = TaskContext.get().partitionId()
    for rb in batches:
        for text, wanted in zip(rb.column(0), rb.column(1), strict=True):
            raw, w = text.as_py().encode(), wanted.values
            lo, size = w.field("lo").to_numpy(), w.field("size").to_numpy()
            body = [raw[a : a + n] for a, n in zip(lo, size, strict=True)]
            many = w.field("d").to_numpy() > HOT
            yield pa.RecordBatch.from_arrays([w.field("anchor"), w.field("ctx"), pa.array(np.full(len(w), shard), pa.int32()), pa.array(many), pa.array(body, pa.binary())], ["anchor", "ctx", "shard", "many", "body"])


RANGES = "anchor long, ctx long, ranges array<int>"


def _merged(contexts: DataFrame, length: int) -> DataFrame:
    """(anchor, ctx, ranges): start, end of the repeated bytes of each context, one pair after the other."""
    few = contexts.where("NOT many").select("anchor", "ctx", "shard", "body")
    merged = few.repartition("anchor").sortWithinPartitions("anchor", "shard").mapInArrow(lambda b: _merge_groups(b, length), RANGES)
    many = contexts.where("many").select("anchor", "ctx", "body")
    if many.isEmpty():
        return merged
    # An anchor with very many contexts: its strings are dealt out one by one.
    strings = many.mapInArrow(lambda b: _strings(b, length), "anchor long, ctx long, at int, one long, two long")
    twice = strings.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    starts = strings.join(twice, ["one", "two"]).groupBy("anchor", "ctx").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return merged.unionByName(starts.select("anchor", "ctx", F.flatten(F.transform("at", lambda x: F.array(x, x + length))).alias("ranges")))


def _strings(batches, length: int):
    for rb in batches:
        for a in range(0, rb.num_rows, 2048):
            part = rb.slice(a, 2048)
            buf, offs = units.buffer(part.column(2))
            n = np.diff(offs) - length + 1
            start = units.spread(offs[:-1], n)
            owner = pa.array(np.repeat(np.arange(len(n)), n))
            total = hashing.running(buf)
            half = length // 2
            one = hashing.mix(hashing.ranges(total, start, start + half), 8)
            two = hashing.mix(hashing.ranges(total, start + half, start + length), 9)
            at = start - offs[:-1][np.repeat(np.arange(len(n)), n)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), pa.array(at, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["anchor", "ctx", "at", "one", "two"])


def _merge_groups(batches, length: int):
    """Whole anchors at a time, about MERGE bytes of their contexts together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for rb in batches:
        if not rb.num_rows:
            continue
        anchor = rb.column(0).to_numpy()
        # Rows before the last anchor's first one are complete.
        tail = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
        if held and anchor[0] != held[-1].column(0)[-1].as_py() and size >= MERGE:
            yield from _merge(held, length)
            held, size = [], 0
        begin = 0
        sizes = np.cumsum(pc.binary_length(rb.column(3)).to_numpy())
        while tail > begin:
            done = sizes[begin - 1] if begin else 0
            to = int(np.searchsorted(sizes[:tail], done + max(1, MERGE - size))) + 1
            while to < tail and anchor[to] == anchor[to - 1]:
                to += 1
            to = min(to, tail)
            held.append(rb.slice(begin, to - begin))
            size += int(sizes[to - 1] - done)
            if size >= MERGE:
                yield from _merge(held, length)
                held, size = [], 0
            begin = to
        held.append(rb.slice(begin))
        size += int(sizes[-1] - (sizes[begin - 1] if begin else 0))
    if held:
        yield from _merge(held, length)


def _merge(held: list[pa.RecordBatch], length: int):
    t = pa.Table.from_batches(held).combine_chunks()
    order = np.argsort(t.column("shard").to_numpy(), kind="stable")
    t = t.take(pa.array(order))
    buf, offs = units.buffer(t.column("body"))
    ranges = interleave(buf, offs, length)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in ranges])), pa.int32()), pa.array(np.concatenate(ranges) if ranges else [], pa.int32()))
    yield pa.RecordBatch.from_arrays([t.column("anchor").combine_chunks(), t.column("ctx").combine_chunks(), lists], ["anchor", "ctx", "ranges"])


def interleave(buf: np.ndarray, offs: np.ndarray, length: int) -> list[np.ndarray]:
    """Repeated byte ranges of each context (start, end, start, end ...), the contexts standing shard after shard."""
    n = np.maximum(np.diff(offs) - length + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    start = units.spread(offs[:-1], n)
    width = -(-length // LETTERS)
    steps = [min(j * width, length - width) for j in range(LETTERS)]
    letter = hashing.mix(hashing.ranges(hashing.running(buf), np.arange(len(buf) - width + 1), np.arange(width, len(buf) + 1)), 4) if len(buf) >= width else np.zeros(0, np.uint64)
    order = np.arange(len(start))  # the interleave: suffixes, so far by no letter
    interval = np.zeros(len(start), np.int64)
    for step in reversed(steps):
        before = letter[start[order] + step]
        turn = np.argsort(before, kind="stable")  # into the letters' buckets, each in the present order
        order, before, interval = order[turn], before[turn], interval[turn]
        border = np.append(True, (before[1:] != before[:-1]) | (interval[1:] != interval[:-1]))[: len(order)]
        interval = np.cumsum(border)
        lone = border & np.append(border[1:], True)[: len(order)]
        order, interval = order[~lone], interval[~lone]
    hit = np.zeros(len(start), bool)
    hit[order] = True
    out = []
    at = np.append(0, np.cumsum(n))
    for k in range(len(n)):
        out.append(merged_ranges(np.flatnonzero(hit[at[k] : at[k + 1]]), length))
    return out


def merged_ranges(starts: np.ndarray, length: int) -> np.ndarray:
    """Union of [s, s + length) for ascending starts, flat."""
    if not len(starts):
        return np.zeros(0, np.int64)
    new = np.append(True, starts[1:] > starts[:-1] + length)
    first = np.flatnonzero(new)
    return np.stack([starts[first], starts[np.append(first[1:], len(starts)) - 1] + length], 1).ravel()


def _apply(batches, with_text: bool):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for rb in batches:
        out: list[list] = [[], [], [], [], [], []]
        for text, found in zip(rb.column(1), rb.column(2), strict=True):
            raw = text.as_py().encode()
            spans = _spans(found) if found.is_valid else []
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rest = b"".join(kept)
            row = (len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in spans], rest.decode("utf-8", "ignore") if with_text else None)
            for column, v in zip(out, row, strict=True):
                column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string())
        yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def _spans(found) -> list[tuple[int, int]]:
    """Maximal removed runs of one text."""
    at = found.values
    lists = at.field("ranges")
    pairs = lists.flatten().to_numpy().reshape(-1, 2) + np.repeat(at.field("lo").to_numpy(), lists.value_lengths().to_numpy() // 2)[:, None]
    if not len(pairs):
        return []
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    return [(int(a), int(b)) for a, b in zip(pairs[first, 0], reach[np.append(first[1:], len(pairs)) - 1], strict=True)]
