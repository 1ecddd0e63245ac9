"""Packing documents into sequences with a grouping genetic algorithm on islands.

A document's token ids, closed by the end id, are one piece; only what is longer than a sequence is
cut. Full pieces are sequences of their own. The others are dealt into shards of bounded size by a hash, and
every shard is packed by several islands, each with a population of its own: an offspring takes
whole well-filled bins of one parent, loses the bins of the other that hold any of these documents
twice, and best-fits the displaced documents, longest first. Between epochs every island sends its
elite on to the next one of the shard. The emptiest bins of all shards are then dissolved and
packed again in fewer shards, until one shard is left, so that no shard keeps a remainder of its own.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.taskcontext import TaskContext

from tessella.llm import units
from tessella.llm.tokenizers_io import encode_words
from tessella.session import cut, scratch

SHARD = 4096  # pieces of a shard
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
OFFSPRING = 24  # of an island in an epoch
LOOSE = 0.04  # part of a shard's bins that is dissolved for the next level


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece of ``docs``.

    A null or empty text is one piece with the end id alone. Null ids and repeated rows are packed like any
    other row; other columns are not read; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    _pieces(docs, tokenizer, capacity, end_id, id_col, text_col).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    bins = pack(pieces.where(F.col("length") < capacity).select("key", "length"), capacity, shard)
    full = pieces.where(F.col("length") == capacity).select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(bins.unionByName(full), "key").drop("key")


def _pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        known = units.Encoded(lambda words: encode_words(tokenizer, words), 1_000_000)
        key = TaskContext.get().partitionId() << 36
        for rb, buf, offs in units.chunks(batches, "text", 4 * units.CHUNK):
            ids, ends = known.texts(buf, offs, units.WHITE, units.NONE, units.marks(buf))
            ids = np.insert(ids, ends[1:], end_id).astype("<u4")
            ends = ends + np.arange(len(ends))
            n = -(-np.diff(ends) // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(ends)[row] - start)
            at = ends[:-1][row] + start
            crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at, length, strict=True)]
            keys = key + np.arange(len(row))
            key += len(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), rb.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["key", id_col, "piece", "start", "length", "ids_crc32"],
            )

    schema = f"key long, `{id_col}` {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(run, schema)


ISLAND = T.StructType(
    [T.StructField("shard", T.LongType()), T.StructField("island", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("bins", T.IntegerType()), T.StructField("elite", T.ArrayType(T.IntegerType()))]
)


def pack(items: DataFrame, capacity: int, shard: int = SHARD) -> DataFrame:
    """(key, sequence_id, offset) for items (key, length), lengths below ``capacity``, keys unique."""
    done, level = None, 0
    while True:
        n = items.count()
        shards = max(1, -(-n // shard))
        islands = (
            items.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(shards)))
            .groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("key", "length"))).alias("items"))
            .select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.key").alias("keys"), F.col("items.length").alias("lengths"))
            .withColumns({"bins": F.lit(None).cast("int"), "elite": F.array().cast("array<int>")})
            .repartition("shard", "island")
        )
        for epoch in range(EPOCHS):
            if epoch:
                # The elite moves to the next island of its shard.
                guests = islands.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("guest"))
                islands = islands.join(guests, ["shard", "island"])
            else:
                islands = islands.withColumn("guest", F.array().cast("array<int>"))
            islands = cut(islands.mapInArrow(lambda b, e=epoch: _evolve(b, capacity, e), ISLAND))
        best = islands.groupBy("shard").agg(F.min_by(F.struct("keys", "lengths", "elite"), F.struct("bins", "island")).alias("b")).select("shard", "b.*")
        last = shards == 1
        placed = best.mapInArrow(lambda b, k=level, keep=last: _place(b, capacity, k, keep), "key long, length long, sequence_id long, offset long")
        if last:
            return placed.select("key", "sequence_id", "offset") if done is None else done.unionByName(placed.select("key", "sequence_id", "offset"))
        placed = cut(placed)
        kept = placed.where("sequence_id IS NOT NULL").select("key", "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        items = placed.where("sequence_id IS NULL").select("key", "length")
        level += 1


def _evolve(batches, capacity: int, epoch: int):
    for rb in batches:
        rows = []
        for r in rb.to_pylist():
            lengths = r["lengths"]
            rng = random.Random(f"{r['shard']}/{r['island']}/{epoch}")
            first = [_bins_of(x) for x in (r["elite"], r["guest"]) if x]
            best = evolve(lengths, capacity, rng, first)
            elite = [0] * len(lengths)
            for b, held in enumerate(best):
                for i in held:
                    elite[i] = b
            rows.append({"shard": r["shard"], "island": r["island"], "keys": r["keys"], "lengths": lengths, "bins": len(best), "elite": elite})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("bins", pa.int32()), ("elite", pa.list_(pa.int32()))]))


def _bins_of(assigned: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(assigned) + 1)]
    for i, b in enumerate(assigned):
        bins[b].append(i)
    return bins


def best_fit(bins: list[list[int]], loose: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """Put each loose item, in the order given, into the fullest bin that has room for it."""
    by_room: dict[int, list[int]] = {}
    rooms = 0  # a bit for each free space that some bin has
    for b, held in enumerate(bins):
        free = capacity - sum(lengths[i] for i in held)
        by_room.setdefault(free, []).append(b)
        rooms |= 1 << free
    for i in loose:
        fits = rooms >> lengths[i]
        if fits:
            free = (fits & -fits).bit_length() - 1 + lengths[i]
            b = by_room[free].pop()
            if not by_room[free]:
                rooms ^= 1 << free
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        free -= lengths[i]
        by_room.setdefault(free, []).append(b)
        rooms |= 1 << free
    return bins


def fitness(bins: list[list[int]], lengths: list[int]) -> tuple[int, int]:
    """Few bins first, then full ones: the lower, the better."""
    return len(bins), -sum(sum(lengths[i] for i in held) ** 2 for held in bins)


def crossover(one: list[list[int]], other: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """``one`` with whole well-filled bins of ``other``, without their documents elsewhere."""
    ranked = sorted(other, key=lambda held: -sum(lengths[i] for i in held))
    taken = [held for held in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.5]
    inside = {i for held in taken for i in held}
    bins, displaced = [list(held) for held in taken], []
    for held in one:
        if inside.isdisjoint(held):
            bins.append(list(held))
        else:
            displaced += [i for i in held if i not in inside]
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(bins, displaced, lengths, capacity)


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Dissolve the emptiest bin and a few others."""
    emptiest = min(range(len(bins)), key=lambda b: sum(lengths[i] for i in bins[b]))
    gone = {emptiest, *(rng.randrange(len(bins)) for _ in range(3))}
    loose = sorted((i for b in gone for i in bins[b]), key=lambda i: -lengths[i])
    return best_fit([list(held) for b, held in enumerate(bins) if b not in gone], loose, lengths, capacity)


def evolve(lengths: list[int], capacity: int, rng: random.Random, population: list[list[list[int]]]) -> list[list[int]]:
    """The best packing found; no search goes on once the sum of lengths rules out a better one."""
    least = -(-sum(lengths) // capacity)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    if not population:
        population = [best_fit([], order, lengths, capacity)]
    best = min(population, key=lambda p: fitness(p, lengths))
    if len(best) <= least:
        return best
    while len(population) < POPULATION:
        near = sorted(order, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.2))
        population.append(best_fit([], near, lengths, capacity))
    scored = sorted(((fitness(p, lengths), p) for p in population), key=lambda x: x[0])
    for _ in range(OFFSPRING):
        if scored[0][0][0] <= least:
            break
        a, b = sorted(rng.sample(range(len(scored)), 2))
        child = crossover(scored[a][1], scored[b][1], lengths, capacity, rng)
        child = mutate(child, lengths, capacity, rng)
        scored[-1] = min(scored[-1], (fitness(child, lengths), child), key=lambda x: x[0])
        scored.sort(key=lambda x: x[0])
    return scored[0][1]


def _place(batches, capacity: int, level: int, keep_all: bool):
    """Rows of the items, without a sequence where their bin is to be dissolved."""
    for rb in batches:
        for r in rb.to_pylist():
            keys, lengths = r["keys"], r["lengths"]
            bins = _bins_of(r["elite"])
            bins.sort(key=lambda held: (-sum(lengths[i] for i in held), held[0]))
            stay = len(bins) if keep_all else len(bins) - max(1, int(len(bins) * LOOSE))
            out: list[list] = [[], [], [], []]
            for b, held in enumerate(bins):
                at = 0
                for i in held:
                    for column, v in zip(out, (keys[i], lengths[i], (level << 56) + (r["shard"] << 24) + b if b < stay else None, at if b < stay else None), strict=True):
                        column.append(v)
                    at += lengths[i]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "length", "sequence_id", "offset"])
