"""Ranked lexical search by block-max MaxScore over inverted lists of document shards.

The index: every task turns its texts into shards of bounded size. A shard numbers its documents by length, so that a
block of a list has documents of like length, and has a list for each of its terms: blocks of ``BLOCK`` postings,
compressed, each with its last document, its most occurrences and its least length, which bound every score in it.

The search: a block of queries meets the lists of its terms in each shard. For a query, lists are ordered by their global
bounds; those whose bounds together stay below the kth score so far are non-essential. Stretches of document numbers
are taken one after the other: postings of the essential lists give the candidates, and for each non-essential list,
largest bound first, the block maxima at the candidates' places reject them before the block is decompressed. The kth
score rises from stretch to stretch and parts the lists anew. Heaps of the shards are merged in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.taskcontext import TaskContext

from tessella.llm import hashing, units
from tessella.session import scratch

SHARD = 8 << 20  # bytes of text of a shard
BLOCK = 128  # postings of a block
STRETCH = 2048  # documents taken at a time
QUERIES = 64  # queries of a block
A, B = 75, 8  # percent of the length norm; its weight in a score

TERM = units.table(bytes([*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", query_col: str = "item_id", text_col: str = "text", shard: int = SHARD, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """(query, rank, id, score): the ``k`` highest-scoring documents of each query, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased. N documents
    hold a term, L terms in all, n one document; w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 25 + 75 n N div L, and a document scores
    the sum of w * (10^9 tf div (1000 tf + 8 m)) over the query's terms with repeats, in 64-bit integers. Scores of 0 are left out.

    A null or empty text has no terms. Rows that repeat an id are documents of their own, those with a null id count in
    N, L and df and are never returned. Rows that repeat a query's id and text are one query; a null query id is one like
    others. Other columns are not read; without documents or queries the result is empty.
    """
    return find(build(docs, id_col, text_col, shard, block), queries, k, query_col, text_col, stretch)


class Index:
    """Written tables: ``shards`` (shard, ids, lengths), ``lists`` (shard, term, df, lasts, most, least, blocks)."""

    def __init__(self, shards: DataFrame, lists: DataFrame, id_col: str):
        self.shards, self.lists, self.id_col = shards, lists, id_col


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, block: int = BLOCK) -> Index:
    """The index of all documents; no shuffle, as shards are made where the texts are read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole, part = T.LongType(), T.IntegerType()
    schema = T.StructType(
        [T.StructField("shard", whole), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("lengths", T.ArrayType(part)), T.StructField("term", T.StringType()), T.StructField("df", whole)]
        + [T.StructField(c, T.ArrayType(part)) for c in ("lasts", "most", "least")]
        + [T.StructField("blocks", T.ArrayType(T.BinaryType()))]
    )
    folder = scratch(spark)
    rows.mapInArrow(lambda b: _shards(b, shard, block), schema).write.parquet(folder)
    stored = spark.read.schema(schema).parquet(folder)
    return Index(stored.where("term IS NULL").select("shard", "ids", "lengths"), stored.where("term IS NOT NULL").select("shard", "term", "df", "lasts", "most", "least", "blocks"), id_col)


def find(index: Index, queries: DataFrame, k: int = 10, query_col: str = "item_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """As ``search``, on an index."""
    spark = queries.sparkSession
    kind = index.shards.schema["ids"].dataType.elementType
    item = queries.schema[query_col].dataType
    asked = queries.select(F.col(query_col).alias("item"), F.col(text_col).alias("text")).distinct()
    terms = asked.mapInArrow(_terms, T.StructType([T.StructField("item", item), T.StructField("digest", T.LongType()), T.StructField("term", T.StringType()), T.StructField("times", T.LongType())]))
    folder = scratch(spark)
    terms.write.parquet(folder)
    terms = spark.read.schema(terms.schema).parquet(folder)
    number = terms.select("item", "digest").distinct().count()
    parts = max(1, -(-number // QUERIES))
    terms = terms.withColumn("part", F.pmod(F.xxhash64("item", "digest"), F.lit(parts)).cast("int"))

    sums = index.shards.select(F.size(F.filter("lengths", lambda x: x > 0)).cast("long").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("l")).agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    n, length = sums.n or 0, sums.l or 0
    wanted = terms.select("term").distinct()
    weights = index.lists.select("term", "df").join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weights = weights.withColumn("w", F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))))
    uses = terms.join(weights, "term").groupBy("part", "term", "w").agg(F.collect_list(F.struct("item", "digest", "times")).alias("uses"))
    met = index.lists.drop("df").join(uses, "term")
    heads = index.shards.select(F.col("shard").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("in"), "ids", "lengths")
    out = T.StructType([T.StructField("item", item), T.StructField("digest", T.LongType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    tops = met.groupBy("shard", "part").cogroup(heads.groupBy("of", "in")).applyInArrow(lambda a, b: _tops(a, b, n, length, k, stretch), out)
    order = Window.partitionBy("item", "digest").orderBy(F.desc("score"), "id")
    ranked = tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(query_col), "rank", F.col("id").alias(index.id_col), "score")


def _found(buf: np.ndarray, offs: np.ndarray):
    """Numbers of the distinct terms of all texts in order, the terms, and the text of each."""
    low = hashing.LOWER[buf]
    starts, ends = hashing.runs(TERM[low], offs)
    code, terms = units.distinct_ranges(low, starts, ends)
    return code, terms, np.searchsorted(offs, starts, "right") - 1


def _counted(code: np.ndarray, text: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term number and occurrences of each pair of text and term."""
    size = max(len(terms), 1)
    key, times = np.unique(text * size + code, return_counts=True)
    return key // size, key % size, times


def _terms(batches):
    for rb, buf, offs in units.chunks(batches, "text"):
        code, terms, text = _found(buf, offs)
        text, code, times = _counted(code, text, terms)
        sums = hashing.running(buf)
        digests = hashing.mix(hashing.ranges(sums, offs[:-1], offs[1:]) + np.diff(offs).astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(text)), pa.array(digests[text]), terms.cast(pa.string()).take(pa.array(code)), pa.array(times)], ["item", "digest", "term", "times"])


def _shards(batches, limit: int, block: int):
    task, made = TaskContext.get().partitionId() << 32, 0
    held, size = [], 0
    for rb, buf, offs in units.chunks(batches, "text"):
        code, terms, text = _found(buf, offs)
        held.append((rb.column(0), np.bincount(text, minlength=rb.num_rows), *_counted(code, text, terms), terms))
        size += len(buf)
        if size >= limit:
            yield from _shard(task + made, held, block)
            held, size, made = [], 0, made + 1
    if held:
        yield from _shard(task + made, held, block)


def _shard(number: int, held: list, block: int, step: int = 1 << 15):
    """The shard's documents in one row, its lists in the rows after it."""
    coded = pa.concat_arrays([t for *_, t in held]).dictionary_encode()
    renamed, at, base, docs, terms = coded.indices.to_numpy().astype(np.int64), 0, 0, [], []
    for ids, _, doc, code, _, words in held:
        docs.append(doc + base)
        terms.append(renamed[at : at + len(words)][code])
        base += len(ids)
        at += len(words)
    lengths, tf = np.concatenate([n for _, n, *_ in held]), np.concatenate([t for *_, t, _ in held])
    order = np.argsort(lengths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lengths = lengths[order]
    doc, term = place[np.concatenate(docs)], np.concatenate(terms)
    sort = np.argsort(term * len(order) + doc)
    doc, term, tf = doc[sort], term[sort], tf[sort]
    ids = pa.concat_arrays([i for i, *_ in held]).take(pa.array(order))
    names = ["shard", "ids", "lengths", "term", "df", "lasts", "most", "least", "blocks"]
    own = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    none = lambda n, kind: pa.nulls(n, kind)
    ints = pa.list_(pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array([number]), own(ids), own(pa.array(lengths, pa.int32())), none(1, pa.string()), none(1, pa.int64()), none(1, ints), none(1, ints), none(1, ints), none(1, pa.list_(pa.binary()))], names)

    df = np.bincount(term, minlength=len(coded.dictionary))
    first = np.cumsum(df) - df
    per = -(-df // block)
    starts = units.spread(np.zeros(len(per), np.int64), per) * block + np.repeat(first, per)
    ends = np.minimum(starts + block, np.repeat(first + df, per))
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = doc[starts]
    body, bounds = _varints(gaps, tf, starts, ends)
    lasts, most, least = doc[ends - 1], np.maximum.reduceat(tf, starts) if len(starts) else tf[:0], lengths[doc[starts]]  # documents go by length
    word = coded.dictionary.cast(pa.string())
    firsts = np.append(0, np.cumsum(per))
    for a in range(0, len(df), step):
        b = min(a + step, len(df))
        x, y = firsts[a], firsts[b]
        cut = pa.array(firsts[a : b + 1] - x, pa.int32())
        blocks = pa.Array.from_buffers(pa.binary(), int(y - x), [None, pa.py_buffer((bounds[x : y + 1] - bounds[x]).astype(np.int32)), pa.py_buffer(body[bounds[x] : bounds[y]])])
        lists = [pa.ListArray.from_arrays(cut, pa.array(v[x:y], pa.int32())) for v in (lasts, most, least)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number)), none(b - a, pa.list_(ids.type)), none(b - a, ints), word.slice(a, b - a), pa.array(df[a:b].astype(np.int64)), *lists, pa.ListArray.from_arrays(cut, blocks)], names)


def _varints(gaps: np.ndarray, tf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks end to end, of each the gaps and then the occurrences, seven bits a byte; and the n + 1 bounds."""
    at = np.empty(2 * len(gaps), np.int64)
    size = ends - starts
    # Postings of a block follow each other, so its gaps go to twice its start, its occurrences behind them.
    at[: len(gaps)] = np.arange(len(gaps)) + np.repeat(starts, size)
    at[len(gaps) :] = at[: len(gaps)] + np.repeat(size, size)
    value = np.empty(2 * len(gaps), np.int64)
    value[at] = np.concatenate([gaps, tf])
    width = np.ones(len(value), np.int64)
    for bits in (7, 14, 21, 28):
        width += value >> bits > 0
    stop = np.cumsum(width)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    for j in range(5):
        has = width > j
        more = width[has] > j + 1
        out[stop[has] - width[has] + j] = ((value[has] >> (7 * j)) & 127) | (more.astype(np.int64) << 7)
    edge = np.append(0, stop)
    return out, np.append(edge[2 * starts], edge[-1])


def _opened(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents and occurrences of a block."""
    b = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.append(0, last[:-1] + 1)
    width = last - first + 1
    value = np.zeros(len(last), np.int64)
    for j in range(int(width.max())):
        has = width > j
        value[has] |= (b[first[has] + j].astype(np.int64) & 127) << (7 * j)
    half = len(value) // 2
    return np.cumsum(value[:half]), value[half:]


def impact(tf, n, documents: int, length: int):
    """What an occurrence count gives in a document of n terms, to be multiplied by the term's weight."""
    m = 100 - A + A * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + B * m)


class _List:
    """A term's list in a shard; blocks are decompressed when first asked for."""

    def __init__(self, weight: int, lasts: np.ndarray, most: np.ndarray, least: np.ndarray, blocks: list[bytes], score):
        self.weight, self.lasts, self.blocks, self.score = weight, lasts, blocks, score
        self.bounds = weight * score(most, least)
        self.bound = int(self.bounds.max())
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and the scores that the list gives them."""
        if i not in self.read:
            docs, tf = _opened(self.blocks[i])
            self.read[i] = docs, self.weight * self.score(tf, lengths[docs])
        return self.read[i]


def _tops(met: pa.Table, head: pa.Table, documents: int, length: int, k: int, stretch: int) -> pa.Table:
    """The heap of each query of a block of queries in one shard."""
    names = ["item", "digest", "id", "score"]
    item_kind = met.schema.field("uses").type.value_type.field("item").type
    ids = head.column("ids").combine_chunks().flatten()
    lengths = head.column("lengths").combine_chunks().flatten().to_numpy().astype(np.int64)
    taken: dict[tuple, list] = {}
    score = lambda tf, n: impact(tf, n, documents, length)
    whole = lambda x: np.array(x, np.int64)
    for w, lasts, most, least, blocks, uses in zip(*(met.column(c).to_pylist() for c in ("w", "lasts", "most", "least", "blocks", "uses")), strict=True):
        if w > 0:  # a term in nearly all documents may weigh nothing
            own = _List(w, whole(lasts), whole(most), whole(least), blocks, score)
            for use in uses:
                taken.setdefault((use["item"], use["digest"]), []).append((own, use["times"]))
    named = np.asarray(ids.is_valid())
    order = np.empty(len(ids), np.int64)  # of equal scores, the smaller id first
    order[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
    items, digests, found, scores = [], [], [], []
    for (item, digest), lists in taken.items():
        docs, best = block_max(lists, lengths, k, named, order, stretch)
        items += [item] * len(docs)
        digests += [digest] * len(docs)
        found.append(docs)
        scores.append(best)
    flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    return pa.table([pa.array(items, item_kind), pa.array(digests, pa.int64()), ids.take(pa.array(flat(found))), pa.array(flat(scores))], names=names)


def block_max(lists: list[tuple[_List, int]], lengths: np.ndarray, k: int, named: np.ndarray, order: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best of a shard by block-max MaxScore."""
    lists = sorted(lists, key=lambda x: x[0].bound * x[1])
    bound = np.array([x.bound * times for x, times in lists], np.int64)
    below = np.append(0, np.cumsum(bound))  # what the lists before one can add together
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for a in range(0, len(lengths), stretch):
        b = min(a + stretch, len(lengths))
        # A document that stands in the first lists only stays below the kth score.
        essential = int(np.searchsorted(below, least)) - 1 if least else 0
        if essential == len(lists):
            break
        sums, meets = np.zeros(b - a, np.int64), np.zeros(b - a, bool)
        for own, times in lists[essential:]:
            for i in range(int(np.searchsorted(own.lasts, a)), len(own.lasts)):
                d, s = own.block(i, lengths)
                x, y = np.searchsorted(d, (a, b))
                sums[d[x:y] - a] += times * s[x:y]
                meets[d[x:y] - a] = True
                if own.lasts[i] >= b - 1:
                    break
        near = np.flatnonzero(meets & named[a:b])
        for j in range(essential - 1, -1, -1):
            near = near[sums[near] + below[j + 1] >= least]
            if not len(near):
                break
            own, times = lists[j]
            home = np.searchsorted(own.lasts, near + a)
            inside = home < len(own.lasts)
            most = np.zeros(len(near), np.int64)
            most[inside] = times * own.bounds[home[inside]]
            still = sums[near] + most + below[j] >= least  # block maxima reject before decompression
            near, home, inside = near[still], home[still], inside[still]
            for i in np.unique(home[inside]):
                d, s = own.block(int(i), lengths)
                at = near[home == i]
                place = np.minimum(np.searchsorted(d, at + a), len(d) - 1)
                hit = d[place] == at + a
                sums[at[hit]] += times * s[place[hit]]
        near = near[sums[near] >= max(least, 1)]
        if len(near):
            docs, scores = np.append(docs, near + a), np.append(scores, sums[near])
            first = np.lexsort((order[docs], -scores))[:k]
            docs, scores = docs[first], scores[first]
            least = int(scores[-1]) if len(docs) == k else 0
    return docs, scores
