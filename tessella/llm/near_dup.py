"""Near-duplicate documents from bottom-k sketches of one hash function.

1. A document's set of word shingles is hashed once; its sketch is the k smallest hashes. Documents with equal sets
   are one class, which goes on as one row.
2. Inverted lists of retained values: similar classes share at least ``overlap`` values of their sketches, so it is
   enough to list a class under all but ``overlap - 1`` of its values, the rarer ones; it then meets every similar one
   in some list. Values that stand in one sketch only are never listed.
3. Pairs from short lists are kept if the estimate from the union's sketch (how many of the k smallest of both
   are in both) comes near the threshold. A long list only ties its classes to its first one. The components
   of these ties are groups in which all links must lie.
4. In a group, exact Jaccard on the full sets, in cells of bounded size: a small group is one cell, of a large
   one every block is compared with itself and with the first block. What then does not belong to
   the group's main component is compared with all its blocks. Cells count intersections as matrix
   products and give back a spanning set of links, never all pairs.
5. Components of the links, by star contraction.

Whether one text has more words or both have words of their own, each of the k smallest values of both sets is shared with the
probability of their similarity. A pair at the threshold is missed by 2 or 3 with a probability of ``RISK`` at most, others less.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm import hashing, units
from tessella.operators.cluster import EDGE_LIMIT, solve_small, star_contraction
from tessella.session import cut, scratch

K = 32
SHORT = 48  # classes of a list whose pairs are formed
RISK = 1e-8
CELL = 256  # classes of a side of a cell
CELL_SHINGLES = 1 << 19  # shingles of a side of a cell, or one class of more
SALTS = 32  # parts in which a large group meets what is known of it
CHUNK = 1 << 20  # bytes of text handled at a time
COLUMNS = 2048  # shingles of one matrix product


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row; linked: 100 * intersection >= percent * union.

    A set holds the distinct shingles of ``shingle`` words (A-Z lower-cased, cut at ASCII white space); fewer words are
    one shingle. A null text, or one without words, has no shingles and no links. A row with a null id is compared
    with nothing, has no component and is kept. Rows that repeat an id are one document for links. An empty table gives an
    empty result; other columns are not read. ``component_id`` is the smallest id reachable.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    folder = scratch(spark)
    kind = rows.schema["id"].dataType.simpleString()
    rows.mapInArrow(lambda b: _sketches(b, shingle, k), f"id {kind}, n long, digest binary, sketch array<long>").write.parquet(folder)
    made = spark.read.parquet(folder)

    classes = made.where("id IS NOT NULL AND n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # A class is named by its smallest id. Where one id has several texts, its classes are one document.
    ties = _ties(classes, percent, k)
    groups = _components(ties)
    sizes = groups.join(classes.select("rep", "n"), "rep").groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    # Blocks of half a cell on average never outgrow a cell much.
    blocks = F.ceil(F.greatest(F.col("m") / CELL, F.col("s") / CELL_SHINGLES) * 2).cast("int")
    large = sizes.where((F.col("m") > CELL) | (F.col("s") > CELL_SHINGLES)).select("g", blocks.alias("blocks"))
    sized = _told(groups, large, "left").select("rep", "g", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    sets = scratch(spark)
    held = rows.join(sized, rows["id"] == sized["rep"]).select("g", "blocks", "rep", "text")
    held.mapInArrow(lambda b: _sets(b, shingle), f"g {kind}, blocks int, rep {kind}, items binary").write.parquet(sets)
    sets = spark.read.parquet(sets)
    links = cut(_links(sets, percent, kind))
    labels = _components(links)

    same = made.where("id IS NOT NULL AND n > 0").join(classes.select("digest", "rep"), "digest").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # Members of a class follow their representative.
    found = made.where("id IS NOT NULL AND n > 0").join(classes.select("digest", "rep"), "digest").groupBy("id").agg(F.min("rep").alias("rep"), F.count_distinct("rep").alias("reps"))
    if not found.where("reps > 1").isEmpty():  # an id with several texts ties their classes
        labels = _components(links.select("a", "b").unionByName(same))
        found = found.select("id", F.col("id").alias("rep"))
    named = found.join(labels, "rep", "left").select("id", F.coalesce("g", "rep").alias("component_id"))
    out = made.select("id", F.col("n").alias("n_shingles")).join(named, "id", "left")
    own = F.when(F.col("component_id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def overlap(k: int, percent: int, risk: float = RISK) -> int:
    """The most values of k, each shared with a probability of ``percent``, that are reached but for ``risk``."""
    p, tail = percent / 100, 0.0
    for shared in range(k + 1):
        tail += comb(k, shared) * p**shared * (1 - p) ** (k - shared)
        if tail > risk:
            return max(shared, 1)
    return k


def _told(members: DataFrame, large: DataFrame, how: str) -> DataFrame:
    """Members (rep, g, ...) with what is known of large groups (g, ...), of which no task takes all members."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    return salted.join(large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "salt"], how).drop("salt")


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (63 bits) of each text in ascending order, and the n + 1 bounds."""
    low = hashing.LOWER[buf]
    starts, ends = hashing.runs(~units.WHITE[buf], offs)
    words = hashing.mix(hashing.ranges(hashing.running(low), starts, ends), 2)
    bounds = np.searchsorted(starts, offs)
    per = np.diff(bounds)
    text = np.repeat(np.arange(len(per)), per)
    at = np.arange(len(words)) - bounds[text]
    full = np.flatnonzero(at + size <= per[text])
    total = np.zeros(len(full), np.uint64)
    for j in range(size):
        total = (total + words[full + j]) * hashing.B
    owner, value = [text[full]], [hashing.mix(total, 3)]
    for n in range(1, size):  # whole texts of fewer words
        few = np.flatnonzero(per == n)
        total = np.full(len(few), n, np.uint64)
        for j in range(n):
            total = (total + words[bounds[few] + j]) * hashing.B
        owner.append(few)
        value.append(hashing.mix(total, 3 + n))
    owner, value = np.concatenate(owner), (np.concatenate(value) >> np.uint64(1)).astype(np.int64)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))[: len(value)]
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(per) + 1))


def _sketches(batches, size: int, k: int):
    for rb, buf, offs in units.chunks(batches, "text", CHUNK):
        value, bounds = shingles(buf, offs, size)
        n = np.diff(bounds)
        digests = [hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        kept = np.minimum(n, k)
        sketch = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)), pa.int32()), pa.array(value[units.spread(bounds[:-1], kept)]))
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n), pa.array(digests, pa.binary()), sketch], ["id", "n", "digest", "sketch"])


def _ties(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b): pairs whose estimate comes near the threshold, and the classes of each long list with its first."""
    listed = classes.select("rep", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    common = listed.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = listed.join(common, "value").groupBy("rep", "n", "s").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    least = overlap(k, percent)
    # Of the rarer values, those of no other sketch come first.
    listed_under = F.size("v") - F.greatest(F.floor(F.col("s") * least / k), F.lit(1)) + 1
    entries = cut(shared.withColumn("take", listed_under.cast("int")).where("take > 0").select("rep", "n", F.explode(F.slice("v", F.lit(1), F.col("take"))).alias("e")).select("rep", "n", F.col("e.value").alias("value")))
    lists = cut(entries.groupBy("value").agg(F.count(F.lit(1)).alias("m"), F.min_by("rep", F.struct(F.xxhash64("rep"), "rep")).alias("head")).where("m > 1"))
    short = entries.join(lists.where(F.col("m") <= SHORT).select("value"), "value")
    other = short.select("value", F.col("rep").alias("b"), F.col("n").alias("nb"))
    near_size = F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent
    pairs = short.join(other, "value").where((F.col("rep") < F.col("b")) & near_size).select(F.col("rep").alias("a"), "b").distinct()
    one, two = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), classes.select(F.col("rep").alias("b"), F.col("sketch").alias("y"))
    union = F.slice(F.sort_array(F.array_union("x", "y")), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect("x", "y")))
    kept = pairs.join(one, "a").join(two, "b").where(both * k >= F.size(union) * least).select("a", "b")
    long = entries.join(lists.where(F.col("m") > SHORT).select("value", "head"), "value").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    return kept.unionByName(long).distinct()


def _components(edges: DataFrame, limit: int = EDGE_LIMIT) -> DataFrame:
    """(rep, g) of all classes that have an edge; g is the smallest id of the component.

    Up to ``limit`` edges are solved in one task; the rounds of more leave the driver a plan and its statistics each.
    """
    edges = cut(edges.select("a", "b"))
    found = solve_small(edges, []) if edges.count() <= limit else star_contraction(edges, [])
    return cut(found.select(F.col("node").alias("rep"), F.col("component").alias("g")))


def _sets(batches, size: int):
    for rb, buf, offs in units.chunks(batches, "text", CHUNK):
        value, bounds = shingles(buf, offs, size)
        items = [value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), rb.column(2), pa.array(items, pa.binary())], ["g", "blocks", "rep", "items"])


BOTH, LEFT, RIGHT = 0, 1, 2


def _links(sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """(a, b): links that connect what is linked."""
    schema = f"a {kind}, b {kind}"
    small = sets.where("blocks = 1").select("g", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(BOTH).alias("side"), "rep", "items")
    large = sets.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    itself = large.select("g", F.col("block").alias("row"), F.col("block").alias("col"), F.lit(BOTH).alias("side"), "rep", "items")
    first = large.where("block = 0").select("g", F.lit(0).alias("row"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("col"), F.lit(LEFT).alias("side"), "rep", "items")
    others = large.where("block > 0").select("g", F.lit(0).alias("row"), F.col("block").alias("col"), F.lit(RIGHT).alias("side"), "rep", "items")
    found = cut(_solved(small.unionByName(itself).unionByName(first).unionByName(others), percent, schema))
    if large.isEmpty():
        return found
    labels = _components(found).withColumnRenamed("g", "c")
    marked = large.join(labels, "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    main = marked.groupBy("g", "c").agg(F.count(F.lit(1)).alias("w")).groupBy("g").agg(F.max_by("c", F.struct("w", "c")).alias("main"))
    rest = _told(marked, main, "inner").where("c <> main").withColumn("row", F.col("block"))
    lefts = rest.select("g", "row", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("col"), F.lit(LEFT).alias("side"), "rep", "items")
    rows = rest.select("g", "row").distinct()
    rights = large.join(rows, "g").select("g", "row", F.col("block").alias("col"), F.lit(RIGHT).alias("side"), "rep", "items")
    return found.unionByName(_solved(lefts.unionByName(rights), percent, schema))


def _solved(cells: DataFrame, percent: int, schema: str) -> DataFrame:
    return cells.repartition("g", "row", "col").sortWithinPartitions("g", "row", "col").mapInArrow(lambda b: _cells(b, percent), schema)


def _cells(batches, percent: int):
    """Links of each cell; the rows of a cell come one after the other."""
    key, held = None, []
    for rb in batches:
        for g, row, col, side, rep, items in zip(*((x.as_py() for x in c) for c in rb.columns), strict=True):
            if key != (g, row, col):
                if len(held) > 1:
                    yield _cell(held, percent, rb.schema.field("rep").type)
                key, held = (g, row, col), []
            held.append((side, rep, np.frombuffer(items, np.int64)))
        kind = rb.schema.field("rep").type
    if len(held) > 1:
        yield _cell(held, percent, kind)


def _cell(held: list, percent: int, kind) -> pa.RecordBatch:
    side = np.array([s for s, _, _ in held])
    n = np.array([len(x) for *_, x in held])
    left, right = np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT)
    common = intersections([x for *_, x in held], left, right)
    linked = np.zeros((len(held), len(held)), bool)
    linked[np.ix_(left, right)] = 100 * common >= percent * (n[left][:, None] + n[right] - common)
    linked |= linked.T
    np.fill_diagonal(linked, True)
    label = np.arange(len(held))
    while True:
        low = np.where(linked, label, len(held)).min(1)
        if np.array_equal(low, label):
            break
        label = low
    tied = np.flatnonzero(label != np.arange(len(held)))
    reps = [r for _, r, _ in held]
    return pa.RecordBatch.from_arrays([pa.array([reps[i] for i in tied], kind), pa.array([reps[label[i]] for i in tied], kind)], ["a", "b"])


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left and right sets, as products of 0/1 matrices over shared shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one set is in no intersection but with itself.
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)))
    for c in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (c, c + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[a:b], column[a:b] - c] = 1
        out += m[left] @ m[right].T
    same = left[:, None] == right
    return np.where(same, np.array([len(x) for x in sets])[left][:, None], out).astype(np.int64)
