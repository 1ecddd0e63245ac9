"""Approximate nearest neighbours by inner product: inverted lists scanned by columns with early abandoning.

The largest inner product is the smallest distance once every vector has one more component that brings all
to the same length. A k-means of a bounded sample gives the lists' centres, and all vectors are
assigned to them. A query probes every list whose centre is at most ``slack`` times as far as its nearest
centre, and in any case the ``LEAST`` nearest ones and so many that they hold a few times k vectors. In a list, vectors are rotated at random and stored in blocks of columns. After each
block the distance so far estimates the whole one; a candidate is abandoned once the hypothesis that it is
within the kth distance is rejected: d_part > d_kth * sqrt(part / whole) * (1 + e / sqrt(part)). What is left
is scored exactly on the original vectors. A first pass over the nearest list sets the kth distance
that the other lists begin with.

Lists are split into blocks of bounded size, so a crowded list is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm import vectors
from tessella.session import cut

LISTS = 4096  # at most; the square root of the number of vectors below that
SAMPLE = 65_536  # vectors that the centres are made from, at most
ROWS = 4096  # of a block of a list
QUERIES = 2048  # of a block of queries
SLACK = 1.22
LEAST = 8
ERROR = 2.5  # standard errors of the test
COLUMNS = 16
PAIRS = 250_000  # of queries and candidates that are looked at together


def search(rows: DataFrame, queries: DataFrame, k: int = 20, slack: float = SLACK, error: float = ERROR) -> DataFrame:
    """(query_id, rank, vec_id, score) over (id, vec) tables from ``vectors.usable``, zero vectors left out.

    A candidate with the query's own id is left out. Of rows that repeat an id of the queries the smallest vector is
    searched for; candidates that repeat each count. An empty table on either side gives an empty result.
    """
    spark = rows.sparkSession
    nonzero = lambda df: df.where(F.exists("vec", lambda x: x != 0))
    rows, ask = nonzero(rows), nonzero(queries).groupBy("id").agg(F.min("vec").alias("vec"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square(F.col("vec"))).alias("top"), F.max(F.size("vec")).alias("d")).first()
    out = "query_id long, vec_id long, score double"
    if not about["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_lists = min(LISTS, int(np.ceil(np.sqrt(about["n"]))))
    # The same fraction of all rows, by a hash of the id: near SAMPLE at most.
    share = min(1.0, min(SAMPLE, 64 * n_lists) / about["n"])
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("id").limit(2 * SAMPLE).toPandas()
    top = float(about["top"])
    centres = _centres(_lifted(np.stack(sample.vec.to_numpy()), top), n_lists) if len(sample) else np.zeros((1, about["d"] + 1))
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((about["d"] + 1, about["d"] + 1)))[0]
    held = spark.sparkContext.broadcast((centres, rotation, top))

    kept = vectors.few_copies(rows, k)
    assigned = kept.mapInArrow(lambda b: _assign(b, held), "id long, vec array<double>, list int")
    assigned = cut(assigned)
    counts = assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.select("list", F.ceil(F.col("n") / ROWS).alias("parts"))
    sizes = np.zeros(len(centres), np.int64)
    for r in counts.collect():  # a row for each list, of which there are LISTS at most
        sizes[r["list"]] = r["n"]
    lists = vectors.blocks(assigned.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("id", F.lit(4)), "parts")), ["list", "part"], "rows", "id", "vec")
    lists = cut(lists)
    groups = max(1, -(-ask.count() // QUERIES))
    probes = cut(ask.mapInArrow(lambda b: _probe(b, held, slack, sizes, 4 * (k + 1)), "id long, vec array<double>, lists array<int>"))
    probes = probes.withColumn("qblock", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(groups)))

    first = probes.select("id", "vec", "qblock", F.col("lists")[0].alias("list"), F.lit(float("-inf")).alias("least"))
    near = cut(_pairs(lists, first).mapInArrow(lambda b: _scan(b, held, k, error), out))
    kth = vectors.ranked(near, k).groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    told = probes.join(kth, probes["id"] == kth["query_id"], "left").select(
        "id", "vec", "qblock", F.explode(F.slice("lists", F.lit(2), F.size("lists"))).alias("list"),
        F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(float("-inf"))).alias("least"),
    )
    far = _pairs(lists, told).mapInArrow(lambda b: _scan(b, held, k, error), out)
    return vectors.ranked(near.unionByName(far), k)


def _pairs(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """A block of a list with a block of the queries that probe it, a few pairs to a task."""
    blocks = vectors.blocks(asked, ["list", "qblock"], "asked", "id", "vec", "least")
    n = 4 * int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.join(blocks, "list").select("rows", "asked", "list", "part", "qblock").repartition(n, "list", "part", "qblock")


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """With one more component: all of squared length ``top``."""
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to all centres, but for the row's own square."""
    return (centres * centres).sum(1) - 2 * x @ centres.T


def _centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmin(_nearest(x[a : a + 4096], centres), 1) for a in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        there, first = np.unique(own[order], return_index=True)
        centres[there] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return centres


def _assign(batches, held):
    centres, _, top = held.value
    for rb in batches:
        if rb.num_rows:
            x = _lifted(vectors.matrix(pa.StructArray.from_arrays([rb.column(1)], ["vec"]), "vec", np.float64), top)
            own = np.concatenate([np.argmin(_nearest(x[a : a + 1024], centres), 1) for a in range(0, len(x), 1024)])
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(own, pa.int32())], ["id", "vec", "list"])


def _probe(batches, held, slack: float, sizes: np.ndarray, enough: int):
    """Lists to probe, nearest first; a query has no extra component."""
    centres, _, top = held.value
    for rb in batches:
        if not rb.num_rows:
            continue
        x = vectors.matrix(pa.StructArray.from_arrays([rb.column(1)], ["vec"]), "vec", np.float64)
        # The query is brought to the vectors' length, which leaves the order of its candidates as it is.
        x = x * np.sqrt(top) / np.linalg.norm(x, axis=1, keepdims=True)
        lists = []
        for a in range(0, len(x), 1024):
            d = np.sqrt(np.maximum(top + _nearest(np.pad(x[a : a + 1024], ((0, 0), (0, 1))), centres), 0))
            order = np.argsort(d, 1, kind="stable")
            n = (d <= slack * d.min(1, keepdims=True) + 1e-9).sum(1)
            n = np.maximum(n, (np.cumsum(sizes[order], 1) < enough).sum(1) + 1)
            n = np.minimum(np.maximum(n, LEAST), len(centres))
            lists += [o[:c].tolist() for o, c in zip(order, n, strict=True)]
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(lists, pa.list_(pa.int32()))], ["id", "vec", "lists"])


def _scan(batches, held, k: int, error: float):
    _, rotation, top = held.value
    d = len(rotation)
    cuts = [*range(COLUMNS, d, COLUMNS), d]
    spans = list(zip([0, *cuts[:-1]], cuts, strict=True))
    for rb in batches:
        for r in range(rb.num_rows):
            rows, asked = vectors.members(rb.column(0), r), vectors.members(rb.column(1), r)
            x, ids = vectors.matrix(rows, "vec", np.float64), rows.field("id").to_numpy()
            turned = _lifted(x, top) @ rotation
            columns = [np.ascontiguousarray(turned[:, a:b]) for a, b in spans]
            q_all, own, least = vectors.matrix(asked, "vec", np.float64), asked.field("id").to_numpy(), asked.field("least").to_numpy()
            step = max(1, PAIRS // len(ids))
            for at in range(0, len(q_all), step):
                q, me, low = q_all[at : at + step], own[at : at + step], least[at : at + step]
                i, j, score = _survivors(x, ids, columns, spans, q, me, low, np.pad(q, ((0, 0), (0, 1))) @ rotation, top, error)
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pa.RecordBatch.from_arrays([pa.array(me[i[best]]), pa.array(ids[j[best]]), pa.array(score[best])], ["query_id", "vec_id", "score"])


def _survivors(x, ids, columns, spans, q, own, low, turned, top: float, error: float):
    """(query, candidate, score) of the pairs that no block of columns rejects and that reach the query's bound."""
    d = spans[-1][1]
    # A score of s is the squared distance |q|^2 + top - 2 s.
    far2 = (q * q).sum(1) + top - 2 * low
    limit = lambda b: far2 * (b / d) * (1 + error / np.sqrt(b)) ** 2 if b < d else np.full(len(far2), np.inf)
    (a, b), c = spans[0], columns[0]
    near = turned[:, a:b]
    first = (near * near).sum(1)[:, None] + (c * c).sum(1) - 2 * near @ c.T
    i, j = np.nonzero((first <= limit(b)[:, None]) & (ids != own[:, None]))
    part = first[i, j]
    for (a, b), c in zip(spans[1:], columns[1:], strict=True):
        gap = c[j] - turned[i, a:b]
        part = part + np.einsum("ij,ij->i", gap, gap)
        stays = part <= limit(b)[i]
        i, j, part = i[stays], j[stays], part[stays]
    score = np.einsum("ij,ij->i", x[j], q[i])
    good = score >= low[i]
    return i[good], j[good], score[good]
