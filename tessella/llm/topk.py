"""Exact top-k by inner product over one KD-tree per shard.

Shards of bounded size are chosen by a hash. A tree halves its rows at the median of the dimension of widest spread, and
every node has the tight box of its rows. No row of a box can score more for a query than
sum over j of max(q_j * low_j, q_j * high_j), so nodes are visited best bound first, and the search ends when the best
bound left is below the kth score. Queries go in blocks: each block first searches one home shard, and
takes the kth score found there to the other shards. Rows that tie with the kth score are never cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm import vectors
from tessella.session import cut

SHARD = 4096
QUERIES = 1024  # of a block
LEAF = 128
NONE = np.iinfo(np.int64).min


def quantised(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, vec): every component x as floor(scale * x), of the vectors that can take part."""
    return vectors.usable(rows, id_col, vec_col).withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("long")))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) over (id, vec) tables of integer vectors of one length.

    A candidate with the query's own id is left out; a query that has fewer candidates than k gets all of them. Of
    rows that repeat an id of the queries the smallest vector is searched for; candidates that repeat each count. Sums
    must stay below 2^53. An empty table on either side gives an empty result.
    """
    vec = vectors.few_copies(candidates, k)
    ask = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    n, m = candidates.count(), ask.count()
    shards, groups = max(1, -(-n // shard)), max(1, -(-m // block))
    trees = vectors.blocks(vec.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))), ["shard"], "rows", "id", "vec")
    trees = cut(trees)
    asked = ask.withColumn("qblock", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)))
    home = F.pmod("qblock", F.lit(shards)).alias("shard")
    out = "query_id long, vec_id long, score long"

    first = vectors.blocks(asked.withColumn("least", F.lit(NONE)), ["qblock"], "asked", "id", "vec", "least").withColumn("shard", home)
    near = cut(_dealt(trees.join(first, "shard"), shards).mapInArrow(lambda b: _search(b, k), out))
    if shards == 1:
        return vectors.ranked(near, k)
    # The kth score of the home shard bounds what other shards need to look at.
    kth = near.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(NONE))
    told = asked.join(kth, asked["id"] == kth["query_id"], "left").select("id", "vec", "qblock", F.coalesce(bound, F.lit(NONE)).alias("least"))
    others = vectors.blocks(told, ["qblock"], "asked", "id", "vec", "least").withColumn("home", F.pmod("qblock", F.lit(shards)))
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").drop("home")
    far = _dealt(trees.join(others, "shard"), shards * groups).mapInArrow(lambda b: _search(b, k), out)
    return vectors.ranked(near.unionByName(far), k)


def _dealt(pairs: DataFrame, n: int) -> DataFrame:
    """Pairs of a tree and a block of queries, a few to a task."""
    return pairs.select("shard", "qblock", "rows", "asked").repartition(max(1, min(n, 2000)), "shard", "qblock")


class Tree:
    """Leaves of a KD-tree and the boxes of all its nodes."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.low, self.high, self.child, self.span = [], [], [], []
        self.order = np.arange(len(rows))
        self._grow(rows, 0, len(rows), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray, a: int, b: int, leaf: int) -> int:
        own = rows[self.order[a:b]]
        node = len(self.span)
        low, high = own.min(0), own.max(0)
        self.low.append(low)
        self.high.append(high)
        self.span.append((a, b))
        self.child.append(())
        wide = int(np.argmax(high - low))
        if b - a > leaf and high[wide] > low[wide]:
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, wide], half)]
            self.child[node] = (self._grow(rows, a, a + half, leaf), self._grow(rows, a + half, b, leaf))
        return node


def search(rows: np.ndarray, ids: np.ndarray, asked: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k best (id, score) per query; places that no row reaching ``least`` fills have the score NONE."""
    tree = Tree(rows)
    rows, ids = rows[tree.order].astype(np.float64), ids[tree.order]
    bound = np.maximum(asked, 0) @ tree.high.T.astype(np.float64) + np.minimum(asked, 0) @ tree.low.T.astype(np.float64)
    leaves = np.array([i for i, c in enumerate(tree.child) if not c])
    # A node's bound is at least that of each node below it: best-first traversal reaches leaves in the order of theirs.
    order = leaves[np.argsort(-bound[:, leaves], 1, kind="stable")]
    best_id = np.full((len(asked), k), np.iinfo(np.int64).max)
    best = np.full((len(asked), k), NONE)
    kth = least.astype(np.float64)
    going = np.arange(len(asked))
    for turn in range(len(leaves)):
        going = going[bound[going, order[going, turn]] >= kth[going]]
        if not len(going):
            break
        at = order[going, turn]
        for leaf in np.unique(at):
            q = going[at == leaf]
            a, b = tree.span[leaf]
            s = (asked[q] @ rows[a:b].T).astype(np.int64)
            i = np.broadcast_to(ids[a:b], s.shape)
            s = np.where((i == own[q, None]) | (s < least[q, None]), NONE, s)
            best_id[q], best[q] = vectors_merge(np.concatenate([best_id[q], i], 1), np.concatenate([best[q], s], 1), k)
        kth[going] = np.maximum(kth[going], best[going, k - 1])
    return best_id, best


def vectors_merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``vectors.merge``, of the columns that can be among the k best only."""
    if scores.shape[1] > 4 * k:
        floor = -np.partition(-scores, k - 1, 1)[:, k - 1]
        width = max(k, int((scores >= floor[:, None]).sum(1).max()))
        pick = np.argsort(scores < floor[:, None], 1, kind="stable")[:, :width]
        ids, scores = np.take_along_axis(ids, pick, 1), np.take_along_axis(scores, pick, 1)
    # NONE has no negative: it is compared as it stands.
    order = np.lexsort((ids, np.invert(scores)), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _search(batches, k: int):
    for rb in batches:
        for r in range(rb.num_rows):
            rows, asked = vectors.members(rb.column(2), r), vectors.members(rb.column(3), r)
            own = asked.field("id").to_numpy()
            ids, scores = search(vectors.matrix(rows, "vec", np.int64), rows.field("id").to_numpy(), vectors.matrix(asked, "vec", np.float64), own, asked.field("least").to_numpy(), k)
            hit = scores != NONE
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, hit.sum(1))), pa.array(ids[hit]), pa.array(scores[hit])], ["query_id", "vec_id", "score"])
