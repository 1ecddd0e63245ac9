"""Connected components of a pair relation, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.operators.greedy import hot_groups
from tessella.session import cut

EDGE_LIMIT = 65536


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], id_col: str, limit: int = EDGE_LIMIT) -> DataFrame:
    """(keys, id, component): component is the smallest id reachable over ``edges`` (columns a, b).

    Groups with few edges are solved inside one task; the others by star contraction, whose
    rounds only ever aggregate and join edges.
    """
    keys = list(keys)
    ids = nodes.select(*keys, id_col)
    e = cut(edges.select(*keys, "a", "b").where(F.col("a") != F.col("b")))
    hot = hot_groups(e, keys, limit)
    if hot.isEmpty():
        labels = solve_small(e, keys)
    else:
        labels = solve_small(e.join(hot, keys, "left_anti"), keys).unionByName(star_contraction(e.join(hot, keys, "left_semi"), keys))
    labels = labels.withColumnRenamed("node", id_col)
    return ids.join(labels, [*keys, id_col], "left").withColumn("component", F.coalesce("component", id_col))


def solve_small(edges: DataFrame, keys) -> DataFrame:
    lists = edges.groupBy(*keys).agg(F.collect_list("a").alias("_a"), F.collect_list("b").alias("_b"))
    nkeys = len(keys)

    def solve(batches):
        for rb in batches:
            at, node, comp = [], [], []
            for g in range(rb.num_rows):
                a = rb.column(nkeys)[g].values.to_numpy(zero_copy_only=False)
                b = rb.column(nkeys + 1)[g].values.to_numpy(zero_copy_only=False)
                names, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
                label = np.arange(len(names))
                u, v = inv[: len(a)], inv[len(a) :]
                while True:
                    low = label.copy()
                    np.minimum.at(low, u, label[v])
                    np.minimum.at(low, v, label[u])
                    low = low[low]
                    if np.array_equal(low, label):
                        break
                    label = low
                at.append(np.full(len(names), g))
                node.append(names)
                comp.append(names[label])
            if not at:
                continue
            idx = pa.array(np.concatenate(at))
            kind = rb.schema.field(nkeys).type.value_type
            yield pa.RecordBatch.from_arrays(
                [
                    *[rb.column(k).take(idx) for k in range(nkeys)],
                    pa.array(np.concatenate(node), kind),
                    pa.array(np.concatenate(comp), kind),
                ],
                [*keys, "node", "component"],
            )

    types = {f.name: f.dataType for f in edges.schema.fields}
    schema = T.StructType(
        [T.StructField(k, types[k]) for k in keys]
        + [T.StructField("node", types["a"]), T.StructField("component", types["a"])]
    )
    return lists.mapInArrow(solve, schema)


def star_contraction(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Large-star / small-star rounds until every node points at its smallest id."""
    keys = list(keys)
    e = cut(_canonical(edges, keys))
    mark = _signature(e)
    while True:
        e = cut(_small_star(_large_star(e, keys), keys))
        now = _signature(e)
        if now == mark:
            break
        mark = now
    roots = e.select(*keys, F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _canonical(edges: DataFrame, keys) -> DataFrame:
    """Distinct edges with a > b."""
    return edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _signature(e: DataFrame):
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*e.columns).cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(e: DataFrame, keys) -> DataFrame:
    both = e.unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(*keys, "a").agg(F.min(F.least("a", "b")).alias("m"))
    return _canonical(
        both.where("b > a").join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")), keys
    )


def _small_star(e: DataFrame, keys) -> DataFrame:
    low = e.groupBy(*keys, "a").agg(F.min("b").alias("m"))
    leaves = e.join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
    hubs = low.select(*keys, "a", F.col("m").alias("b"))
    return _canonical(leaves.unionByName(hubs), keys)
