"""Connected components of an edge table, by distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tardy.session import materialize

_EDGE = "u long, v long"


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the given edges: (node, smallest node of its component) for
    every node that is not its component's smallest."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    parent = list(range(len(nodes)))
    a, b = at[:len(u)].tolist(), at[len(u):].tolist()
    for x, y in zip(a, b):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:                       # nodes are sorted: the smaller index is the smaller node
            parent[max(x, y)] = min(x, y)
    for i in range(len(parent)):         # parents come before children
        parent[i] = parent[parent[i]]
    root = nodes[np.array(parent, np.int64)] if len(nodes) else nodes
    child = root != nodes
    return nodes[child], root[child]


def _local_forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_u, kept_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in it:                     # the forest never exceeds the nodes of this partition
        kept_u, kept_v = union_find(np.concatenate((kept_u, batch.column(0).to_numpy(zero_copy_only=False))),
                                    np.concatenate((kept_v, batch.column(1).to_numpy(zero_copy_only=False))))
    yield pa.RecordBatch.from_arrays([pa.array(kept_u, pa.int64()), pa.array(kept_v, pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node that each node is linked with.

    Nodes that are their own component's smallest are left out, as are nodes
    without an edge.  Each partition first reduces its edges to a union-find
    forest; alternating large-star and small-star steps then merge the forests
    until nothing changes, which takes a number of rounds that grows with the
    logarithm of the longest path.  Every round is written to the checkpoint
    folder, so a lost executor costs one round.  Null ends are ignored.
    """
    pairs = (edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
             .where("u is not null and v is not null and u <> v"))
    cur = materialize(pairs.mapInArrow(_local_forest, _EDGE))
    while not _is_star_forest(cur):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        cur = materialize(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                          .union(low.select("u", F.col("m").alias("v"))).distinct())
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child."""
    ends = edges.select(F.col("u").alias("x"), F.col("v").alias("p")).union(edges.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("p")))
    odd = (ends.groupBy("x").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.max(F.col("p").isNull()).alias("parent"))
           .where("lo <> hi or (lo is not null and parent)"))
    return odd.isEmpty()
