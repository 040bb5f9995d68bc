"""Connected components of a table of links by contraction; nothing is gathered in one place.

Within each partition a union-find leaves a forest of stars. While more than ``FEW`` links are left, each node moves to the
first of itself and its neighbours by the order of a hash, links are renamed by that and shrink by a constant share, whatever
their shape; a bounded rest is finished in one task. Joins have unique keys on one side, so a node with very many links can
be split between tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stored

#: So many links at most are left to one task, 16 bytes each.
FEW = 200_000
#: Links that a task takes in at once, and stars that it carries along.
AT_ONCE, CARRIED = 1_000_000, 500_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the smallest of its tree, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent = further
    below = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[below], nodes[parent[below]]


def _forest(batches):
    """Union-find within a partition; what is known goes out when it gets large, so memory stays bounded."""
    have, size = [], 0

    def told(pair) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["u", "v"])

    for b in batches:
        have.append([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)])
        size += b.num_rows
        if size >= AT_ONCE:
            pair = stars(*map(np.concatenate, zip(*have, strict=True)))
            if len(pair[0]) > CARRIED:
                yield told(pair)
                have, size = [], 0
            else:
                have, size = [pair], len(pair[0])
    if have:
        yield told(stars(*map(np.concatenate, zip(*have, strict=True))))


def components(links: DataFrame, few: int | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (two columns of ids): the smallest id that it reaches.

    Links to itself count for nothing, repeated links count once, and an empty table gives an empty result.
    """
    few = FEW if few is None else few
    edge = "u long, v long"
    own = links.select(*(F.col(f"`{c}`").cast("long").alias(n) for c, n in zip(links.columns, "uv", strict=True))).where("u <> v")
    edges = stored(own.mapInArrow(_forest, edge), "links")
    by_hash = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    moves = []
    while edges.count() > few:
        both = edges.union(edges.select("v", "u"))
        move = stored(both.groupBy("u").agg(F.least(F.min(by_hash("v")), by_hash("u"))["node"].alias("to")), "moves")
        moves.append(move)
        at_u = edges.join(move, "u").select(F.col("to").alias("x"), "v")
        at_v = at_u.join(move.select(F.col("u").alias("v"), F.col("to").alias("y")), "v")
        edges = stored(at_v.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().mapInArrow(_forest, edge), "links")
    rest = stored(edges.repartition(1).mapInArrow(_forest, edge), "rest")  # at most ``few`` links
    found = rest.union(rest.select(F.col("v").alias("u"), "v").distinct()).toDF("node", "component")
    if not moves:
        return found
    for move in reversed(moves):
        found = move.join(found, F.col("to") == F.col("node"), "left").select(F.col("u").alias("node"), F.coalesce("component", "to").alias("component"))
    found = stored(found, "labels")
    return found.join(found.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component"))
